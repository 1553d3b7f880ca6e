import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from gridwake.llm import fingerprint, jaccard_join, mixing, packing, quality, sharding, token_count, toxicity


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("chunk", [512, 7])
def test_splitter_equals_the_pattern(chunk):
    import public_tokenizers

    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab'srevlltmd 0 12\n\t .!é '' 'x") for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["", "'r", "a'l", "'", "  ", "x \n"]
    want = [w.encode() for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)]
    data, offsets = token_count.utf8(pa.array(texts))
    start, size = token_count.Splitter(chunk).words(data, offsets)
    assert [data[a : a + n].tobytes() for a, n in zip(start, size)] == want


def test_token_counts(spark, documents, awkward, vocabulary, tokenizer):
    rows = [*awkward, (10, "don't we'll <|endoftext|> 've"), (11, "x\u0085y z")]
    got = token_count.token_counts(documents(rows), vocabulary, 5).collect()
    want = Counter((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    assert token_count.token_counts(documents([]), vocabulary).count() == 0


@pytest.mark.parametrize("states", [300_000, 50])
def test_transducer_equals_the_library(vocabulary, tokenizer, monkeypatch, states):
    """Words never seen, special strings and awkward characters; with few states the machine forgets all the time."""
    monkeypatch.setattr(token_count, "STATES_KEPT", states)
    monkeypatch.setattr(token_count, "GROUP_BYTES", 500 if states == 50 else 2_000_000)
    rnd = random.Random(2)
    letters = [*"abc  \n\t'sreLV.,!12é中\u00a0\u3000😀", "<|endoftext|>", "'re", "'ll", "  ", "th", "tion"]
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(40))) for _ in range(1500)] + ["", "a" * 3000, " " * 2000, "x<|endoftext|><|endoftext|>y", "<|endof", "text|>", "".join(rnd.choices(["hello ", "wörld\n", "a", "  ", "thtion"], k=2000))]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    m = token_count.Machine(vocabulary)
    counts, ids = m.encode(pa.array(texts), want_ids=True)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert token_count.count_batch(texts[:200], vocabulary) == [len(x) for x in want[:200]]


def _piecewise(counts, window):
    """Best fit, one piece after the other."""
    windows = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [w for w in windows if w[0] >= length]
            if fits:
                min(fits)[0] -= length
            else:
                windows.append([window - length])
    return sorted(w[0] for w in windows)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 60, 12), rng.integers(1, 30, 12))}
    used = Counter()
    for length, _, n, first, each, _ in packing.best_fit_plan(counts, 64):
        for j in range(n):
            used[first + j // each] += length
    assert sorted(64 - v for v in used.values()) == _piecewise(counts, 64)


def test_pack_round_trip(spark, documents, awkward, vocabulary, tokenizer):
    got = packing.pack(documents(awkward), vocabulary, window=64, keep_ids=True).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, t in dict(awkward).items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[i], key=lambda r: r.start)
        copies = sum(1 for j, _ in awkward if j == i)
        assert len(parts) % copies == 0 and [x for r in parts[::copies] for x in r.ids] == ids
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids) for r in parts)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(n for _, n in p) <= 64
    assert packing.pack(documents([]), vocabulary).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 100, 1001])
def test_permutation_is_a_bijection(spark, total):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(total).select(sharding.permuted(F.col("id"), total, 3)).collect()]
    assert sorted(got) == list(range(total))


def test_shards(spark, documents, awkward):
    rows = [*awkward, *[(100 + i, "copy") for i in range(300)]]
    got = sharding.shard(documents(rows), 7).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [r.asDict() for r in sharding.shard(documents(rows), 7).orderBy("doc_id", "slot").collect()] == [r.asDict() for r in sharding.shard(documents(rows).repartition(5), 7).orderBy("doc_id", "slot").collect()]
    assert sharding.shard(documents([]), 7).count() == 0


def _canonical(t):
    n = lambda s: unicodedata.normalize("NFKC", s)
    return " ".join(n(n(t).casefold()).split())


def test_fingerprints(spark, documents, awkward):
    rows = awkward
    got = {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(documents(rows)).collect()}
    groups = defaultdict(set)
    for i, t in rows:
        groups[_canonical(t or "")] |= {f for j, f in got if j == i}
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_clashing_buckets_are_told_apart(spark):
    x = spark.createDataFrame([("b", "one"), ("b", "two"), ("c", "same"), ("c", "same")], "bucket string, canon string")
    assert [r.bucket for r in fingerprint.clashes(x).collect()] == ["b"]


def test_edited_fingerprints(spark, documents, awkward):
    """A row for every row; documents without an id come last in the order, repeated rows are one document there."""
    rows = [*awkward, (None, "other text without id"), (3, "a")]
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited) for r in fingerprint.edited_fingerprints(documents(rows)).collect())
    assert sum(got.values()) == len(rows)
    order = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda r: -r[0])
    ends = [(i, t) for i, t in {(i, t or "") for i, t in rows if i is None}]
    for tail in (ends, ends[::-1]):  # rows of one id follow a hash of the text
        want = Counter()
        whole = [*order, *tail]
        for k, (i, t) in enumerate(whole):
            after = whole[(k + 1) % len(whole)][1]
            n = len(t) // 3
            edited = t[: len(t) - n] + after[:n]
            want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(_canonical(t) == _canonical(edited))] += sum((j, u or "") == (i, t) for j, u in rows)
        if want == got:
            break
    else:
        raise AssertionError("no order gives these rows")
    assert fingerprint.edited_fingerprints(documents([])).count() == 0


def _jaccard(rows, threshold=0.8):
    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    links, root = Counter(), {i: i for i, _ in rows}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and len(s & t) >= threshold * len(s | t):
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    return {i: (root[i], links[i]) for i, _ in rows}


def test_jaccard_join(spark, documents, awkward):
    rnd = random.Random(4)
    rows = [r for r in dict(awkward).items() if r[0] is not None]
    for g in range(12):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(30, 200))]
        for k in range(rnd.randrange(1, 12)):
            t = list(base)
            for _ in range(rnd.randrange(3)):
                t[rnd.randrange(len(t))] = "edit"
            rows.append((100 * g + 50 + k, " ".join(t)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.link_classes(documents(rows)).collect()}
    assert got == _jaccard(rows)
    kept = {r.doc_id for r in jaccard_join.keep_one(documents([*rows, (None, "no id")])).collect()}
    assert kept == {i for i, (c, _) in got.items() if c == i} | {None}
    assert jaccard_join.link_classes(documents([])).count() == 0


def test_jaccard_join_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[: i % 79], f"edit{i}", *base[i % 79 + 1 :]])) for i in range(40)] + [(100 + i, " ".join(base)) for i in range(5)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.link_classes(documents(rows)).collect()}
    assert got == _jaccard(rows)


def test_prefixes_are_shortened_to_the_recall():
    k = jaccard_join.prefix_length(0.8, 24, 0.9995)
    assert 1 - (1 - 0.8**k) ** 24 >= 0.9995 > 1 - (1 - 0.8 ** (k + 1)) ** 24


@pytest.mark.parametrize("n, shared", [(200, 160), (40, 32)])
def test_prefixes_meet_by_the_law_of_minhash(n, shared):
    rnd, met, runs = np.random.default_rng(3), np.zeros(8), 600
    for _ in range(runs):
        s = jaccard_join.shingles(rnd.integers(0, 1 << 63, n + 4, np.uint64))
        own = (n - shared) // 2
        a, b = (jaccard_join.prefixes(x, 24, 8) for x in (s[: shared + own], np.concatenate([s[:shared], s[shared + own :]])))
        met += (a == b).any(axis=1)
    law = [1 - (1 - (shared / n) ** k) ** 24 for k in range(1, 9)]
    assert np.abs(met / runs - law).max() < 0.02


def _edited(rnd, words, edits):
    base = [f"w{rnd.randrange(3000)}" for _ in range(words)]
    return base, [f"e{rnd.random()}" if i in edits else w for i, w in enumerate(base)]


def _forest_lengths(monkeypatch, spark, documents, rows):
    lengths, inner = [], jaccard_join._groups

    def groups(nodes, length):
        lengths.append(length)
        return inner(nodes, length)

    monkeypatch.setattr(jaccard_join, "_groups", groups)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.link_classes(documents(rows)).collect()}
    return got, lengths


def test_forest_stays_at_long_prefixes_where_all_links_are_close(spark, documents, monkeypatch):
    rnd = random.Random(11)
    rows = []
    for g in range(30):
        for k, t in enumerate(_edited(rnd, 300, {7})):
            rows.append((2 * g + k, " ".join(t)))
    got, lengths = _forest_lengths(monkeypatch, spark, documents, rows)
    assert got == _jaccard(rows)
    assert lengths == [jaccard_join.LONGEST_PREFIX]


def test_forest_shortens_prefixes_for_links_near_the_threshold(spark, documents, monkeypatch):
    rnd = random.Random(12)
    rows = []
    for g in range(150):  # two edits far apart in 104 words: 90 of 110 shingles shared, a similarity of 0.82
        for k, t in enumerate(_edited(rnd, 104, {30, 70})):
            rows.append((2 * g + k, " ".join(t)))
    got, lengths = _forest_lengths(monkeypatch, spark, documents, rows)
    truth = _jaccard(rows)
    assert sum(n for _, n in truth.values()) >= 290
    assert sum(got[i] == truth[i] for i in truth) >= 0.99 * len(truth)
    assert lengths[0] == jaccard_join.LONGEST_PREFIX and len(lengths) > 1 and lengths[-1] == jaccard_join.prefix_length()


WORDS = "the of and a to in is it that was for on are with as at be this from or had by".split()


def _prose(rnd, n):
    return " ".join(rnd.choice(WORDS) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9))) for _ in range(n)) + "."


@pytest.mark.parametrize("kept", [300_000, 500])
def test_long_words_by_chunks(vocabulary, monkeypatch, kept):
    """Words of many chunks give the library's ids, in seconds, also while old states are given up between blocks."""
    import time

    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_count, "STATES_KEPT", kept)
    monkeypatch.setattr(token_count, "BLOCK_BYTES", 1 << 14)
    rnd = random.Random(16)
    library, own = Tokenizer.from_file(vocabulary), token_count.Machine(vocabulary)
    texts = ["a" * 70_001, "ab" * 20_000, "é" * 9_000, "日本" * 5_000, "0" * 30_000, "".join(rnd.choice("abcdefghijklmnop") for _ in range(30_000)), "".join(rnd.choice(["tion", "ing", "er", "a"]) for _ in range(9_000)), ("x" * 4097 + " ") * 5, "short words"]
    began = time.time()
    counts, ids = own.encode(pa.array(texts), True)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert own.encode(pa.array(["a" * 2_000_000]), False)[0].tolist() == [len(library.encode("a" * 2_000_000, add_special_tokens=False).ids)]
    assert time.time() - began < 60


def test_quality_of_a_shuffled_table(spark):
    """Rows that come from a shuffle, which adaptive execution cuts anew each time, give what a plain scan gives; repeated rows and null ids too."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    some = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long")))
    model = quality.fit(docs, labels)
    read = lambda d: Counter((r.doc_id, r.lang, r.n_symbols, round(r.surprise, 6), r.n_shapes, round(r.shape_surprise, 6)) for r in quality.scores(d, model).collect())
    want = read(some)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert read(some.repartition("doc_id")) == want and read(some.distinct().union(docs.where("doc_id < 20")).union(some.where("doc_id is null").limit(0))) == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sum(want.values()) == some.count()


def test_quality(spark, documents):
    rnd = random.Random(7)
    rows = [(i, _prose(rnd, 120)) for i in range(120)] + [(1000 + i, " ".join(w.upper() + "!!" for w in _prose(rnd, 120).split())) for i in range(20)] + [(2000, None), (2001, ""), (None, _prose(rnd, 60))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(rows), labels).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if not r.keep} == {1000 + i for i in range(20)}
    assert {r.doc_id for r in quality.keep_good(documents(rows), labels).collect()} == {i for i, _ in rows} - {1000 + i for i in range(20)}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep for r in quality.classify(documents(rows[:3]), none).collect())


def _kneser_ney(texts):
    """Probability of a symbol after its context, by the published recursion on plain dictionaries; texts are lists of framed symbols."""
    n = quality.ORDER
    counts = {n: Counter(tuple(t[i - n + 1 : i + 1]) for t in texts for i in range(n - 1, len(t)))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, after = {}, {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
        y = n1 / max(1, n1 + 2 * n2)
        discounts[k] = [0] + [min(max(i - (i + 1) * y * b / max(1, a), 0.1), i - 0.1) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        after[k] = defaultdict(dict)
        for g, v in c.items():
            after[k][g[:-1]][g[-1]] = v

    def p(context, w):
        k = len(context) + 1
        lower = p(context[1:], w) if context else 1 / (len(counts[1]) + 1)
        seen = after[k].get(context)
        if not seen:
            return lower
        total, d = sum(seen.values()), discounts[k]
        own = seen[w] - d[min(3, seen[w])] if w in seen else 0
        return own / total + sum(d[min(3, v)] for v in seen.values()) / total * lower

    return p


@pytest.mark.parametrize("hot", [1_000_000, 300, 1])
def test_scores_equal_the_published_recursion(spark, documents, monkeypatch, hot):
    """Frequent n-grams by look-up, the others by join: the same sums; also for repeated, empty and null texts, and null ids."""
    monkeypatch.setattr(quality, "HOT_KEYS", hot)
    monkeypatch.setattr(quality, "FILTER_BITS", 1 << 20)
    rnd = random.Random(13)
    rows = [(i, " ".join(rnd.choice([*WORDS[:9], "Is", "12", "of."]) for _ in range(30))) for i in range(20)] + [(50, "the of zebra the of and"), (None, "of of the\n12"), (None, ""), (50, "a"), (50, "a"), (51, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    m = quality.fit(documents(rows), labels)
    teaches = {r.doc_id for r in documents(rows).where("doc_id < 20").where(~quality._sets_thresholds(F.col("doc_id"))).collect()}

    def framed(read, t):
        x, _ = read([t or ""])
        return [quality._PAD] * (quality.ORDER - 1) + x.tolist() + [quality._END] if len(x) else []

    got = Counter((r.doc_id, r.n_symbols, round(r.surprise, 6) + 0.0, r.n_shapes, round(r.shape_surprise, 6) + 0.0) for r in quality.scores(documents(rows), m).collect())
    want, models = Counter(), {f: _kneser_ney([framed(f, t) for i, t in rows if i in teaches]) for f in (quality.letters, quality.shapes)}
    for i, t in rows:
        out = [i]
        for f, p in models.items():
            x = framed(f, t)
            k = quality.ORDER - 1
            out += [max(0, len(x) - k), round(-sum(math.log(p(tuple(x[j - k : j]), x[j])) for j in range(k, len(x))), 6) + 0.0]
        want[tuple(out)] += 1
    assert got == want


def test_probabilities_add_up(spark):
    rnd = random.Random(8)
    p = _kneser_ney([[1] * 4 + [rnd.choice("abcd") for _ in range(200)] + [2] for _ in range(5)])
    for context in (("a", "b"), ("c",), ("d", "a", "b", "c"), (1, 1, 1, 1)):
        assert sum(p(context, w) for w in [*"abcd", 2, "never"]) == pytest.approx(1)


def test_readings():
    at = lambda f, t: f([t])[0].tolist()
    assert at(quality.letters, "Ab  9\n\nç") == [ord(c) for c in "ab 0\nç"] and at(quality.letters, "") == at(quality.shapes, "") == []
    same = lambda a, b: at(quality.shapes, a) == at(quality.shapes, b)
    assert same("one two", "three  four") and not same("one two", "one one") and same("x one one", "y two two") and not same("a!", "a!!") and same("a!!!!", "a!!!!!!")
    assert not same("Ab", "AB") and not same("a" * 9, "a" * 20) and same("é", "e") and len(at(quality.shapes, "Ab Ab Ab")) == 4


def test_gibberish_between_frequent_words_is_rejected(spark, documents):
    rnd = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    known = ["".join(rnd.choice(letters) for _ in range(7)) for _ in range(400)]

    def text(rare):
        return " ".join(rnd.choice(WORDS) if rnd.random() < 0.5 else rare() for _ in range(150))

    rows = [(i, text(lambda: rnd.choice(known))) for i in range(160)] + [(1000 + i, text(lambda: "".join(rnd.choice(letters) for _ in range(7)))) for i in range(15)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(140)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.classify(documents(rows), labels).collect() if not r.keep} == {1000 + i for i in range(15)}


def test_toxicity(spark, documents):
    rnd = random.Random(9)
    bad = ["vilewort", "grubscum", "dolthead", "wormface"]
    rows, labels = [], []
    for i in range(400):
        w = _prose(rnd, 80).split()
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [(5001, None), (5002, ""), (None, "no id")]
    got = toxicity.score(documents([*rows, *extra]), known).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in toxicity.keep_clean(documents([*rows, *extra]), known).collect()}
    assert {5001, 5002, None} <= kept and kept == {r.doc_id for r in got if r.predicted == 0}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(documents(rows[:5]), none).collect()} == {0}


def test_evidence_equals_plain_compression(spark):
    """Scores against every window compressed under every dictionary, without tables or shortcuts; copies teach nothing twice."""
    import zstandard

    rnd = random.Random(14)
    bad = ["vilewort", "grubscum", "dolthead"]
    ordinary = [[_prose(rnd, 60) for _ in range(60)] for _ in range(3)]
    toxic = [[" ".join([*_prose(rnd, 30).split(), rnd.choice(bad), *_prose(rnd, 30).split(), rnd.choice(bad)]) for _ in range(60)] for _ in range(2)]
    contents = [[toxicity.trained(t, 16_384) for t in part] for part in (ordinary, toxic)]
    assert toxicity.trained(ordinary[0] * 3, 16_384) == contents[0][0] and toxicity.trained(["a"], 16_384) is None
    distance = toxicity.Distance(*contents)

    def length(content, unit):
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False, write_checksum=False).compress(toxicity.code(unit)))

    def gain(unit):
        g = min(length(c, unit) for c in contents[0]) - max(length(c, unit) for c in contents[1])
        return g if g > toxicity.GAIN else 0

    for text in ["", toxic[0][0], ordinary[1][3], "VILEWORT vilewort the", "the zzz unseen grubscum " * 50]:
        found = set(re.findall(r"\w+", text.lower()))
        assert distance.evidence(text) == pytest.approx(sum(gain(u) for w in found for u in toxicity.units(w)) / math.sqrt(len(found) + 10))
    assert all(distance.gain(w) > 0 for w in bad)


def test_toxicity_of_repeated_rows_and_empty_tables(spark, documents, awkward):
    known = spark.createDataFrame([(3, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(documents(awkward), known).collect()
    assert len(got) == len(awkward) and len({r.score for r in got if r.doc_id == 3}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(documents([]), known).count() == 0
    assert toxicity.keep_clean(documents(awkward), known).count() <= len(awkward)


def test_held_out_labels_are_never_read(spark, documents):
    rnd = random.Random(10)
    rows = [(i, _prose(rnd, 40)) for i in range(100)]
    flip = lambda i, v: 1 - v if zlib.crc32(str(i).encode()) % 5 == 0 else v
    one, two = ([(i, 1, f(i, int(i % 7 == 0))) for i in range(100)] for f in (lambda i, v: v, flip))
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score(documents(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (one, two)]
    assert scores[0] == scores[1]


def test_mixing(spark, documents):
    rnd = random.Random(11)
    french = "àéèêçùœ"
    rows = [(i, _prose(rnd, rnd.randrange(20, 200)), "en") for i in range(300)] + [(1000 + i, "".join(rnd.choice(french + "ai ") for _ in range(400)), "fr") for i in range(60)] + [(5000, None, "en"), (5001, "", "fr"), (None, "and no id", "en")]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i is not None and i % 2 == 0], "doc_id long, quality int, toxic int")
    targets = {"en": 0.5, "fr": 0.5}
    got = mixing.mix(docs, labels, targets).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    tokens = {d: sum(r.rate * r.n_tokens * (r.posterior if r.domain == d else 1 - r.posterior) for r in got) for d in targets}
    assert tokens["en"] == pytest.approx(tokens["fr"], rel=5e-3)
    assert {r.domain for r in got if r.doc_id is not None and 1000 <= r.doc_id < 2000} == {"fr"}
    assert all(r.gap < 0.01 for r in got)
    clash = docs.withColumn("_key", F.lit(1)).withColumn("_copies", F.lit(2)).withColumn("_row", F.lit(3))
    mixed = mixing.mixed(clash, labels, targets=targets)
    assert mixed.columns == clash.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0), labels, targets).count() == 0
    by_source = docs.withColumn("source", F.when(F.col("lang") == "en", "web").otherwise("books"))
    other = mixing.mix(by_source, labels, {"web": 0.5, "books": 0.5}, domain_col="source").collect()
    assert {r.domain for r in other if r.doc_id is not None and 1000 <= r.doc_id < 2000} == {"books"} and other[0].gap < 0.01


def test_rates_are_a_least_squares_solution(spark):
    """Against plain projected gradient on the whole matrix, run long; one domain has no target and one target can't be met by nonnegative rates alone."""
    rng = np.random.default_rng(15)
    n, domains = 40, ["a", "b", "c"]
    t, p = rng.integers(5, 100, n).astype(float), rng.dirichlet([0.4, 0.4, 0.4], n)
    x = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(t, p)], "n_tokens double, p array<double>")
    for targets in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.7, "b": 0.3}):
        got = mixing.fit_rates(x, targets, total=600.0, domains=domains).collect()
        rates = np.array([r.rate for r in got])
        assert (rates >= 0).all()
        have = t @ p
        wanted = 600 * np.array([targets.get(d, 0.0) for d in domains])
        loss = lambda r: (((r * t) @ p - wanted) ** 2 / have).sum()
        r = np.full(n, 600 / t.sum())
        step = 0.5 / np.linalg.norm((t[:, None] * p) / np.sqrt(have), 2) ** 2
        for _ in range(20_000):
            r = np.maximum(0, r - step * 2 * t * (p @ (((r * t) @ p - wanted) / have)))
        assert loss(rates) <= loss(r) + 0.01 * (wanted**2 / have).sum()

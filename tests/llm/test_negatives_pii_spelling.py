import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.llm import hard_negatives, pii, queries, spelling

# ---- hard negatives


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, score int, anchor string")


def by_hand(rows, anchor, k=5, n=3):
    """All pairs, one by one."""
    rows = list({(i, y, tuple(v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    dot = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    out = []
    for i, y, v in rows:
        if not anchor(i):
            continue
        met = sorted(((-dot(v, w), j, z) for j, z, w in rows if j != i and len(w) == len(v)))
        for s, j, _ in [m for m in met if m[2] == y][:k]:
            fit = [m for m in met if m[2] != y and 50 * -s <= 100 * -m[0] <= 95 * -s][:n]
            out += [(i, j, r + 1, m[1], -s, -m[0]) for r, m in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block_values", [1 << 19, 1])
def test_negatives_equal_all_pairs(spark, block_values):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    rows = [(i, int(rng.integers(0, 3)) if i % 5 else 0, (centres[i % 4] + rng.normal(size=6) * 0.4).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(40)]  # ties
    rows += [rows[3], (2000, None, rows[1][2]), (2010, 1, None), (2020, 1, [1.0, None] * 3), (2030, 1, [float("nan")] * 6), (2040, 2, [float("inf")] * 6), (None, 1, rows[0][2]), (2050, 1, [0.5, 0.5]), (2060, 2, [0.4, 0.4]), (2070, 1, [0.6, 0.4]), (2080, 1, []), (2090, 1, [0.0] * 6)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, block_values=block_values)
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())
    want = by_hand(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and got == want


def test_negatives_of_nothing(spark):
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    one = vectors(spark, [(50, 1, [1.0, 0.0]), (51, 2, [1.0, 0.1])])
    assert hard_negatives.mine(one, F.col("vec_id") % 50 == 0).count() == 0  # no positive
    assert hard_negatives.mine(one, F.lit(None).cast("boolean")).count() == 0


def test_scores_are_exact():
    a, b = np.array([[2.0**40, 3.0, -1.0]]), np.array([[2.0**20, 1.0, 5.0], [2.0**62, 0.0, 0.0]])
    assert hard_negatives.scores(a, b).tolist() == [[2**60 - 2, (1 << 63) - 1]]


# ---- personal data

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _digits(s):
    return re.sub("[^0-9]", "", s)


def by_pattern(text):
    luhn = lambda d: sum((int(x) * (1 + i % 2) - 9 * (int(x) * (1 + i % 2) > 9)) for i, x in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]


def test_patterns_equal_plain_ones():
    rng, found = random.Random(2), collections.Counter()
    for _ in range(15000):
        alphabet = rng.choice(["a.@-1é ", "12. -+()", "1.2 ", "@.ab%+_", "0123456789 -"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        want = by_pattern(text)
        found.update(k for k, *_ in want)
        assert [s[:3] for s in pii.base_spans(text)] == want, text
    assert len(found) == 4
    for hard in ("a" * 10**6, "1" * 10**6, "a@" * 10**6, "+1(" * 10**6, "1." * 10**6):
        pii.base_spans(hard)  # linear: none takes long


def test_disclosing_terms_equal_counting(spark, documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6)))
    common = [word() for _ in range(60)]
    rows = [(i, " ".join(rng.choices(common, k=30)) + f" mail u{i % 9}.x@site.example.org" * (i % 3 == 0) + (" Zorblatt" if i % 9 == 0 else "") + " call +1 (555) 123-45%02d" % (i % 7) * (i % 5 == 0)) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "Zorblatt u0.x@site.example.org Zorblatt, zebra"), (203, rows[0][1]), (203, rows[0][1]), (204, "Zorblatt alone"), (205, "card 4111 1111 1111 1111 at 10.0.0.255 not 10.0.0.256")]
    got = sorted(pii.sanitise(documents(rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    docs = [t or "" for _, t in rows]
    entities = [{(k, t[a:b].lower() if k == "email" else _digits(t[a:b])) for k, a, b in by_pattern(t)} for t in docs]
    words = [{w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)} for t in docs]
    words = [w | {x[:3] + "*" for x in w} for w in words]
    n_e, n_t, both = collections.Counter(), collections.Counter(), collections.Counter()
    for e, w in zip(entities, words):
        n_e.update(e), n_t.update(w), both.update((x, y) for x in w for y in e)
    n = len(docs)
    strong = {(w, e) for (w, e), c in both.items() if c >= 3 and n_e[e] < n and c / n_t[w] >= (n_e[e] / n) ** 0.1}
    assert any(w == "zorblatt" for w, _ in strong)
    seen = 0
    order = sorted(range(n), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k, r in zip(order, got):
        i, text, e, w = rows[k][0], docs[k], entities[k], words[k]
        flagged = {x for x in w if any((x, y) in strong for y in e)}
        base = by_pattern(text)
        inside = lambda m: any(a < m.end() and m.start() < b for _, a, b in base)
        want = base + [("term", *m.span()) for m in re.finditer(r"[^\W\d_]{4,}", text) if m[0].lower() in flagged and not inside(m)]
        assert r["doc_id"] == i and [tuple(s) for s in r["spans"]] == want
        seen += len(want) - len(base)
        assert not base or not any(text[a:b] in r["sanitised"] for k, a, b in base if k == "email")
    assert seen > 10
    d = {r["doc_id"]: r for r in pii.digest(pii.sanitise(documents(rows), keep_text=False)).collect()}
    assert d[200]["base_sha256"] == hashlib.sha256(b"").hexdigest() and d[200]["spans"] == "" and d[204]["spans"] == ""
    assert (d[205]["n_card"], d[205]["n_ip"], d[205]["n_email"]) == (1, 1, 0) and d[205]["spans"] == "ip:28:38,card:5:24"


def test_personal_data_of_awkward_texts(spark, documents, awkward):
    got = pii.sanitise(documents(awkward)).collect()
    assert len(got) == len(awkward) and all(r["spans"] == [] for r in got)
    assert sorted((r["sanitised"] for r in got), key=str) == sorted(((t or "") for _, t in awkward), key=str)
    assert pii.digest(pii.sanitise(documents([]))).count() == 0
    big = pii.sanitise(documents([(2**60 + 1, "a@b.c"), (None, "x")])).collect()
    assert {r["doc_id"] for r in big} == {2**60 + 1, None}


def test_rewriting():
    text = "Call Zorblatt Quim at +1 555 123 4567 or x@y.z"
    spans = [(k, a, b) for k, a, b, _ in pii.base_spans(text)] + [("term", 5, 13), ("term", 14, 18)]
    assert pii.rewrite(text, spans, {"zorblatt", "quim", "qui*"}) == "Call zor* [TERM] at [PHONE] or [EMAIL]"


# ---- spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_counting(rows, least=7):
    low, n = {i: i + 32 for i in range(65, 91)}, collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= 2}
    out = {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, n[w], len(found))
    result = set()
    for w, (form, c, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result.add((w, form, root, c, k, n[form] if form else None))
    return result


@pytest.mark.parametrize("shard_chars", [40_000, 60])
def test_variants_equal_all_pairs(spark, documents, shard_chars):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeÉéñ") for _ in range(rng.randint(7, 12))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "abababab"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.15)), len(stems) - 1)]
            if rng.random() < 0.15:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abE") + w[at:], w[:at] + rng.choice("aé") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    rows += [(None, rows[0][1]), (3, rows[3][1]), (400, None), (401, ""), (402, "9" * 50), (403, "x" * 30_000), (404, "x" * 30_000 + " " + "x" * 29_999), (405, "x" * 29_999)]
    rows += [(500, "zzzzzzzz " * 2000 + "zzzzzzzy " * 150 + "zzzzzzxy " * 3)]  # a chain of forms
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(documents(rows), shard_chars=shard_chars).collect()}
    want = by_counting(rows)
    assert got == want and sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] for r in want if r[1])


def test_index_with_sampled_counts(monkeypatch):
    monkeypatch.setattr(spelling, "TABLE", 1)
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(150)})
    q, v = spelling.FMIndex(words).near(words, np.zeros(len(words), int))
    assert {(words[i], words[j]) for i, j in zip(q.tolist(), v.tolist())} == {(a, b) for a in words for b in words if near(a, b)}


def test_words_of_nothing(spark, documents, awkward):
    assert spelling.variants(documents([])).count() == 0
    assert spelling.variants(documents([(1, None), (2, "short ones")])).count() == 0
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(documents(awkward)).collect()}
    assert got == by_counting(awkward)


def test_queries_are_registered():
    assert {"op11_hard_negatives", "op12_pii", "op13_spelling"} <= set(queries.queries())

"""Spelling variants of a corpus' words by FM-index search schemes over shards of the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.llm.common import materialize

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_RATIO = 10  # a form is so many times as frequent as its variant
TYPO_EVERY = 31
SHARD_CHARS = 40_000  # characters of one index
HELD_WORDS = 200_000  # distinct words that a task counts before it hands them on
TABLE = 1 << 25  # counts that an index holds
QUERY_CHARS = 1 << 16
JUMPS = 6  # counts grow tenfold with each form, so a chain of longs has under 2 ** 6 links

_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def planted(doc_id: str, run: str) -> str:
    """A lower-cased run, without one code point where the digest of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % TYPO_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all documents with their numbers of occurrences; tasks hand on sums, not occurrences."""
    pattern = f"{RUN}{{{least_length},}}"  # greedy, so whole runs; shorter ones can't give a word

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, held = re.compile(pattern), Counter()

        def out() -> pd.DataFrame:
            full = pd.DataFrame({"word": list(held), "n": list(held.values())}).astype({"n": "int64"})
            held.clear()
            return full

        for pdf in batches:
            for doc, text in zip(pdf["id"], pdf["text"]):
                low: Counter = Counter()
                for raw, n in Counter(runs.findall(text)).items():
                    low[raw.lower() if raw.isascii() else raw.translate(_LOWER)] += n
                for run, n in low.items():
                    word = planted(doc, run)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
        if held:
            yield out()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class FMIndex:
    """Intervals of suffix ranks over words that end in a delimiter, read from right to left.

    Suffixes are sorted up to their word's delimiter, equal ones in the words' order, by doubling: log2 of the longest word's length sorts,
    whatever its length. Row c of `occ` counts symbol c before each rank, or before every 64th where the table would be large. Over reversed words the same index reads from left to right.
    """

    def __init__(self, words: list[str]):
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), np.uint32)
        self.symbols, text = np.unique(codes, return_inverse=True)
        n = len(text)
        ends = np.cumsum(lengths + 1) - 1
        word_of = np.repeat(np.arange(len(words)), lengths + 1)
        left = ends[word_of] - np.arange(n)  # characters before the delimiter
        rank, span, longest = text.astype(np.int64), 1, int(lengths.max(initial=0)) + 1
        while span < longest:
            beyond = np.where(left >= span, rank[np.minimum(np.arange(n) + span, n - 1)] + 1, 0)
            _, rank = np.unique(rank * (n + 2) + beyond, return_inverse=True)
            span *= 2
        order = np.argsort(rank, kind="stable")
        before = np.where(left[order] == lengths[word_of[order]], 0, text[order - 1])  # a word's first character follows a delimiter
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=len(self.symbols)))]
        self.stride = 1 if len(self.symbols) * n <= TABLE else 64
        self.occ = np.zeros((len(self.symbols), n // self.stride + 1), np.int32)
        for c in range(len(self.symbols)):
            self.occ[c, 1:] = np.cumsum(before == c)[self.stride - 1 :: self.stride]
        self.before = np.r_[before, np.full(self.stride, -1)]
        self.starts = word_of[order[before == 0]]  # words in the order of their whole suffixes
        self.words = len(words)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words as rows of symbol numbers, their last character in column 0; -1 stands for a character that the index lacks."""
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.symbols, codes), len(self.symbols) - 1)
        flat = np.where(self.symbols[at] == codes, at, -1)
        starts = np.cumsum(lengths) - lengths
        out = np.full((len(words), int(lengths.max(initial=0)) + 1), -1, np.int64)
        row = np.repeat(np.arange(len(words)), lengths)
        out[row, (lengths[row] - 1) - (np.arange(len(codes)) - starts[row])] = flat
        return out, lengths

    def count(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How often a symbol comes before the suffixes under a rank."""
        if self.stride == 1:
            return self.occ[symbol, rank]
        block, offset = rank // self.stride, np.arange(self.stride)
        rest = (self.before[block[:, None] * self.stride + offset] == symbol[:, None]) & (offset < (rank % self.stride)[:, None])
        return self.occ[symbol, block] + rest.sum(axis=1)

    def occurs(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which symbols but the delimiter come before the suffixes of each interval."""
        if self.stride == 1:
            return self.occ[1:, hi] > self.occ[1:, lo]
        return np.array([self.count(np.full(len(lo), c), hi) > self.count(np.full(len(lo), c), lo) for c in range(1, len(self.symbols))]).reshape(-1, len(lo))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the suffixes that begin with the symbol before the given ones'; empty for symbol -1."""
        known = symbol >= 0
        c = np.maximum(symbol, 0)
        return self.first[c] + self.count(c, lo), np.where(known, self.first[c] + self.count(c, hi), 0)

    def near(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers whose texts differ by one inserted, deleted or replaced code point left of the query's last `exact` ones.

        The last `exact` characters and the delimiter are read exactly; from there on every exact state branches once: it skips a character of the
        query, or reads one that the query lacks, in its place or besides. Branches then go on exactly.
        """
        p, length = self.encode(words)
        q = np.arange(len(words))
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), self.words, np.int64)  # the delimiter is symbol 0
        at = np.zeros(len(q), np.int64)  # characters read
        done_q, done_lo, done_hi = [], [], []
        b_q, b_at, b_lo, b_hi = (np.empty(0, np.int64) for _ in range(4))  # after the error

        while len(q) or len(b_q):
            if len(b_q):
                end = b_at == length[b_q]
                done_q.append(b_q[end]), done_lo.append(b_lo[end]), done_hi.append(b_hi[end])
                b_q, b_at, b_lo, b_hi = (x[~end] for x in (b_q, b_at, b_lo, b_hi))
                b_lo, b_hi = self.step(p[b_q, b_at], b_lo, b_hi)
                some = b_hi > b_lo
                b_q, b_at, b_lo, b_hi = b_q[some], b_at[some] + 1, b_lo[some], b_hi[some]
            if len(q):
                free = at >= exact[q]
                x_q, x_at, x_lo, x_hi = (x[free] for x in (q, at, lo, hi))
                if len(x_q):
                    c, i = np.nonzero(self.occurs(x_lo, x_hi))
                    c += 1
                    n_lo, n_hi = self.step(c, x_lo[i], x_hi[i])
                    more = x_at[i] < length[x_q[i]]
                    other = more & (c != p[x_q[i], x_at[i]])
                    skip = x_at < length[x_q]
                    b_q = np.concatenate([b_q, x_q[i], x_q[i][other], x_q[skip]])
                    b_at = np.concatenate([b_at, x_at[i], x_at[i][other] + 1, x_at[skip] + 1])
                    b_lo = np.concatenate([b_lo, n_lo, n_lo[other], x_lo[skip]])
                    b_hi = np.concatenate([b_hi, n_hi, n_hi[other], x_hi[skip]])
                go = at < length[q]
                q, at, lo, hi = (x[go] for x in (q, at, lo, hi))
                lo, hi = self.step(p[q, at], lo, hi)
                some = hi > lo
                q, at, lo, hi = q[some], at[some] + 1, lo[some], hi[some]
        if not done_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        f_q, f_lo, f_hi = (np.concatenate(x) for x in (done_q, done_lo, done_hi))
        f_lo, f_hi = (self.count(np.zeros(len(x), np.int64), x).astype(np.int64) for x in (f_lo, f_hi))  # ranks of whole words
        size = np.maximum(f_hi - f_lo, 0)
        query = np.repeat(f_q, size)
        rank = np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(f_lo, size)
        both = np.unique(query * np.int64(self.words) + self.starts[rank])  # several alignments can give one pair
        return both // self.words, both % self.words


def shard_near(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the queries of a shard find in its index: (word, n_near, form, form_n), the most frequent near word and its count."""
    side = bool(pdf["side"].iloc[0])
    held = pdf[pdf["indexed"]].drop_duplicates("word").sort_values("word")
    asked = pdf[pdf["asks"]]
    empty = pd.DataFrame({"word": [], "n_near": [], "form": [], "form_n": []}).astype({"word": object, "form": object, "n_near": "int64", "form_n": "int64"})
    if not len(held) or not len(asked):
        return empty
    words, counts = held["word"].tolist(), held["n"].to_numpy(np.int64)
    index = FMIndex(words if side else [w[::-1] for w in words])
    out = []
    waiting = sorted(asked["word"].tolist(), key=len, reverse=True)  # a batch is as wide as its longest word
    while waiting:
        size = max(1, QUERY_CHARS // len(waiting[0]))
        queries, waiting = waiting[:size], waiting[size:]
        half = np.array([len(w) // 2 for w in queries])
        q, v = index.near(queries if side else [w[::-1] for w in queries], half + np.array([len(w) % 2 for w in queries]) if side else half)
        if side:  # equal first halves too: the other side finds the pair
            new = np.array([words[j][: half[i]] != queries[i][: half[i]] for i, j in zip(q.tolist(), v.tolist())], bool)
            q, v = q[new], v[new]
        if len(q):
            order = np.lexsort((v, -counts[v], q))  # words are in code-point order
            first = order[np.r_[True, np.diff(q[order]) > 0]]
            found = q[first]
            out.append(pd.DataFrame({"word": [queries[i] for i in found], "n_near": np.bincount(q, minlength=len(queries))[found], "form": [words[j] for j in v[first]], "form_n": counts[v[first]]}))
    return pd.concat(out, ignore_index=True) if out else empty


def _routes() -> Column:
    """The keys of a word: the first and the last half that a query of its length, or of one more or less, has to match exactly.

    A query of length m matches its first m // 2 or its last m - m // 2 code points, so a word is indexed under two lengths for either side.
    """
    w, m = F.col("word"), F.length("word")

    def route(side: bool, half: Column, asks: Column) -> Column:
        part = F.right(w, half) if side else F.left(w, half)
        return F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side), half, part).alias("key"), asks.alias("asks"))

    first, last = F.floor(m / 2).cast("int"), F.ceil(m / 2).cast("int")
    # Odd 2j + 1 has neighbours with first halves j and j + 1, last halves j and j + 1; even 2j with j - 1 and j, and j and j + 1.
    other_first = F.when(m % 2 == 1, first + 1).otherwise(first - 1)
    other_last = F.when(m % 2 == 1, last - 1).otherwise(last + 1)
    return F.array(route(False, first, F.lit(True)), route(False, other_first, F.lit(False)), route(True, last, F.lit(True)), route(True, other_last, F.lit(False)))


def near_words(words: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(word, n_near, form, form_n) for words with near words, from (word, n).

    Keys, halves of words, are dealt into shards of about `shard_chars` characters, so that a query and all that shares its exact half meet in one
    index. A key with more is split: its words are indexed in several shards, its queries in several blocks, and each block asks each shard.
    """
    size = F.length("word") + 1
    entries = materialize(words.select("word", "n", F.explode(_routes()).alias("r")).select("word", "n", "r.*"))
    total = entries.agg(F.sum(size)).first()[0] or 1
    shards = max(1, -(-int(total) // shard_chars))
    large = entries.groupBy("side", "key").agg(F.ceil(F.sum(size) / shard_chars).alias("parts")).where("parts > 1")
    e = entries.join(large, ["side", "key"], "left")
    whole = F.col("parts").isNull()
    own = F.pmod(F.xxhash64("word", F.lit(7)), F.coalesce("parts", F.lit(1))).cast("int")
    count = F.coalesce("parts", F.lit(1)).cast("int") - 1
    place = lambda part, block, indexed, asks: F.struct(part.alias("part"), block.alias("block"), indexed.alias("indexed"), asks.alias("asks"))
    one = F.array(place(F.lit(-1), F.lit(-1), F.lit(True), F.col("asks")))
    held = F.transform(F.sequence(F.lit(0), count), lambda j: place(own, j, F.lit(True), F.col("asks") & (j == own)))
    rest = F.transform(F.filter(F.sequence(F.lit(0), count), lambda i: F.col("asks") & (i != own)), lambda i: place(i, own, F.lit(False), F.lit(True)))
    at = e.select("word", "n", "side", "key", whole.alias("whole"), F.explode(F.when(whole, one).otherwise(F.concat(held, rest))).alias("p")).select("word", "n", "side", "key", "whole", "p.*")
    shard = F.when(F.col("whole"), F.pmod("key", F.lit(shards))).otherwise(F.col("key"))
    found = at.withColumn("shard", shard).groupBy("side", "whole", "shard", "part", "block").applyInPandas(shard_near, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Words of all texts with their nearest frequent form: (word, form, root, n, n_near, form_n), a row for each word.

    Words are runs of Latin letters, A-Z lower-cased, with planted slips (`planted`). A word's form is the most frequent word at one edit, ties by
    code points, if it is `ratio` times as frequent; the root is the end of the chain of forms, found by pointer jumping.

    Null texts have no words; the slips of a document with a null id are drawn with an empty one. Repeated rows count as documents of their own. A run
    of any length is one word. No words, no rows. Other columns aren't read.
    """
    words = materialize(vocabulary(docs, id_col, text_col, least_length, least_count))
    found = words.join(near_words(words, shard_chars), "word", "left")
    fits = F.col("form_n") >= F.col("n") * ratio
    table = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    jump = table.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(JUMPS):
        beyond = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(jump.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jump = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return table.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

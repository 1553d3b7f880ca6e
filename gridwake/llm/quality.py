"""Quality filter: an interpolated modified Kneser-Ney model of the letters and shapes of trusted text.

Text is read twice: as its letters, without case and with all digits alike, and as the shapes of its words with runs of
punctuation, line ends and a mark for a word that repeats the one before. Letters tell gibberish in any word, seen or not; shapes tell
layout and repetition. The n-grams of all trusted documents are counted, smoothed and joined across orders in Spark. In logarithms the
model is a sum of one weight for each n-gram: the most frequent n-grams, HOT_KEYS at most, are looked up in the map tasks, and a
document's counts of the others are joined with their weights. A filter of fixed size keeps back n-grams that the model doesn't hold.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.llm.common import held, materialize

ORDER = 5
HOT_KEYS = 600_000  # n-grams whose weights are sent to the scoring tasks
QUANTILE = 0.99
MARGIN = 1.1
SHAPE_MARGIN = 1.25
PRIOR_SYMBOLS = 200  # weight of the language's mean in a document's score
PRIOR_SHAPES = 40
BROADCAST_IDS = 1_000_000  # of trusted documents, up to which texts aren't shuffled to meet them
FILTER_BITS = 1 << 25  # of the filter that tells n-grams which aren't in the model, whatever its size
CHUNK_CHARS = 200_000  # read at once in a task; a longer text is read in parts of that length, each as a text
CALIBRATION = 4  # one trusted document in so many sets the thresholds and teaches nothing
LONG_WORD = 16

_PAD, _END = 1, 2
_SHAPES = "\0shapes"  # what follows the name of a language for its model of shapes
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
# Kinds of characters: a letter's case, digits, blanks, line ends and other marks.
_LOWER, _UPPER, _OTHER, _DIGIT, _BLANK, _LINE, _MARK = range(1, 8)
_AGAIN = 9


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hashed(x: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """Spark's xxhash64 of a long column; that of several columns takes the hash of those before as its seed."""
    h = np.asarray(seed).astype(np.int64).view(np.uint64) + _P5 + np.uint64(8)
    h = _rotated(h ^ (_rotated(x.astype(np.int64).view(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def model_code(name: str) -> int:
    """64 bits for the model of a language's letters or shapes."""
    return int.from_bytes(blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _kinds() -> np.ndarray:
    """The kind of each code point; a worker keeps the table."""

    def make() -> np.ndarray:
        kind = {"Ll": _LOWER, "Lu": _UPPER, "Lt": _UPPER, "Nd": _DIGIT, "Nl": _DIGIT, "No": _DIGIT, "Zs": _BLANK}
        letters = {"Lm", "Lo", "Mn", "Mc"}
        of = lambda c: kind.get(c, _OTHER if c in letters else _MARK)
        table = np.fromiter((of(unicodedata.category(chr(i))) for i in range(0x110000)), np.uint8, 0x110000)
        table[[9, 11, 12, 13]], table[[10, 0x85, 0x2028, 0x2029]] = _BLANK, _LINE
        return table

    return held("kinds of characters", make)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts in a row, and the text of each."""
    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.repeat(np.arange(len(texts)), size)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the first reading and the text of each: code points in lower case, digits as 0, white space as one blank or line end."""
    x, row = _points([t.lower() for t in texts])
    kind = _kinds()[x]
    x = np.where(kind == _DIGIT, ord("0"), np.where(kind == _BLANK, ord(" "), np.where(kind == _LINE, ord("\n"), x)))
    space = (kind == _BLANK) | (kind == _LINE)
    keep = np.ones(len(x), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    return x[keep], row[keep]


def shapes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the second reading: a run of one kind of letters (long or not), of digits, line ends or one mark (once to four times).

    A word that equals the one before it is one symbol.
    """
    x, row = _points(texts)
    if not len(x):
        return x, row
    kind = _kinds()[x].astype(np.int64)
    same = np.where(kind == _MARK, 16 + x, kind)
    start = np.flatnonzero(np.r_[True, (same[1:] != same[:-1]) | (row[1:] != row[:-1])])
    size = np.diff(np.r_[start, len(x)])
    k = kind[start]
    symbol = np.where(k == _MARK, 8 * same[start] + np.minimum(size, 4), 8 * k + (np.isin(k, (_LOWER, _UPPER, _OTHER)) & (size > LONG_WORD)))
    # Words are runs of letters and digits; each is told by the sum of its characters' hashes with their places.
    in_word = kind <= _DIGIT
    first = in_word & np.r_[True, ~in_word[:-1] | (row[1:] != row[:-1])]
    word = np.cumsum(first) - 1
    begins = np.flatnonzero(first)
    if len(begins):
        own = word[in_word]
        values = hashed(x[in_word], np.flatnonzero(in_word) - begins[own])
        total = np.add.reduceat(values, np.searchsorted(own, np.arange(len(begins))))
        again = np.r_[False, (total[1:] == total[:-1]) & (row[begins[1:]] == row[begins[:-1]])]
        repeated = in_word[start] & again[np.maximum(word[start], 0)]
        symbol = np.where(repeated, 8 * _AGAIN, symbol)
        keep = (k != _BLANK) & ~(repeated & ~first[start])
    else:
        keep = k != _BLANK
    return symbol[keep], row[start][keep]


def _framed(x: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with ORDER - 1 pads before and an end after each text that has any."""
    n = np.bincount(row, minlength=rows)
    full = np.where(n > 0, n + ORDER, 0)
    out = np.full(int(full.sum()), _PAD, np.int64)
    owner = np.repeat(np.arange(rows), full)
    past = np.cumsum(full)
    out[np.arange(len(x)) + (past - full - (np.cumsum(n) - n))[row] + ORDER - 1] = x
    out[past[n > 0] - 1] = _END
    return out, owner


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, list], int, np.ndarray, np.ndarray, np.ndarray]]:
    """(the texts' other columns, reading, models, symbols, row of each symbol) of some texts at a time, once for each reading; `part` counts a long text's parts."""

    def read(held: dict[str, list]):
        for reading, f in enumerate((letters, shapes)):
            x, row = _framed(*f(held["text"]), len(held["text"]))
            yield held, reading, np.array([model_code(lang + _SHAPES * reading) for lang in held["lang"]], np.int64), x, row

    held, size = {}, 0
    for batch in batches:
        for doc in batch.to_pylist():
            whole = doc["text"]
            for part, i in enumerate(range(0, max(1, len(whole)), CHUNK_CHARS)):
                for name, value in (doc | {"text": whole[i : i + CHUNK_CHARS], "part": part}).items():
                    held.setdefault(name, []).append(value)
                size += len(held["text"][-1])
                if size >= CHUNK_CHARS:
                    yield from read(held)
                    held, size = {}, 0
    if held:
        yield from read(held)


def _sets_thresholds(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(CALIBRATION)) == 0


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All trusted documents but those that set the thresholds."""
    good = labels.where("quality = 1").where(~_sets_thresholds(F.col("doc_id"))).select("doc_id").distinct()
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    return _text(docs).join(good, "doc_id", "left_semi").select("lang", "text")


def _columns(n: int) -> list[str]:
    """An n-gram's columns, the newest symbol first."""
    return [f"s{i}" for i in range(n)]


def _pack(low, high):
    """Two symbols in one number; for arrays and for Spark's columns."""
    if isinstance(low, Column):
        return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))
    return high << 32 | low


def _keys(model: np.ndarray, newest: list[np.ndarray]) -> list[np.ndarray]:
    """The keys of the n-grams of 1, 2, ... symbols; an n-gram is hashed in pairs of symbols from the newest."""
    out = []
    for i, x in enumerate(newest):
        if i % 2:
            model = hashed(_pack(newest[i - 1], x), model)
            out.append(model)
        else:
            out.append(hashed(x, model))
    return out


def _key(model: Column, symbols: list[Column]) -> Column:
    """The same key of one n-gram in Spark."""
    pairs = [_pack(symbols[i], symbols[i + 1]) for i in range(0, len(symbols) - 1, 2)]
    return F.xxhash64(model, *pairs, *[c.cast("long") for c in symbols[len(symbols) // 2 * 2 :]])


def _as_context(model):
    """What stands for the model in the keys of contexts."""
    return F.bitwise_not(model) if isinstance(model, Column) else ~model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, models, x, row in _chunks(batches):
        at = np.flatnonzero(row[ORDER - 1 :] == row[: 1 - ORDER]) + ORDER - 1
        key = _keys(hashed(models)[row[at]], [x[at - i] for i in range(ORDER)])[-1]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        yield pa.RecordBatch.from_arrays([pa.array(models[row[at]]), *(pa.array(x[at - i].astype(np.int32)) for i in range(ORDER)), pa.array(n.astype(np.int64))], names=["model", *_columns(ORDER), "c"])


def _smoothed(grams: DataFrame, n: int, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One order of modified Kneser-Ney: (model, s0, *context, c, p, weight) and (model, *context, c, gamma).

    The weight is the logarithm of p over what the n-gram would have if it weren't counted, gamma times the lower order's p.

    grams has (model, s0, *context, c). The three discounts of each model come from its counts of counts.
    """
    context = _columns(n)[1:]
    stats = grams.groupBy("model").agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))

    def discount(i: int) -> Column:
        d = i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1))
        return F.least(F.greatest(d, F.lit(0.1)), F.lit(i - 0.1)).alias(f"d{i}")

    d = F.broadcast(stats.select("model", discount(1), discount(2), discount(3)))  # two rows for each language
    taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    keys = ["model", *context]
    x = grams.join(d, "model").select(*keys, "s0", "c", taken.alias("_d"))
    sums = x.groupBy(*keys).agg(F.sum("c").alias("_total"), (F.sum("_d") / F.sum("c")).alias("gamma"))
    if context:
        sums = materialize(sums)
    own = x.join(sums, keys).withColumn("_own", (F.col("c") - F.col("_d")) / F.col("_total"))
    if lower is None:
        vocabulary = grams.groupBy("model").agg((F.count("*") + 1).alias("_v"))
        p = own.join(F.broadcast(vocabulary), "model").withColumn("_p", 1 / F.col("_v"))
    else:
        p = own.join(lower.select("model", *_columns(n - 1), F.col("p").alias("_p")), ["model", *_columns(n - 1)])
    below = F.col("gamma") * F.col("_p")
    return p.select(*keys, "s0", "c", (F.col("_own") + below).alias("p"), F.log1p(F.col("_own") / below).alias("weight")), sums.select(*keys, F.col("_total").alias("c"), "gamma")


class Model:
    """The smoothed tables of all orders, and the weights of their n-grams."""

    def __init__(self, tables: list[tuple[DataFrame, DataFrame]]) -> None:
        self.tables = tables

    @cached_property
    def unseen(self) -> dict[int, float]:
        """Logarithm of the probability of a symbol without any count, by model."""
        p, g = self.tables[0]
        v = p.groupBy("model").agg((F.count("*") + 1).alias("_v"))
        return {r["model"]: float(r["x"]) for r in v.join(g, "model").select("model", F.log(F.col("gamma") / F.col("_v")).alias("x")).collect()}  # two rows for each language

    @cached_property
    def weights(self) -> DataFrame:
        """(key, c, weight, log_p): what an n-gram adds, as an n-gram and as a context under another key, and the whole log probability of the longest."""
        out = None
        for n, (p, g) in enumerate(self.tables, 1):
            log_p = F.log("p") if n == ORDER else F.lit(None).cast("double")
            parts = [p.select(_key(F.col("model"), [F.col(c) for c in _columns(n)]).alias("key"), F.col("c").cast("long").alias("c"), "weight", log_p.alias("log_p"))]
            if n > 1:
                own = _key(_as_context(F.col("model")), [F.col(c) for c in _columns(n)[1:]])
                parts.append(g.select(own.alias("key"), F.col("c").cast("long").alias("c"), F.log("gamma").alias("weight"), F.lit(None).cast("double").alias("log_p")))
            for x in parts:
                out = x if out is None else out.unionByName(x)
        return materialize(out)

    def hot(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, weights and log probabilities of the most frequent n-grams, some HOT_KEYS; the last is NaN but for the longest."""
        share = min(1.0, HOT_KEYS / max(1, self.weights.count()))
        least = 0 if share == 1.0 else self.weights.agg(F.percentile_approx("c", 1 - share, 1000)).first()[0]
        t = self.weights.where(F.col("c") > least).select("key", "weight", "log_p").toArrow()
        return tuple(t.column(c).to_numpy() for c in ("key", "weight", "log_p"))


    def filter(self) -> np.ndarray:
        """A bit for each key of the model, by its lowest bits: FILTER_BITS / 8 bytes, put together in parts by Spark."""
        part = 1 << 19  # bits

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(FILTER_BITS, bool)
            for batch in batches:
                own[batch.column(0).to_numpy() & (FILTER_BITS - 1)] = True
            packed = [np.packbits(own[i : i + part]).tobytes() for i in range(0, FILTER_BITS, part)]
            some = [i for i, x in enumerate(packed) if any(x)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[i] for i in some], pa.binary())], names=["part", "bits"])

        def either(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [key[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]]).tobytes()]})

        out = np.zeros(FILTER_BITS // 8, np.uint8)
        # Few tasks, each with bits of its own; the parts that come to the driver are FILTER_BITS in all.
        for r in self.weights.select("key").coalesce(64).mapInArrow(bits, "part int, bits binary").groupBy("part").applyInPandas(either, "part int, bits binary").collect():
            out[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the model on the trusted documents (labels.quality = 1), without those that set the thresholds."""
    schema = "model long, " + ", ".join(f"{c} int" for c in _columns(ORDER)) + ", c long"
    grams = {ORDER: materialize(_trusted(docs, labels).mapInArrow(_counted, schema).groupBy("model", *_columns(ORDER)).agg(F.sum("c").alias("c")))}
    for n in range(ORDER - 1, 0, -1):
        grams[n] = materialize(grams[n + 1].groupBy("model", *_columns(n)).agg(F.count("*").alias("c")))
    tables, lower = [], None
    for n in range(1, ORDER + 1):
        p, g = _smoothed(grams[n], n, lower)
        lower = materialize(p)
        tables.append((lower, g))
    return Model(tables)


class Lookup:
    """An open hash table from keys to weights; 0 where a key is missing."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.weights = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits)
        self.used = np.zeros(1 << self.bits, bool)
        slot = self._slot(keys)
        while len(keys):
            free = ~self.used[slot]
            self.keys[slot[free]] = keys[free]  # of several keys at one slot the last stays
            done = free & (self.keys[slot] == keys)
            self.weights[slot[done]], self.used[slot[done]] = weights[done], True
            keys, weights, slot = keys[~done], weights[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights, and which keys were found."""
        slot = self._slot(keys)
        found = self.keys[slot] == keys
        out = np.where(found, self.weights[slot], 0.0)
        left = np.flatnonzero(~found & self.used[slot])
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[left]] == keys[left]
            out[left[hit]], found[left[hit]] = self.weights[slot[left[hit]]], True
            left = left[~hit & self.used[slot[left]]]
        return out, found & self.used[slot]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, n_symbols, surprise, n_shapes, shape_surprise) of whole texts, a row for each row. Surprise is the negative log probability, the text's end included.

    A task adds up the weights of frequent n-grams itself and hands on the counts of the others, which meet theirs in a join.
    """
    # HOT_KEYS * 24 bytes and the filter, at most.
    sent = docs.sparkSession.sparkContext.broadcast((*model.hot(), model.filter(), model.unseen))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, log_p, bits, unseen = sent.value
        longest = ~np.isnan(log_p)
        whole, table = Lookup(keys[longest], log_p[longest]), Lookup(keys[~longest], weights[~longest])
        for texts, reading, models, x, row in _chunks(batches):
            h1, h2 = (np.array(texts[c], np.int64) for c in ("h1", "h2"))
            known = np.array([m in unseen for m in models.tolist()], bool)
            lost = np.array([unseen.get(m, 0.0) for m in models.tolist()])
            own, as_context = hashed(models), hashed(_as_context(models))
            at = np.arange(ORDER - 1, len(x))
            at = at[(row[at] == row[at - ORDER + 1]) & known[row[at]]]
            doc = row[at]
            n = np.bincount(doc, minlength=len(h1))
            key = own[doc]
            for i in range(0, ORDER - 1, 2):
                key = hashed(_pack(x[at - i], x[at - i - 1]), key)
            key = hashed(x[at - ORDER + 1], key) if ORDER % 2 else key
            value, found = whole.find(key)
            base = np.bincount(doc, value, len(h1))
            # Where the longest n-gram isn't among the frequent ones, all orders add up.
            at, doc, key = at[~found], doc[~found], key[~found]
            base = base + np.bincount(doc, lost[doc], len(h1))
            parts = _keys(own[doc], [x[at - i] for i in range(ORDER - 1)]) + _keys(as_context[doc], [x[at - i] for i in range(1, ORDER)])
            rest_key, rest_doc = [key], [doc]
            for k in parts:
                value, found = table.find(k)
                base = base + np.bincount(doc, value, len(h1))
                rest_key.append(k[~found])
                rest_doc.append(doc[~found])
            key, doc = np.concatenate(rest_key), np.concatenate(rest_doc)
            low = key & (FILTER_BITS - 1)
            held = (bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1).astype(bool)
            key, doc = key[held], doc[held]
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(key)])
            # A row for each text comes first, with a key that spreads them, no times and its names; the others have its counted n-grams.
            rest = len(first)
            named = [reading == 0 and part == 0 for part in texts["part"]]
            own = {"copies": pa.array([int(x) for x in named], pa.int64())} | {c: pa.array([v if x else None for v, x in zip(texts[c], named)], pa.string()) for c in ("doc_id", "lang")}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[h1, h1[doc[first]]]), pa.array(np.r_[h2, h2[doc[first]]]), pa.array(np.full(len(h1) + rest, reading, np.int32)), pa.array(np.r_[hashed(h1), key[first]]), pa.array(np.r_[np.zeros(len(h1), np.int32), times.astype(np.int32)]),
                    pa.array(np.r_[n, np.zeros(rest, np.int64)]), pa.array(np.r_[base, np.zeros(rest)]), *(pa.concat_arrays([x, pa.nulls(rest, x.type)]) for x in own.values()),
                ],
                names=["h1", "h2", "reading", "key", "times", "n", "base", *own],
            )

    # A row is known by two digests of all that its result depends on, the same whenever and wherever a task computes them.
    doc_id = F.col("doc_id").cast("string")
    known_by = [F.xxhash64(F.lit(seed), F.coalesce(doc_id, F.lit("null")), "lang", "text").alias(h) for seed, h in ((1, "h1"), (2, "h2"))]
    rows = _text(docs).select(*known_by, doc_id.alias("doc_id"), "lang", "text").mapInArrow(grams, "h1 long, h2 long, reading int, key long, times int, n long, base double, copies long, doc_id string, lang string")
    value = F.col("base") + F.col("times") * F.coalesce("weight", F.lit(0.0))
    # A text's own row has no times, so a weight that met its key by chance adds nothing.
    of_shapes = F.col("reading") == 1
    copies = F.sum("copies")  # repeated rows add up in one group and share its sums

    def share(x: Column) -> Column:
        return F.sum(x) / copies

    sums = rows.join(model.weights.select("key", "weight"), "key", "left").groupBy("h1", "h2").agg(
        F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), copies.alias("copies"), share(F.when(of_shapes, 0).otherwise(F.col("n"))).cast("long").alias("n_symbols"), (-share(F.when(of_shapes, 0.0).otherwise(value))).alias("surprise"),
        share(F.when(of_shapes, F.col("n")).otherwise(0)).cast("long").alias("n_shapes"), (-share(F.when(of_shapes, value).otherwise(0.0))).alias("shape_surprise"),
    )
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "lang", "n_symbols", "surprise", "n_shapes", "shape_surprise")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, shape_margin: float = SHAPE_MARGIN) -> DataFrame:
    """Perplexity of every document and whether it is kept: (doc_id, lang, n_symbols, perplexity, threshold, shape_perplexity, shape_threshold, keep).

    A document's mean surprise is drawn towards that of its language's trusted documents by PRIOR_SYMBOLS symbols, so that a few
    symbols decide nothing. It is rejected where the perplexity of its letters or of its shapes is over its language's threshold: the given
    quantile over all trusted documents that had no part in the fit, times margin. Empty and null texts, and languages without trusted
    documents, are kept with the language's mean (perplexity 1 where there is none). Repeated rows and null ids give a row each.
    """
    margins = {"": margin, "shape_": shape_margin}
    scored = materialize(scores(docs, fit(docs, labels)))
    good = scored.where(_sets_thresholds(F.col("doc_id"))).join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    readings = (("", "surprise", "n_symbols", PRIOR_SYMBOLS), ("shape_", "shape_surprise", "n_shapes", PRIOR_SHAPES))
    mean = good.groupBy("lang").agg(*((F.sum(s) / F.greatest(F.sum(n), F.lit(1))).alias(f"_{r}mean") for r, s, n, _ in readings))
    drawn = {r: F.exp((F.col(s) + prior * F.coalesce(f"_{r}mean", F.lit(0.0))) / (F.col(n) + prior)) for r, s, n, prior in readings}
    level = good.join(F.broadcast(mean), "lang").groupBy("lang").agg(*(F.percentile_approx(drawn[r], quantile, 10000).alias(f"_{r}q") for r, *_ in readings))
    x = scored.join(F.broadcast(mean), "lang", "left").join(F.broadcast(level), "lang", "left")  # a row for each language
    for r, *_ in readings:
        x = x.withColumn(f"{r}perplexity", drawn[r]).withColumn(f"{r}threshold", margins[r] * F.col(f"_{r}q"))
    keep = F.coalesce((F.col("perplexity") <= F.col("threshold")) & (F.col("shape_perplexity") <= F.col("shape_threshold")), F.lit(True))
    return x.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "shape_perplexity", "shape_threshold", keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents without the rejected ones. Rows with a null doc_id stay; a doc_id goes if any of its rows is rejected."""
    gone = classify(docs, labels, **settings).where(~F.col("keep")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

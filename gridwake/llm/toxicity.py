"""Toxicity by compression distance between zstandard dictionaries trained on toxic and on ordinary text.

A window of text is one word, written in fixed-length codes: one of the word's first letters and one of the whole word. Equal words
then share long runs of bytes and different words none, so that the length a window compresses to tells whether a dictionary
knows it; on plain text, chance syllables match in either dictionary. Each kind of text trains several dictionaries on parts of its
own: a word counts as known to toxic text if all of its dictionaries know it, and as known to ordinary text if one does.
A document's evidence is how much shorter its distinct windows come out under the toxic dictionaries; logistic calibration on training
rows that had no part in the dictionaries used turns it into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.llm.common import held, materialize

TOXIC_ROWS = 3000  # labelled rows of either kind that are used for training
ORDINARY_ROWS = 6000
STEM = 4
LEVEL = 3
PARTS = {0: 16, 1: 2}  # dictionaries of either kind
DICTIONARY_BYTES = {0: 32_768, 1: 16_384}
MISS_COST = 4.0  # a toxic document that passes weighs as much as so many clean ones rejected
GAIN = 2  # bytes by which a window must be shorter to count
WINDOWS_KEPT = 150_000

_WORD = re.compile(r"\w+")


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels are never read."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def code(unit: str) -> bytes:
    return xxhash.xxh3_128_digest(unit)


def units(word: str) -> tuple[str, str]:
    return word[:STEM] + "~", word


def trained(texts: Iterable[str], size: int) -> bytes | None:
    """A dictionary trained on the coded words of some texts; None if they are too few to train one.

    A word that follows the same word as in an earlier text is left out, so that copies and repeated passages count once.
    """
    seen, samples = set(), []
    for text in texts:
        words = _WORD.findall(text.lower())
        new = []
        for pair in dict.fromkeys(zip(["", *words], words)):
            h = xxhash.xxh3_64_intdigest("\n".join(pair))
            if h not in seen:
                seen.add(h)
                new.append(pair[1])
        if new:
            samples.append(b"".join(map(code, dict.fromkeys(u for w in new for u in units(w)))))
    try:
        return zstandard.train_dictionary(size, samples, k=len(code("")), d=8).as_bytes()
    except zstandard.ZstdError:
        return None


class Distance:
    """How much shorter a window is under the toxic dictionaries than under the ordinary ones."""

    def __init__(self, ordinary: list[bytes], toxic: list[bytes], level: int = LEVEL) -> None:
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=level)
            return zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False, write_checksum=False)

        self.ordinary, self.toxic = list(map(compressor, ordinary)), list(map(compressor, toxic))
        self.kept: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.unknown = max((len(c.compress(code("\0"))) for c in self.toxic), default=0)  # of a window that no dictionary knows

    def _gain(self, unit: str) -> int:
        window = code(unit)
        longest = 0
        for c in self.toxic:
            longest = max(longest, len(c.compress(window)))
            if longest + GAIN >= self.unknown:
                return 0
        gain = min((len(c.compress(window)) for c in self.ordinary), default=self.unknown) - longest
        return gain if gain > GAIN else 0

    def gain(self, word: str) -> int:
        """Bytes gained by the codes of a word, each if it gains more than GAIN."""
        got = self.kept.get(word)
        if got is None:
            for table in (self.kept, self.stems):
                if len(table) > WINDOWS_KEPT:
                    table.clear()
            stem, whole = units(word)
            if stem not in self.stems:
                self.stems[stem] = self._gain(stem)
            got = self.kept[word] = self.stems[stem] + self._gain(whole)
        return got

    def evidence(self, text: str) -> float:
        """Bytes gained by the distinct windows, over the root of their number; 0 for an empty text."""
        found = set(_WORD.findall(text.lower()))
        return sum(map(self.gain, found)) / math.sqrt(len(found) + 10) if self.toxic else 0.0


def _distance(contents: tuple[list[bytes], list[bytes]]) -> Distance:
    key = xxhash.xxh3_128_digest(b"".join(contents[0] + contents[1]))
    return held(("distance", key), lambda: Distance(*contents))


def _training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int, ordinary_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded, reproducible sample (doc_id, text, toxic, fold) of the rows not held out, and the labels' numbers by kind."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    most = {0: ordinary_rows, 1: toxic_rows}
    picked = None
    for kind in (0, 1):
        # An even cut on a hash leaves about twice the rows wanted; only they are sorted.
        share = min(1.0, 2.0 * most[kind] / max(1, sizes.get(kind, 0)))
        few = known.where((F.col("toxic") == kind) & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) <= share * (1 << 30)))
        few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[kind])  # each task keeps that many at most
        picked = few if picked is None else picked.union(few)
    picked = materialize(picked)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # toxic_rows + ordinary_rows at most
    return materialize(rows.withColumn("fold", F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string")) / 5), F.lit(2)).cast("int"))), sizes


def _dictionaries(rows: DataFrame) -> dict[int, tuple[list[bytes], list[bytes]]]:
    """Ordinary and toxic dictionaries from fold 0, fold 1 and both (2). Each is trained in a task on a part of the sampled rows."""
    x = rows.withColumn("fold", F.explode(F.array("fold", F.lit(2))))
    parts = F.when(F.col("toxic") == 1, PARTS[1]).otherwise(PARTS[0])
    x = x.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), parts).cast("int"))

    def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fold, toxic, _ = key
        return pd.DataFrame({"fold": [fold], "toxic": [toxic], "content": [trained(pdf.sort_values(["doc_id", "text"])["text"], DICTIONARY_BYTES[toxic])]})

    # At most 3 * (PARTS[0] + PARTS[1]) rows of DICTIONARY_BYTES come to the driver.
    got = x.select("fold", "toxic", "part", "doc_id", "text").groupBy("fold", "toxic", "part").applyInPandas(train, "fold int, toxic int, content binary").where("content is not null").collect()
    own = lambda fold, toxic: sorted(bytes(r["content"]) for r in got if (r["fold"], r["toxic"]) == (fold, toxic))
    return {fold: (own(fold, 0), own(fold, 1)) for fold in (0, 1, 2)}


def _evidence(rows: DataFrame, contents: tuple[list[bytes], list[bytes]], keep: list[str]) -> DataFrame:
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", evidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = _distance(contents)
        for pdf in batches:
            yield pdf[keep].assign(evidence=np.array([d.evidence(t) for t in pdf["text"]], np.float64))

    return rows.mapInPandas(run, schema)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a weak penalty on the slope."""
    a = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.array([0.0, math.log((weight[y == 1].sum() + 1) / (weight[y == 0].sum() + 1))]), np.diag([0.05, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty, a.T @ (weight * (y - p)) - penalty @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> tuple[tuple[list[bytes], list[bytes]], float, float]:
    """Dictionaries and calibration from at most toxic_rows + ordinary_rows labelled rows, none of them held out."""
    rows, sizes = _training_rows(docs, labels, toxic_rows, ordinary_rows)
    dictionaries = _dictionaries(rows)
    n = {k: max(1, min(sizes.get(k, 0), m)) for k, m in ((0, ordinary_rows), (1, toxic_rows))}
    # The evidence of a row comes from dictionaries that it had no part in; two numbers for each sampled row.
    got = [_evidence(rows.where(F.col("fold") != fold), dictionaries[fold], ["toxic"]).toPandas() for fold in (0, 1)]
    seen = pd.concat(got, ignore_index=True)
    y = seen["toxic"].to_numpy(np.float64)
    weight = np.where(y == 1, MISS_COST * sizes.get(1, 0) / n[1], sizes.get(0, 0) / n[0])
    slope, intercept = _logistic(seen["evidence"].to_numpy(), y, weight) if len(seen) else (0.0, -30.0)
    return dictionaries[2], slope, intercept


def score(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> DataFrame:
    """Score every whole text: (doc_id, held_out, score, predicted), a row for each row of docs, without a shuffle of texts.

    Only the text enters a score. Null and empty texts have no evidence and get the lowest score. A null doc_id is not held out. Repeated
    rows get equal scores. Without labelled rows of both kinds nothing is predicted; an empty table gives no rows.
    """
    contents, slope, intercept = fit(docs, labels, toxic_rows, ordinary_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    x = _evidence(rows, contents, ["doc_id"]).withColumn("score", 1 / (1 + F.exp(-(F.lit(slope) * F.col("evidence") + F.lit(intercept)))))
    return x.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> DataFrame:
    """The documents that aren't predicted to be toxic, with all their columns. Each batch is filtered where it is read."""
    contents, slope, intercept = fit(docs, labels, toxic_rows, ordinary_rows)

    def keep(batches: Iterator) -> Iterator:
        d = _distance(contents)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([slope * d.evidence(t.as_py() or "") + intercept < 0 for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

"""Hard negatives for anchors by slot-decomposed selection on integer inner products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.llm.common import materialize, numbered

POSITIVES = 5
NEGATIVES = 3
LOWEST, HIGHEST = 50, 95  # per cent of the positive's score that a negative's may have
SCALE = 256
BLOCK_VALUES = 1 << 17  # components in a block of rows
ANCHOR_BLOCKS = 4  # a block of anchors is so many times as large, as the rows are copied for each of those
SLICE = 1 << 20  # scores at a time
_LONG = (1 << 63) - 1


def whole(rows: list) -> np.ndarray:
    """floor(SCALE * x) of each component in double precision."""
    return np.floor(np.array([np.asarray(x, np.float64) for x in rows]).reshape(len(rows), -1) * SCALE)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as longs: by doubles where no sum can leave 53 bits, else by whole numbers without limit, which stop at the longs' limits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 1 << 53:
        return (a @ b.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.array([[max(-_LONG, min(_LONG, x)) for x in r] for r in big], np.int64).reshape(len(a), len(b))


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each group by falling score, then by rising id."""
    order = np.lexsort((ids, ~score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]


def _meet(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
    """Anchors, rows and their scores in slices, for each length of vectors by itself."""
    by_width = dict(list(rows.groupby(rows["embedding"].map(len))))
    for width, own in anchors.groupby(anchors["embedding"].map(len)):
        if width in by_width:
            met = by_width[width]
            b = whole(met["embedding"].tolist())
            step = max(1, SLICE // len(met))
            for i in range(0, len(own), step):
                part = own.iloc[i : i + step]
                yield part, met, scores(whole(part["embedding"].tolist()), b)


def block_positives(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k other rows of the anchor's label in a block: (anchor, vec_id, score)."""
    out = []
    for a, b, s in _meet(anchors, rows):
        fit = (a["label"].to_numpy()[:, None] == b["label"].to_numpy()) & (a["anchor_id"].to_numpy()[:, None] != b["vec_id"].to_numpy())
        if s.shape[1] > k:  # ties with the k-th stay until the ids decide
            masked = np.where(fit, s, -_LONG - 1)
            fit &= s >= -np.partition(-masked.clip(-_LONG), k - 1, axis=1)[:, k - 1 : k]
        i, j = np.nonzero(fit)
        keep = _first(i, s[i, j], b["vec_id"].to_numpy()[j], k)
        out.append(pd.DataFrame({"anchor": a["anchor"].to_numpy()[i[keep]], "vec_id": b["vec_id"].to_numpy()[j[keep]], "score": s[i[keep], j[keep]]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"anchor": [], "vec_id": [], "score": []}, dtype="int64")


def block_slots(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k rows of other labels in each of the anchor's slots, from one block: (anchor, slot, vec_id, score).

    An anchor has rising upper limits; slot t holds scores over limit t - 1 up to limit t. Only its own positive's window can begin in it, so
    what lies under that window's lower end is of no use to any.
    """
    out = []
    for a, b, s in _meet(anchors, rows):
        width = max(len(x) for x in a["limits"])
        limits = np.array([[*x, *[-1] * (width - len(x))] for x in a["limits"]], np.int64)
        lows = np.array([[*x, *[0] * (width - len(x))] for x in a["lows"]], np.int64)
        held = np.array([len(x) for x in a["limits"]])
        i, j = np.nonzero((s >= lows[:, :1]) & (s <= limits.max(axis=1)[:, None]) & (a["label"].to_numpy()[:, None] != b["label"].to_numpy()))
        score = s[i, j]
        slot = ((limits[i] < score[:, None]) & (np.arange(width) < held[i][:, None])).sum(axis=1)
        use = score >= lows[i, slot]
        i, j, score, slot = i[use], j[use], score[use], slot[use]
        ids = b["vec_id"].to_numpy()[j]
        keep = _first(i * width + slot, score, ids, k)
        out.append(pd.DataFrame({"anchor": a["anchor"].to_numpy()[i[keep]], "slot": slot[keep], "vec_id": ids[keep], "score": score[keep]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"anchor": [], "slot": [], "vec_id": [], "score": []}, dtype="int64")


def _blocks(df: DataFrame, id_col: str, size: int, name: str) -> DataFrame:
    """df dealt into blocks of `size` rows in the order of label and id, so that a block holds few labels and a frequent label many blocks."""
    return materialize(numbered(df, [F.col("label"), F.col(id_col)]).withColumn(name, F.floor(F.col("row_no") / size).cast("long")))


def _cogrouped(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, f, schema: str) -> DataFrame:
    left, right = (x.withColumns({"a": F.col("a_block") + 0, "r": F.col("r_block") + 0}).drop("a_block", "r_block") for x in (anchors.join(pairs, "a_block"), rows.join(pairs, "r_block")))
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInPandas(f, schema)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Hard negatives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors has (vec_id, embedding, label); `is_anchor` is a condition on them. A score is the inner product of components floor(256 x);
    higher first, ties by smaller vec_id. An anchor's positives are its first rows of the same label; for each, the first rows of other labels whose
    score is from `lowest` to `highest` per cent of the positive's are returned.

    Anchors, a stated set of queries, meet all rows in blocks of bounded size: blocks of a common label for the positives, all for the negatives.
    The upper ends of an anchor's windows split the scores into disjoint slots. Each block keeps the first few of each slot, the window
    functions' partial limit merges them again before the shuffle, and a window's answer is a suffix of the anchor's slots in falling order.

    Rows with a null vec_id, label or vector, and those with null or non-finite components, take no part; repeated rows count once, and rows of one
    vec_id aren't other rows to each other. Vectors meet only
    those of their own length. A positive under zero has no window, one of zero only the score zero. Scores beyond a long stay at its limit. An empty
    table, or one without anchors, gives no rows. Other columns aren't read.
    """
    x = F.col("embedding")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")).distinct()
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    size = max(256, block_values // width)
    own = _blocks(rows, "vec_id", size, "r_block")
    anchors = _blocks(own.where("is_anchor").select(F.col("vec_id").alias("anchor_id"), "label", "embedding"), "anchor_id", size * ANCHOR_BLOCKS, "a_block").withColumnRenamed("row_no", "anchor")
    own = own.drop("is_anchor", "row_no")
    with_label = anchors.select("label", "a_block").distinct().join(own.select("label", "r_block").distinct(), "label").select("a_block", "r_block").distinct()
    by_score = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    found = _cogrouped(anchors, own, with_label, lambda a, b: block_positives(a, b, positives), "anchor long, vec_id long, score long")
    best = materialize(found.withColumn("at", F.row_number().over(by_score("anchor"))).where(F.col("at") <= positives).drop("at"))

    # Whole numbers of any size: 38 digits hold 95 times a long.
    score = F.col("score").cast("decimal(20,0)")
    high, low = F.floor(score * highest / 100).cast("long"), F.ceil(score * lowest / 100).cast("long")
    windows = best.where("score >= 0").select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), high.alias("high"), low.alias("low"))
    ends = windows.groupBy("anchor").agg(F.sort_array(F.collect_set(F.struct("high", "low"))).alias("ends"))  # a few for each anchor
    # Positives whose limits fall together share a slot, which begins at the lowest of their lower ends.
    limits = F.array_sort(F.array_distinct(F.col("ends.high")))
    lows = F.transform(F.col("limits"), lambda u: F.array_min(F.transform(F.filter("ends", lambda e: e["high"] == u), lambda e: e["low"])))
    asked = materialize(anchors.join(ends.withColumn("limits", limits).withColumn("lows", lows).drop("ends"), "anchor"))
    every = asked.select("a_block").distinct().crossJoin(F.broadcast(own.select("r_block").distinct()))  # numbers of blocks, not rows
    slots = _cogrouped(asked, own, every, lambda a, b: block_slots(a, b, negatives), "anchor long, slot long, vec_id long, score long")
    kept = slots.withColumn("at", F.row_number().over(by_score("anchor", "slot"))).where(F.col("at") <= negatives)
    falling = kept.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id").alias("negative_id"), "slot"))).alias("falling"))
    to_limit = windows.join(asked.select("anchor", "anchor_id", "limits"), "anchor").withColumn("last", (F.array_position("limits", F.col("high")) - 1).cast("long")).drop("limits")
    suffix = F.slice(F.filter("falling", lambda r: r["slot"] <= F.col("last")), 1, negatives)
    answer = to_limit.join(falling, "anchor").withColumn("first", F.filter(suffix, lambda r: -r["minus"] >= F.col("low")))
    out = answer.select("anchor_id", "positive_id", "positive_score", F.posexplode("first").alias("at", "row"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("row.negative_id").alias("negative_id"), "positive_score", (-F.col("row.minus")).alias("negative_score"))

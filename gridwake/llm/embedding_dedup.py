"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points in several tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.llm.common import components, materialize

THRESHOLD = 0.95
TABLES = 10
BLOCKS = 2  # E8 points in a key
PROBES = 4  # cells that a vector looks into in each table, its own among them
SCALE = 0.6  # lattice units to the standard deviation that a unit vector's projection has
BLOCK_ROWS = 2048
BIN_ROWS = 4000  # small cells are verified many at a time
SEED = 8


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two best E8 points for each row of 8 coordinates, doubled to whole numbers, and their squared distances.

    E8 is D8 (whole coordinates of even sum) and D8 shifted by one half; each coset gives its nearest point and the runner-up
    in which the parity is kept by moving the two coordinates that are nearest to a tie.
    """
    points, gaps = [], []
    rows = np.arange(len(x))
    for shift in (0.0, 0.5):
        y = x - shift
        r = np.rint(y)
        err = y - r
        step = np.where(err >= 0, 1.0, -1.0)
        cost = 1 - 2 * np.abs(err)  # of moving a coordinate to its second choice
        order = np.argsort(cost, axis=1, kind="stable")
        odd = (r.sum(axis=1) % 2).astype(bool)
        base = (err**2).sum(axis=1)
        first, second = order[:, 0], order[:, 1]
        best, other = r.copy(), r.copy()
        best[rows, first] += np.where(odd, step[rows, first], 0)
        gap = base + np.where(odd, cost[rows, first], 0)
        # Runner-up: with odd parity move the second coordinate instead, with even parity move two.
        other[rows, second] += step[rows, second]
        other[rows, first] += np.where(odd, 0, step[rows, first])
        gap2 = base + cost[rows, second] + np.where(odd, 0, cost[rows, first])
        points += [2 * (best + shift), 2 * (other + shift)]
        gaps += [gap, gap2]
    p, g = np.stack(points, axis=1), np.stack(gaps, axis=1)
    order = np.argsort(g, axis=1, kind="stable")
    return np.take_along_axis(p, order[:, :, None], axis=1).astype(np.int64), np.take_along_axis(g, order, axis=1)


def keys(v: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Cell keys [row, table, probe] of unit vectors; probe 0 is the vector's own cell."""
    n, d = v.shape
    rng = np.random.default_rng(SEED)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        cells, gaps = [], []
        for _ in range(blocks):
            plane = np.linalg.qr(rng.standard_normal((max(d, 8), 8)))[0][:d]
            p, g = decode(v @ plane * (np.sqrt(d) * scale))
            coefficients = rng.integers(1, 1 << 62, 8, np.int64) * 2 + 1
            with np.errstate(over="ignore"):
                cells.append((p * coefficients).sum(axis=2))
            gaps.append(g)
        # The nearest combinations of one choice for each block.
        cell, gap = cells[0], gaps[0]
        for c, g in zip(cells[1:], gaps[1:]):
            with np.errstate(over="ignore"):
                cell = (cell[:, :, None] * np.int64(0x5851F42D4C957F2D) + c[:, None, :]).reshape(n, -1)
            gap = (gap[:, :, None] + g[:, None, :]).reshape(n, -1)
        order = np.argsort(gap, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(cell, order, axis=1)
        out[:, t] = found ^ np.int64((t * 0x1E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF)
    return out


def unit(rows: list) -> np.ndarray:
    """Unit vectors in double precision, of one length and without invalid ones; scaled first, so that no square over- or underflows."""
    v = np.array([np.asarray(x, np.float64) for x in rows]).reshape(len(rows), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _cell_links(key: int, table: int, ids: np.ndarray, copies: np.ndarray, home: np.ndarray, side: np.ndarray, v: np.ndarray, cells: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links and smallest linked ids of the nodes of one cell, or of a pair of its blocks.

    A pair can meet in several cells. It counts in the first table in which it meets, there in the smaller key; both nodes' cells
    tell, so that nothing has to be compared across tasks.
    """
    near = (v @ v.T >= threshold) & (ids[:, None] != ids[None, :]) & (home[:, None] | home[None, :])
    if side.max() > side.min():
        near &= side[:, None] != side[None, :]
    if near.any():
        for t in range(table + 1):
            own = cells[:, t, 0]
            looks = (own[:, None, None] == cells[None, :, t, :]).any(axis=2)  # the row's own cell is among the column's
            if t < table:
                near &= ~(looks | looks.T)
            else:
                low = np.minimum(own[:, None], own[None, :])
                near &= np.where(looks & looks.T, low, np.where(looks, own[:, None], own[None, :])) == key
    low = ids.copy()
    while True:
        nxt = np.minimum(low, np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (nxt == low).all():
            return near.astype(np.int64) @ copies, low
        low = nxt


def linked(pdf: pd.DataFrame, threshold: float, tables: int, probes: int) -> pd.DataFrame:
    """Verified links (vec_id, links, low) within the cells of a bin."""
    pdf = pdf.assign(width=pdf["embedding"].map(len)).sort_values(["key", "width"], kind="stable")
    key, table, ids, copies, home, side = (pdf[c].to_numpy(np.int64) for c in ("key", "table", "vec_id", "copies", "home", "side"))
    vectors = pdf["embedding"].tolist()
    cells = np.array(pdf["cells"].tolist(), np.int64).reshape(len(pdf), tables, probes)
    cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(pdf["width"].to_numpy()) != 0)) + 1
    out = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
        w = slice(a, b)
        links, low = _cell_links(int(key[a]), int(table[a]), ids[w], copies[w], home[w] > 0, side[w], unit(vectors[w]), cells[w], threshold)
        some = links > 0
        if some.any():
            out.append((ids[w][some], links[some], low[some]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
    return pd.DataFrame(dict(zip(("vec_id", "links", "low"), columns)))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """Link all vectors with cosine of at least `threshold`: (vec_id, n_links, component_id, kept), a row for each vector.

    Equal vectors are one node. Every node is indexed in its own cell of each table and looks into the `probes` nearest
    cells; candidates are verified in double precision. A cell with more than BLOCK_ROWS nodes is compared in pairs of blocks.

    Vectors of different lengths never link; each length has lattice cells of its own. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing.
    Rows with a null vec_id give no row; repeated rows are copies of each other. An empty table gives no rows.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    x = F.col("embedding")
    valid = (F.size("embedding") > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = rows.select("vec_id", F.when(valid, x).alias("embedding"))
    copy = [F.xxhash64("embedding"), F.xxhash64(F.lit(1), F.transform("embedding", lambda c: c + F.lit(0.0).cast("float")))]
    rows = rows.withColumn("h1", F.when(F.col("embedding").isNotNull(), copy[0])).withColumn("h2", F.when(F.col("embedding").isNotNull(), copy[1]))
    nodes = materialize(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, own in pdf.groupby(pdf["embedding"].map(len)):
                found = keys(unit(own["embedding"].tolist()), tables, blocks, probes, scale) ^ np.int64(width << 40)
                yield own.assign(cells=list(found.reshape(len(own), -1)))

    kind = nodes.schema["embedding"].dataType
    fields = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("embedding", kind), T.StructField("cells", T.ArrayType(T.LongType()))])
    indexed = materialize(nodes.select("vec_id", "copies", "embedding").mapInPandas(index, fields))
    placed = indexed.select("vec_id", F.posexplode("cells").alias("at", "key"))
    placed = placed.select("vec_id", "key", F.floor(F.col("at") / probes).cast("long").alias("table"), (F.col("at") % probes == 0).cast("long").alias("home")).groupBy("key", "vec_id").agg(F.max("home").alias("home"), F.min("table").alias("table"))
    cells = placed.groupBy("key").agg(F.count("*").alias("n"), F.sum("home").alias("homes")).where("n > 1 and homes > 0")
    met = materialize(placed.join(cells.select("key", "n"), "key"))
    parts = met.withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS)).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("part")).alias("p"), F.greatest(i, F.col("part")).alias("q")))
    bins = max(1, met.count() // BIN_ROWS)
    bin_of = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("key"))
    x = parts.select("vec_id", "key", "table", "home", "part", (F.col("parts") == 1).alias("small"), bin_of.alias("bin"), F.explode(pairs).alias("pair")).join(indexed, "vec_id")
    x = x.select("vec_id", "copies", "embedding", "cells", "key", "table", "home", "small", "bin", "pair.p", "pair.q", (F.col("part") == F.col("pair.q")).cast("long").alias("side"))
    found = materialize(x.groupBy("small", "bin", "p", "q").applyInPandas(lambda pdf: linked(pdf, threshold, tables, probes), "vec_id long, links long, low long"))
    near = components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    per_node = found.groupBy("vec_id").agg(F.sum("links").alias("links")).join(near, F.col("vec_id") == F.col("node"), "left").select(F.col("vec_id").alias("rep"), "links", "root")
    classes = nodes.select("h1", "h2", F.col("vec_id").alias("rep"), "copies").join(per_node, "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))

"""Raster aggregates taken within tiles: a task reduces a tile's array to a few partial rows, and only those are shuffled. No pixel becomes a row.

Tiles are (category, row_off, col_off, height, width, data) with data row-major; null elements hold no pixel, a null array none at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.operators.raster import HISTOGRAM

Reduce = Callable[[dict, np.ndarray, np.ndarray], dict]  # tile's columns, values and validity to columns of partial rows


def _reduced(tiles: DataFrame, nodata: int | None, reduce: Reduce, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """The rows that `reduce` makes of each tile, with its category; arrays pass to numpy as Arrow holds them."""
    whole = isinstance(tiles.schema["data"].dataType.elementType, T.IntegralType)
    number = np.int64 if whole else np.float64
    kinds = [(pa.int64() if whole else pa.float64()) if k is None else k for k in kinds]
    schema = pa.schema([("category", pa.string()), *zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("data")
            held, ends = column.flatten(), np.cumsum([0 if n is None else n for n in (column.value_lengths().to_pylist())])
            ok = np.asarray(held.is_valid())
            values = held.fill_null(0).to_numpy(zero_copy_only=False).astype(number, copy=False)
            ok = ok & (values != nodata if nodata is not None else ~np.isnan(values.astype(np.float64, copy=False)))
            others = batch.drop_columns(["data"]).to_pylist()
            parts, categories = [], []
            for tile, a, b in zip(others, [0, *ends[:-1].tolist()], ends.tolist()):
                if b > a:
                    found = reduce(tile, values[a:b], ok[a:b])
                    parts.append(found)
                    categories += [tile["category"]] * len(found[names[0]])
            columns = [np.concatenate([p[n] for p in parts]) if parts else [] for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(categories, pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], schema=schema)

    spark_kinds = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double"}
    ddl = ", ".join(["category string", *[f"`{n}` {spark_kinds[k]}" for n, k in zip(names, kinds)]])
    return tiles.select("category", "row_off", "col_off", "height", "width", "data").mapInArrow(run, ddl)


def partial_statistics(tiles: DataFrame, nodata: int | None, bins: list[tuple] = HISTOGRAM) -> DataFrame:
    """A row for each tile with pixels: counts, range, sum, mean, squared deviations from it, sum of squares and counts by bin."""
    edges = np.array([lo for lo, _, _ in bins], np.float64)
    names = ["valid", "zeros", "nonzeros", "min", "max", "total", "deviation", "squares", *[f"bin{i}" for i in range(len(bins))]]

    def reduce(tile: dict, values: np.ndarray, ok: np.ndarray) -> dict:
        v = values[ok]
        if not len(v):
            return {n: v[:0] for n in names}
        x = v.astype(np.float64)
        found = np.bincount(np.searchsorted(edges, x, side="right"), minlength=len(bins) + 1)[1:]
        each = [len(v), (v == 0).sum(), (v > 0).sum(), v.min(), v.max(), v.sum(), ((x - x.mean()) ** 2).sum(), (x * x).sum(), *found]
        return {n: np.array([e]) for n, e in zip(names, each)}

    return _reduced(tiles, nodata, reduce, names, [pa.int64(), pa.int64(), pa.int64(), None, None, None, pa.float64(), pa.float64(), *[pa.int64()] * len(bins)])


def statistics(tiles: DataFrame, nodata: int | None) -> DataFrame:
    """`raster.statistics` of tiles: deviations of tiles are merged about the category's mean, so that large means cost no digits."""
    from gridwake.tables import materialize

    each = materialize(partial_statistics(tiles, nodata))
    sums = each.groupBy("category").agg(F.sum("valid").alias("valid"), F.sum("zeros").alias("zeros"), F.sum("nonzeros").alias("nonzeros"), F.min("min").alias("min"), F.max("max").alias("max"), (F.sum("total") / F.sum("valid")).alias("mean"))
    gap = F.col("total") / F.col("valid") - F.col("mean")
    spread = each.join(F.broadcast(sums.select("category", "mean")), "category").groupBy("category").agg(F.sqrt(F.sum(F.col("deviation") + F.col("valid") * gap * gap) / F.sum("valid")).alias("std"))
    s = sums.join(F.broadcast(spread), "category")  # a row for each category
    return s.withColumn("zero_pct", F.col("zeros") / F.col("valid") * 100).withColumn("nonzero_pct", F.col("nonzeros") / F.col("valid") * 100)


def histogram(tiles: DataFrame, nodata: int | None, bins: list[tuple] = HISTOGRAM) -> DataFrame:
    """`raster.histogram` of tiles: (category, label, n, pct) for each bin, empty ones too."""
    counts = partial_statistics(tiles, nodata, bins).groupBy("category").agg(F.sum("valid").alias("_all"), *[F.sum(f"bin{i}").alias(f"bin{i}") for i in range(len(bins))])
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"bin{i}").alias("n")) for i, (_, _, label) in enumerate(bins)])
    return counts.withColumn("b", F.explode(each)).select("category", "b.label", "b.n", (F.col("b.n") / F.col("_all") * 100).alias("pct"))


def partial_blocks(tiles: DataFrame, height: int, width: int, factor: int, nodata: int | None) -> DataFrame:
    """For each tile the blocks of the whole extent that it touches: (category, row_id, col_id, n, total, min, max)."""
    h, w = height // factor, width // factor

    def reduce(tile: dict, values: np.ndarray, ok: np.ndarray) -> dict:
        shape = (tile["height"], tile["width"])
        v, ok = values.reshape(shape), ok.reshape(shape)
        rows, cols = (tile["row_off"] + np.arange(shape[0])) * h // height, (tile["col_off"] + np.arange(shape[1])) * w // width
        (r, at_r), (c, at_c) = (np.unique(x, return_index=True) for x in (rows, cols))

        def blocks(f: np.ufunc, x: np.ndarray) -> np.ndarray:
            return f.reduceat(f.reduceat(x, at_r, axis=0), at_c, axis=1)

        least, most = (np.iinfo(v.dtype).min, np.iinfo(v.dtype).max) if v.dtype == np.int64 else (-np.inf, np.inf)
        n = blocks(np.add, ok.astype(np.int64))
        i, j = np.nonzero(n)
        out = {"row_id": r[i], "col_id": c[j], "n": n[i, j], "total": blocks(np.add, np.where(ok, v, 0))[i, j]}
        return out | {"min": blocks(np.minimum, np.where(ok, v, most))[i, j], "max": blocks(np.maximum, np.where(ok, v, least))[i, j]}

    return _reduced(tiles, nodata, reduce, ["row_id", "col_id", "n", "total", "min", "max"], [pa.int32(), pa.int32(), pa.int64(), None, None, None])


def downsample(tiles: DataFrame, height: int, width: int, factor: int, nodata: int | None, how: str = "average") -> DataFrame:
    """`raster.downsample` of tiles: blocks that lie across tiles are merged from their parts."""
    value = {"average": F.round(F.sum("total") / F.sum("n")), "max": F.max("max"), "min": F.min("min"), "sum": F.sum("total")}[how]
    return partial_blocks(tiles, height, width, factor, nodata).groupBy("category", "row_id", "col_id").agg(value.cast("long").alias("value"))

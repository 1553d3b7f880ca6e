"""Aggregates within tiles against the same on pixels, and statistics of a stream that is taken up again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.operators import raster, tiles
from gridwake.streaming import raster_stats

TILE = "category string, row_off int, col_off int, height int, width int, data array<{}>, extra string"
ND = -9


def make(spark, kind, h, w, size, seed):
    """Tiles of h x w pixels whose borders lie across the blocks of a downsampling; some elements and one tile are null."""
    rng = np.random.default_rng(seed)
    rows = []
    for category in ("a", "b"):
        for r in range(0, h, size):
            for c in range(0, w, size):
                a, b = min(size, h - r), min(size, w - c)
                v = [int(x) for x in rng.choice([ND, 0, 0, 3, 50, 1000, 2_000_000_000], a * b)] if kind == "int" else [float(x) for x in rng.gamma(1, 300, a * b)]
                v = [None if rng.random() < 0.1 else (float("nan") if kind == "double" and rng.random() < 0.1 else x) for x in v]
                rows.append((category, r, c, a, b, v, "x"))
    rows.append(("a", h, w, 1, 1, None, "x"))
    rows.append(("c", 0, 0, 1, 2, [None, None], "x"))
    return spark.createDataFrame(rows, TILE.format(kind))


def same(got, want, keys):
    read = lambda df: {tuple(r[k] for k in keys): r for r in df.collect()}
    g, w = read(got), read(want)
    assert set(g) == set(w)
    for k, row in w.items():
        for name in want.columns:
            if name not in keys:
                assert g[k][name] == pytest.approx(row[name], rel=1e-12), (k, name)


@pytest.mark.parametrize(("kind", "nodata"), [("int", ND), ("double", None)])
def test_tiles_equal_pixels(spark, kind, nodata):
    t = make(spark, kind, 50, 70, 16, 1)
    p = raster.tile_pixels(t)
    same(tiles.statistics(t, nodata), raster.statistics(p, nodata), ["category"])
    same(tiles.histogram(t, nodata), raster.histogram(p, nodata), ["category", "label"])
    for how in ("average", "max", "min", "sum") if kind == "int" else ("max", "min"):
        same(tiles.downsample(t, 50, 70, 7, nodata, how), raster.downsample(p, 50, 70, 7, nodata, how), ["category", "row_id", "col_id"])
    for f in (tiles.statistics(t, nodata), tiles.downsample(t, 50, 70, 7, nodata)):
        assert "Generate" not in f._jdf.queryExecution().optimizedPlan().toString()  # no explosion
    assert tiles.statistics(t.limit(0), nodata).count() == 0


def test_deviation_keeps_its_digits(spark):
    v = np.random.default_rng(2).integers(0, 3, (40, 100)) + 2_000_000_000
    t = spark.createDataFrame([("a", i, 0, 1, 100, [int(x) for x in r], "x") for i, r in enumerate(v)], TILE.format("int"))
    assert tiles.statistics(t, ND).first()["std"] == pytest.approx(v.std(), rel=1e-7)  # sums of squares would have lost it


def test_stream_is_taken_up_again(spark, tmp_path):
    """Tiles arrive between runs; the second run starts from the checkpoint and equals one batch over all, and a third finds nothing new."""
    folder, check, out = (str(tmp_path / n) for n in ("tiles", "check", "out"))
    first, second = make(spark, "int", 30, 30, 10, 3).where("category <> 'b'"), make(spark, "int", 40, 20, 10, 4).where("category <> 'a'")
    first.repartition(3).write.mode("append").parquet(folder)
    one = raster_stats.run(spark, folder, check, out, ND, files_at_once=1)
    same(one.select("category", "valid", "min", "max", "mean", "std"), raster.statistics(raster.tile_pixels(first), ND).select("category", "valid", "min", "max", "mean", "std"), ["category"])
    second.union(first.where("row_off = 0")).repartition(2).write.mode("append").parquet(folder)
    every = first.union(second).union(first.where("row_off = 0"))
    want = raster.statistics(raster.tile_pixels(every), ND).select("category", "valid", "zeros", "nonzeros", "min", "max", "mean", "std")
    for _ in range(2):
        same(raster_stats.run(spark, folder, check, out, ND).select(*want.columns), want, ["category"])
    bins = raster.histogram(raster.tile_pixels(every), ND).groupBy("category").agg(F.sum("n").alias("n"))
    got = raster_stats.run(spark, folder, check, out, ND)
    same(got.select("category", sum(F.col(f"bin{i}") for i in range(7)).alias("n")), bins, ["category"])


def test_rasters_that_differ(spark):
    meta = "width int, height int, crs string, px double, py double"
    one = spark.createDataFrame([(4, 3, "EPSG:4326", 0.5, -0.5)] * 2, meta)
    assert raster.consistent(one).first()[:4] == (True, True, True, 2)
    for row, wrong in (((5, 3, "EPSG:4326", 0.5, -0.5), 0), ((4, 3, "EPSG:6933", 0.5, -0.5), 1), ((4, 3, "EPSG:4326", 0.5, -0.25), 2)):
        got = raster.consistent(one.union(spark.createDataFrame([row], meta))).first()
        assert [i for i in range(3) if not got[i]] == [wrong]

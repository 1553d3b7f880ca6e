"""Rasters as tables of tiles and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.operators.grid import at_least_percentile, exact_percentiles, normalised_by_max

# Bin edges and labels.
HISTOGRAM = [(0, 1, "No traffic"), (1, 10, "Very low (1-10)"), (10, 100, "Low (10-100)"), (100, 1000, "Medium (100-1K)"), (1000, 10000, "High (1K-10K)"), (10000, 100000, "Very high (10K-100K)"), (100000, None, "Extreme (>100K)")]
RANGES = [(0, 1, "No traffic"), (1, 10, "Very low"), (10, 100, "Low"), (100, 1000, "Medium"), (1000, 10000, "High"), (10000, None, "Very high")]


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """Pixels of row-major tiles; a tile is read where it lies, without a shuffle."""
    at = tiles.select("category", "row_off", "col_off", "width", F.posexplode("data").alias("at", "value"))
    return at.where("value is not null").select("category", (F.col("row_off") + F.floor(F.col("at") / F.col("width"))).cast("int").alias("row_id"), (F.col("col_off") + F.col("at") % F.col("width")).cast("int").alias("col_id"), "value")


def valid(pixels: DataFrame, nodata: int | None) -> DataFrame:
    """Pixels that hold data: other than nodata, or not NaN where none is declared."""
    return pixels.where(F.col("value") != nodata) if nodata is not None else pixels.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))


def with_traffic(pixels: DataFrame, nodata: int | None) -> DataFrame:
    return valid(pixels, nodata).where("value > 0")


def sample_windows(pixels: DataFrame, height: int, width: int, size: int, each: int) -> DataFrame:
    """Pixels of each x each evenly spaced windows; where windows overlap, a pixel comes once for each."""
    def starts(length: int) -> list[int]:
        return [int(i * (length - size) / (each - 1)) for i in range(each)]

    rows = F.filter(F.array(*[F.lit(s) for s in starts(height)]), lambda s: (F.col("row_id") >= s) & (F.col("row_id") < s + size))
    cols = F.filter(F.array(*[F.lit(s) for s in starts(width)]), lambda s: (F.col("col_id") >= s) & (F.col("col_id") < s + size))
    return pixels.withColumn("win_row", F.explode(rows)).withColumn("win_col", F.explode(cols))


def overview(pixels: DataFrame, height: int, width: int, factor: int) -> DataFrame:
    """Nearest-neighbour decimation: the pixel at the middle of each output cell."""
    h, w = height // factor, width // factor
    row = F.floor((F.floor(F.col("row_id") * h / height) + 0.5) * height / h)
    col = F.floor((F.floor(F.col("col_id") * w / width) + 0.5) * width / w)
    return pixels.where((F.col("row_id") == row) & (F.col("col_id") == col))


def coverage(pixels: DataFrame, nodata: int | None) -> DataFrame:
    return valid(pixels, nodata).groupBy("category").agg(F.count("*").alias("valid"), F.count_if(F.col("value") > 0).alias("nonzero")).withColumn("coverage_pct", F.col("nonzero") / F.col("valid") * 100)


def to_lonlat(pixels: DataFrame, meta: DataFrame, factor: int = 1) -> DataFrame:
    """Add longitude and latitude of pixel centres from the georeference, one row for each raster."""
    m = F.broadcast(meta.select("category", "origin_x", "origin_y", "px", "py"))
    lon = F.col("origin_x") + (F.col("col_id") + 0.5) * F.col("px") * factor
    lat = F.col("origin_y") + (F.col("row_id") + 0.5) * F.col("py") * factor
    return pixels.join(m, "category").withColumn("longitude", lon).withColumn("latitude", lat).drop("origin_x", "origin_y", "px", "py")


def downsample(pixels: DataFrame, height: int, width: int, factor: int, nodata: int | None, how: str = "average") -> DataFrame:
    """Blocks of the whole extent as one value each; nodata never counts, zeros do. Averages are rounded half up.

    Partial sums of a tile's blocks are taken before the shuffle.
    """
    h, w = height // factor, width // factor
    v = F.col("value")
    value = {"average": F.round(F.sum(v.cast("long")) / F.count(v)), "max": F.max(v), "min": F.min(v), "sum": F.sum(v.cast("long"))}[how]
    row, col = F.floor(F.col("row_id") * h / height).cast("int"), F.floor(F.col("col_id") * w / width).cast("int")
    return valid(pixels, nodata).groupBy("category", row.alias("row_id"), col.alias("col_id")).agg(value.cast("long").alias("value"))


def _bin_counts(bins: list[tuple]) -> list[Column]:
    v = F.col("value")
    return [F.count_if((v >= lo) & (F.lit(True) if hi is None else v < hi)).alias(f"bin{i}") for i, (lo, hi, _) in enumerate(bins)]


def statistics(pixels: DataFrame, nodata: int | None) -> DataFrame:
    """Counts, range, mean and population deviation of valid pixels, by category. Squares are taken in double precision."""
    v = F.col("value")
    s = valid(pixels, nodata).groupBy("category").agg(F.count("*").alias("valid"), F.count_if(v == 0).alias("zeros"), F.count_if(v > 0).alias("nonzeros"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v.cast("double")).alias("std"))
    return s.withColumn("zero_pct", F.col("zeros") / F.col("valid") * 100).withColumn("nonzero_pct", F.col("nonzeros") / F.col("valid") * 100)


def histogram(pixels: DataFrame, nodata: int | None, bins: list[tuple] = HISTOGRAM) -> DataFrame:
    """(category, label, n, pct) for each bin, empty ones too; one pass."""
    counts = valid(pixels, nodata).groupBy("category").agg(F.count("*").alias("_all"), *_bin_counts(bins))
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"bin{i}").alias("n")) for i, (_, _, label) in enumerate(bins)])
    return counts.withColumn("b", F.explode(each)).select("category", "b.label", "b.n", (F.col("b.n") / F.col("_all") * 100).alias("pct"))


def exploration(pixels: DataFrame, nodata: int | None) -> DataFrame:
    s = statistics(pixels, nodata)
    p = exact_percentiles(valid(pixels, nodata), "value", {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}, ["category"])
    return s.join(F.broadcast(p), "category").withColumn("coverage_pct", F.col("nonzero_pct"))


def consistent(meta: DataFrame) -> DataFrame:
    """Whether all rasters have one size, reference system and resolution."""
    one = lambda *c: F.count_distinct(F.struct(*c)) == 1
    return meta.agg(one("width", "height").alias("same_dimensions"), one("crs").alias("same_crs"), one("px", "py").alias("same_resolution"), F.count("*").alias("rasters"))


def export_summary(pixels: DataFrame, nodata: int | None) -> DataFrame:
    """All and kept pixels with the reduction, and range, mean and median of the kept ones."""
    v, keep = F.col("value"), (F.col("value") != nodata) & (F.col("value") > 0) if nodata is not None else F.col("value") > 0
    a = pixels.groupBy("category").agg(F.count("*").alias("total"), F.count_if(keep).alias("kept"), F.min(F.when(keep, v)).alias("min"), F.max(F.when(keep, v)).alias("max"), F.avg(F.when(keep, v)).alias("mean"))
    m = exact_percentiles(pixels.where(keep), "value", {"median": 0.5}, ["category"])
    return a.join(F.broadcast(m), "category", "left").withColumn("reduction_pct", (1 - F.col("kept") / F.col("total")) * 100)


def zero_kinds(pixels: DataFrame, land: DataFrame | None, nodata: int | None) -> DataFrame:
    """Zeros as land or ocean by a mask of (row_id, col_id); all are ocean without one."""
    zeros = valid(pixels, nodata).where("value = 0")
    if land is None:
        return zeros.withColumn("kind", F.lit("ocean"))
    return zeros.join(land.select("row_id", "col_id").distinct().withColumn("_l", F.lit(True)), ["row_id", "col_id"], "left").withColumn("kind", F.when(F.col("_l"), "land").otherwise("ocean")).drop("_l")


def below_threshold_to_zero(pixels: DataFrame, threshold: float) -> DataFrame:
    return pixels.withColumn("value", F.when(F.col("value") < threshold, 0).otherwise(F.col("value")))


def clipped_at_percentile(df: DataFrame, value: str, upper: float, by: list[str]) -> DataFrame:
    """Clip to [0, percentile of the positive values of the group]."""
    cut = exact_percentiles(df.where(F.col(value) > 0), value, {"_u": upper}, by)
    return df.join(F.broadcast(cut), by, "left").withColumn(value, F.when(F.col("_u").isNull(), F.col(value).cast("double")).otherwise(F.least(F.greatest(F.col(value).cast("double"), F.lit(0.0)), F.col("_u")))).drop("_u")


PRESETS = {
    "global": {"factor": 10, "transform": "log", "clip": 0.99, "normalise": True},
    "regional": {"factor": 5, "transform": "sqrt", "clip": 0.995, "normalise": False},
    "analysis": {"factor": 1, "threshold": 10.0, "transform": None, "clip": None, "normalise": False},
}


def preprocess(pixels: DataFrame, height: int, width: int, nodata: int | None, config: dict) -> DataFrame:
    """Downsample, drop nodata, zero small values, transform, clip and normalise, as the configuration says."""
    x = downsample(pixels, height, width, config["factor"], nodata) if config.get("factor", 1) > 1 else valid(pixels, nodata)
    if config.get("threshold"):
        x = below_threshold_to_zero(x, config["threshold"])
    x = x.withColumn("value", F.col("value").cast("double"))
    transform = {"log": lambda v: F.log10(v + 1), "sqrt": F.sqrt}.get(config.get("transform"))
    if transform:
        x = x.withColumn("value", transform(F.col("value")))
    if config.get("clip"):
        x = clipped_at_percentile(x, "value", config["clip"], ["category"])
    return normalised_by_max(x, "value", ["category"], "value") if config.get("normalise") else x


def preprocess_checks(before: DataFrame, after: DataFrame, nodata: int | None) -> DataFrame:
    """By category: no negatives, maximum not over the source's, not all null, and both counts."""
    b = valid(before, nodata).groupBy("category").agg(F.max("value").alias("source_max"), F.count("*").alias("source_rows"))
    a = after.groupBy("category").agg(F.count_if(F.col("value") < 0).alias("negatives"), F.max("value").alias("new_max"), F.count("value").alias("values"), F.count("*").alias("rows"))
    return b.join(a, "category").select("category", (F.col("negatives") == 0).alias("no_negatives"), (F.col("new_max") <= F.col("source_max")).alias("max_ok"), (F.col("values") > 0).alias("not_all_null"), (F.col("rows") == F.col("source_rows")).alias("same_rows"))


def residual(total: DataFrame, parts: DataFrame) -> DataFrame:
    """What a total raster has beyond the sum of its parts, as counts and coverage."""
    p = parts.groupBy("row_id", "col_id").agg(F.sum("value").alias("part"))
    t = total.groupBy("row_id", "col_id").agg(F.sum("value").alias("whole"))
    x = t.join(p, ["row_id", "col_id"], "full").select(F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("part", F.lit(0)).alias("part"))
    return x.agg(F.count("*").alias("cells"), F.count_if(F.col("whole") > F.col("part")).alias("over"), F.count_if(F.col("whole") < F.col("part")).alias("under"), F.count_if(F.col("whole") == F.col("part")).alias("equal"), F.sum(F.col("whole") - F.col("part")).alias("residual_sum"))


def hotspots(points: DataFrame, p: float = 0.9) -> DataFrame:
    return at_least_percentile(points, "density", p, ["category"])

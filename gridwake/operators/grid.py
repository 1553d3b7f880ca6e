"""Binning points into regular grids, pyramids and normalised layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions.scalar import bin_centre, bin_index, clip01, wrap_longitude
from gridwake.tables import materialize

BRACKET = 0.0005  # share of a group's rows on either side of a percentile
SKETCH = 10_000  # accuracy of the sketches: the bracket is five times their error
SMALL_GROUP = 10_000
RESOLUTIONS = {"low": 1.0, "mid": 0.5, "high": 0.25}


def with_bins(points: DataFrame, grid_deg: float | Column, wrap: bool = True) -> DataFrame:
    """Add lat_idx and lon_idx; rows are grouped on these whole numbers, centres follow from them."""
    lon = wrap_longitude(F.col("longitude")) if wrap else F.col("longitude")
    return points.withColumn("lat_idx", bin_index(F.col("latitude"), grid_deg, 90.0)).withColumn("lon_idx", bin_index(lon, grid_deg, 180.0))


def with_centres(cells: DataFrame, grid_deg: float | Column) -> DataFrame:
    return cells.withColumn("lat_bin", bin_centre(F.col("lat_idx"), grid_deg, 90.0)).withColumn("lon_bin", bin_centre(F.col("lon_idx"), grid_deg, 180.0))


def aggregate_grid(points: DataFrame, grid_deg: float, by: list[str] | None = None, wrap: bool = True) -> DataFrame:
    """Sums, means and counts of density and intensity for each cell (and each value of `by`)."""
    keys = [*(by or []), "lat_idx", "lon_idx"]
    sums = with_bins(points, grid_deg, wrap).groupBy(*keys).agg(F.sum("density").alias("density_sum"), F.sum("intensity").cast("double").alias("intensity_sum"), F.count("*").alias("points"))
    means = sums.withColumn("density_mean", F.col("density_sum") / F.col("points")).withColumn("intensity_mean", F.col("intensity_sum") / F.col("points"))
    return with_centres(means, grid_deg)


def pyramid(points: DataFrame, weight: str, resolutions: dict[str, float] = RESOLUTIONS) -> DataFrame:
    """Sums of `weight` for all resolutions, for each category and for all together as `global`.

    The finest grid is aggregated once over the points; each coarser cell is a sum of finer cells, so that the points are
    shuffled once whatever the number of layers. Grid sizes must be multiples of the finest by whole numbers.
    """
    finest = min(resolutions.values())
    base = with_bins(points, finest).groupBy("category", "lat_idx", "lon_idx").agg(F.sum(weight).alias("raw_weight"), F.count("*").alias("points"))
    sizes = F.array(*[F.struct(F.lit(n).alias("resolution"), F.lit(g).alias("grid_deg"), F.lit(round(g / finest)).alias("times")) for n, g in resolutions.items()])
    each = base.withColumn("r", F.explode(sizes)).select("r.resolution", "r.grid_deg", "category", F.floor(F.col("lat_idx") / F.col("r.times")).cast("int").alias("lat_idx"), F.floor(F.col("lon_idx") / F.col("r.times")).cast("int").alias("lon_idx"), "raw_weight", "points")
    layers = each.withColumn("top_category", F.explode(F.array("category", F.lit("global"))))
    out = layers.groupBy("resolution", "grid_deg", "top_category", "lat_idx", "lon_idx").agg(F.sum("raw_weight").cast("double").alias("raw_weight"), F.sum("points").alias("points"))
    return with_centres(out, F.col("grid_deg"))


def normalised_by_p99(cells: DataFrame, by: list[str], least: float = 0.01) -> DataFrame:
    """weight = raw_weight over the 99th percentile of its layer, clipped to [0, 1]; cells under `least` go.

    Percentiles are exact; no task reads a whole layer for them.
    """
    p99 = exact_percentiles(cells, "raw_weight", {"p99": 0.99}, by)
    # One row for each layer.
    weighted = cells.join(F.broadcast(p99), by).withColumn("weight", clip01(F.col("raw_weight") / F.when(F.col("p99") > 0, F.col("p99")).otherwise(1.0)))
    return weighted.where(F.col("weight") >= least).drop("p99")


def heat_triples(points: DataFrame, grid_deg: float, weight: str) -> DataFrame:
    """(lat_bin, lon_bin, weight) without wrapping, weights over their maximum, rounded to 5 digits."""
    cells = with_bins(points, grid_deg, wrap=False).groupBy("lat_idx", "lon_idx").agg(F.sum(weight).cast("double").alias("w"))
    top = cells.agg(F.max("w").alias("m"))
    scaled = with_centres(cells, grid_deg).crossJoin(F.broadcast(top)).withColumn("weight", F.col("w") / F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")))
    return scaled.select(F.round("lat_bin", 5).alias("lat_bin"), F.round("lon_bin", 5).alias("lon_bin"), F.round("weight", 5).alias("weight"))


def exact_percentiles(df: DataFrame, value: str, at: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Linear-interpolated exact percentiles by group, without a task that reads or holds a whole group's values.

    Mergeable sketches bracket each percentile to 2 * BRACKET of a group's rows; one pass counts the values in the brackets and the rows below
    them, and only those counts meet to settle the ranks. Groups of up to SMALL_GROUP rows are their own bracket. Nulls don't count.
    """
    keys, names = by or ["_g"], list(at)
    x = df.withColumn("_g", F.lit(0)).select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    edges = [F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, p + side * BRACKET))) for p in at.values()]), SKETCH).alias(name) for side, name in ((-1, "_lo"), (1, "_hi"))]
    sketch = x.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), *edges)
    small = F.col("_n") <= SMALL_GROUP
    brackets = sketch.select(*keys, "_n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.when(small, F.col("_least")).otherwise(F.col("_lo")[i]).alias("lo"), F.when(small, F.col("_most")).otherwise(F.col("_hi")[i]).alias("hi")) for i, p in enumerate(at.values())])).alias("_b"))
    brackets = materialize(brackets)  # a row for each group and percentile
    met = x.join(F.broadcast(brackets.groupBy(*keys).agg(F.collect_list("_b").alias("_all"))), keys).withColumn("_b", F.explode("_all")).where(F.col("_v") <= F.col("_b.hi"))
    counts = met.groupBy(*keys, F.col("_b.i").alias("_i"), F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    seen = counts.withColumn("_seen", F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v"))))
    place = (F.col("_n") - 1) * F.col("_b.p")
    ranked = seen.join(F.broadcast(brackets.withColumn("_i", F.col("_b.i")).withColumn("_place", place)), [*keys, "_i"])
    low, high = (F.min(F.when(F.col("_seen") > rank, F.col("_v"))) for rank in (F.floor("_place"), F.ceil("_place")))
    found = ranked.groupBy(*keys, "_i").agg(low.alias("_low"), high.alias("_high"), F.first("_place").alias("_place"))
    share = F.col("_place") - F.floor("_place")
    settled = found.withColumn("_p", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((1 - share) * F.col("_low") + share * F.col("_high")))
    out = settled.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_p"))).alias(name) for i, name in enumerate(names)])
    return out if by else out.drop("_g")


def normalised_by_max(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """value over its group's maximum; unchanged where that isn't positive."""
    top = df.groupBy(*by).agg(F.max(value).cast("double").alias("_m"))
    return df.join(F.broadcast(top), by).withColumn(name, F.when(F.col("_m") > 0, F.col(value) / F.col("_m")).otherwise(F.col(value).cast("double"))).drop("_m")


def z_scores(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    s = df.groupBy(*by).agg(F.avg(value).alias("_a"), F.stddev_pop(F.col(value).cast("double")).alias("_s"))
    return df.join(F.broadcast(s), by).withColumn(name, F.when(F.col("_s") > 0, (F.col(value) - F.col("_a")) / F.col("_s")).otherwise(0.0)).drop("_a", "_s")


def at_least_percentile(df: DataFrame, value: str, p: float, by: list[str] | None = None) -> DataFrame:
    """The rows at or over the exact percentile of their group."""
    cut = F.broadcast(exact_percentiles(df, value, {"_p": p}, by))
    joined = df.join(cut, by) if by else df.crossJoin(cut)
    return joined.where(F.col(value) >= F.col("_p")).drop("_p")


def smoothed(cells: DataFrame, value: str, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian smoothing over (lat_idx, lon_idx), renormalised over the cells that exist."""
    r = int(truncate * sigma + 0.5)
    offsets = F.array(*[F.lit(i) for i in range(-r, r + 1)])
    weight = F.exp(-0.5 * F.pow(F.col("_o") / sigma, 2))
    x = cells.select("lat_idx", "lon_idx", F.col(value).cast("double").alias("_v"), F.lit(1.0).alias("_w"))
    for axis, other in (("lat_idx", "lon_idx"), ("lon_idx", "lat_idx")):
        x = x.withColumn("_o", F.explode(offsets)).select((F.col(axis) + F.col("_o")).alias(axis), other, (F.col("_v") * weight).alias("_v"), (F.col("_w") * weight).alias("_w"))
        x = x.groupBy(axis, other).agg(F.sum("_v").alias("_v"), F.sum("_w").alias("_w"))
    return cells.join(x.select("lat_idx", "lon_idx", (F.col("_v") / F.col("_w")).alias("smooth")), ["lat_idx", "lon_idx"])

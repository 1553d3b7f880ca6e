"""Global and local spatial autocorrelation on grid cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.functions.scalar import lisa_label
from gridwake.operators.neighbors import offsets, spatial_lag
from gridwake.operators.pointpattern import ranked
from gridwake.tables import materialize

PERMUTED_CELLS = 200_000


def centred(cells: DataFrame, weights: DataFrame, value: str) -> DataFrame:
    """Cells with z, the value less its mean, and lag_z, the weighted mean of the neighbours' z."""
    mean = cells.agg(F.avg(F.col(value).cast("double")).alias("_m"))
    z = cells.crossJoin(F.broadcast(mean)).withColumn("z", F.col(value) - F.col("_m")).drop("_m")
    return spatial_lag(z, weights, "z", "lag_z")


def moran(cells: DataFrame, weights: DataFrame, value: str) -> DataFrame:
    """Moran's I under row-standardised weights, its expectation, and n."""
    a = centred(cells, weights, value).agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("lag_z")).alias("zl"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    return a.select("n", (F.col("zl") / F.col("zz")).alias("moran_i"), (-1.0 / (F.col("n") - 1)).alias("expected_i"))


def moran_moments(cells: DataFrame, weights: DataFrame, value: str) -> DataFrame:
    """(n, moran_i, expected_i, variance, z_norm, p_norm): Moran's I against its moments under randomisation (Cliff and Ord 1981), for any number of cells.

    S0 is the sum of the weights, S1 that of (w_ij + w_ji)^2 over unordered pairs, S2 that of (w_i. + w_.i)^2 over cells, all by aggregates; kurtosis
    is that of the values. Null variance for fewer than four cells or values all alike.
    """
    z = materialize(centred(cells, weights, value).select("lat_idx", "lon_idx", "z", "lag_z"))
    z2 = F.col("z") * F.col("z")
    m = z.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("lag_z")).alias("zl"), F.sum(z2).alias("zz"), F.sum(z2 * z2).alias("z4"))
    src, dst = F.struct(F.col("src_lat").alias("lat"), F.col("src_lon").alias("lon")), F.struct(F.col("dst_lat").alias("lat"), F.col("dst_lon").alias("lon"))
    pair = weights.groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).agg(F.sum("w").alias("w"))
    s1 = pair.agg(F.sum(F.col("w") * F.col("w")).alias("s1"), F.sum("w").alias("s0"))
    ends = weights.select(src.alias("at"), "w").union(weights.select(dst.alias("at"), "w")).groupBy("at").agg(F.sum("w").alias("w"))
    s2 = ends.agg(F.sum(F.col("w") * F.col("w")).alias("s2"))
    x = m.crossJoin(s1).crossJoin(s2)  # one row each
    n, s0, s1, s2, expected = F.col("n").cast("double"), F.col("s0"), F.col("s1"), F.col("s2"), -1.0 / (F.col("n") - 1)
    k = n * F.col("z4") / (F.col("zz") * F.col("zz"))
    second = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0)
    known = (F.col("n") > 3) & (F.col("zz") > 0)
    out = x.select("n", F.when(F.col("zz") > 0, n / s0 * F.col("zl") / F.col("zz")).alias("moran_i"), expected.alias("expected_i"), F.when(known, second - expected * expected).alias("variance"))
    out = out.withColumn("z_norm", F.when(F.col("variance") > 0, (F.col("moran_i") - F.col("expected_i")) / F.sqrt("variance")))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p_norm=[normal_tail(v) for v in pdf["z_norm"]])

    return out.mapInPandas(tails, "n long, moran_i double, expected_i double, variance double, z_norm double, p_norm double")


def _indexed(cells: DataFrame, weights: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """z and the neighbours' positions of a bounded set of cells, for permutations."""
    if cells.limit(PERMUTED_CELLS + 1).count() > PERMUTED_CELLS:
        raise ValueError("too many cells to shuffle on arrays: use moran_moments, or moran_test and summary with shuffles=0")
    c = cells.select("lat_idx", "lon_idx", F.col(value).cast("double").alias("v")).toPandas().sort_values(["lat_idx", "lon_idx"]).reset_index(drop=True)
    e = weights.select("src_lat", "src_lon", "dst_lat", "dst_lon", "rank").toPandas()
    at = pd.Series(c.index, index=pd.MultiIndex.from_frame(c[["lat_idx", "lon_idx"]]))
    e["s"], e["d"] = at.loc[list(zip(e.src_lat, e.src_lon))].to_numpy(), at.loc[list(zip(e.dst_lat, e.dst_lon))].to_numpy()
    k = int(e["rank"].max())
    near = e.sort_values(["s", "rank"])["d"].to_numpy().reshape(len(c), k)
    return (c["v"] - c["v"].mean()).to_numpy(), near, c


def moran_permutations(cells: DataFrame, weights: DataFrame, value: str, permutations: int = 999, seed: int = 42) -> DataFrame:
    """(moran_i, expected_i, p_sim, z_sim): each task shuffles the values for its permutation numbers."""
    z, near, _ = _indexed(cells, weights, value)
    spark = cells.sparkSession
    sent, zz = spark.sparkContext.broadcast((z, near)), float((z * z).sum())
    observed = float((z * z[near].mean(axis=1)).sum() / zz)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, near = sent.value
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                p = np.random.default_rng([seed, int(i)]).permutation(z)
                out.append(float((p * p[near].mean(axis=1)).sum() / zz))
            yield pd.DataFrame({"i": out})

    s = spark.range(permutations).repartition(16).mapInPandas(run, "i double").agg(F.count_if(F.col("i") >= observed).alias("over"), F.avg("i").alias("m"), F.stddev_pop("i").alias("s"))
    over = F.least(F.col("over"), permutations - F.col("over"))
    return s.select(F.lit(observed).alias("moran_i"), F.lit(-1.0 / (len(z) - 1)).alias("expected_i"), ((over + 1) / (permutations + 1)).alias("p_sim"), ((F.lit(observed) - F.col("m")) / F.col("s")).alias("z_sim"))


def local_moran(cells: DataFrame, weights: DataFrame, value: str) -> DataFrame:
    """Add local_i = (n-1) z lag / sum z^2 and the quadrant of (z, lag): 1 HH, 2 LH, 3 LL, 4 HL."""
    c = centred(cells, weights, value)
    s = c.agg((F.sum(F.col("z") * F.col("z")) / (F.count("*") - 1)).alias("_s"))
    quadrant = F.when((F.col("z") > 0) & (F.col("lag_z") > 0), 1).when((F.col("z") <= 0) & (F.col("lag_z") > 0), 2).when((F.col("z") <= 0) & (F.col("lag_z") <= 0), 3).otherwise(4)
    return c.crossJoin(F.broadcast(s)).withColumn("local_i", F.col("z") * F.col("lag_z") / F.col("_s")).withColumn("quadrant", quadrant).drop("_s")


def distinct_draws(rng: np.random.Generator, n: int, rows: int, k: int) -> np.ndarray:
    """Rows of k different numbers below n, every such set alike; for few numbers from whole permutations, else by drawing clashing rows anew."""
    if n < 4 * k * k:
        return rng.permuted(np.tile(np.arange(n), (rows, 1)), axis=1)[:, :k]
    draw = rng.integers(0, n, (rows, k))
    while True:
        ordered = np.sort(draw, axis=1)
        clash = (ordered[:, 1:] == ordered[:, :-1]).any(axis=1)
        if not clash.any():
            return draw
        draw[clash] = rng.integers(0, n, (int(clash.sum()), k))


def local_permutations(cells: DataFrame, weights: DataFrame, value: str, permutations: int = 999, seed: int = 42) -> DataFrame:
    """(lat_idx, lon_idx, p_sim) by conditional permutation, for any number of cells.

    Each permutation draws k + 1 different cells by their numbers, k being the number of neighbours. The mean of the first k is a lag under the null
    for every cell but those k; for them the last one stands in. So all cells share one short list of lags, and only the drawn cells, at most k for
    a permutation, have others of their own; what is joined and broadcast grows with the permutations, not with the cells.
    """
    own = ranked(centred(cells, weights, value).select("lat_idx", "lon_idx", "z", "lag_z"), [F.asc("lat_idx"), F.asc("lon_idx")], "no")
    n, k = own.count(), int(weights.agg(F.max("rank")).first()[0] or 0)
    if k == 0:
        return cells.select("lat_idx", "lon_idx", F.lit(1.0).alias("p_sim"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["id"].tolist():
                yield pd.DataFrame({"p": p, "no": distinct_draws(np.random.default_rng([seed, p]), n, 1, k + 1)[0] + 1, "j": range(k + 1)})

    draws = materialize(own.sparkSession.range(permutations).repartition(16).mapInPandas(draw, "p long, no long, j long"))
    values = own.select("no", "z").join(F.broadcast(draws), "no")
    lags = materialize(values.groupBy("p").agg((F.sum(F.when(F.col("j") < k, F.col("z"))) / k).alias("lag"), F.max(F.when(F.col("j") == k, F.col("z"))).alias("spare")))
    swapped = values.where(F.col("j") < k).join(F.broadcast(lags), "p").select("no", F.struct(F.col("lag").alias("old"), (F.col("lag") + (F.col("spare") - F.col("z")) / k).alias("new")).alias("swap"))
    swaps = swapped.groupBy("no").agg(F.collect_list("swap").alias("swaps"))  # one for each permutation at most
    every = lags.agg(F.collect_list("lag").alias("lags"))
    z, least = F.col("z"), F.col("z") * F.col("lag_z")
    own_swaps = F.coalesce("swaps", F.array().cast("array<struct<old:double,new:double>>"))
    over = F.size(F.filter("lags", lambda x: z * x >= least)) - F.size(F.filter(own_swaps, lambda s: z * s["old"] >= least)) + F.size(F.filter(own_swaps, lambda s: z * s["new"] >= least))
    x = own.join(F.broadcast(swaps), "no", "left").crossJoin(F.broadcast(every)).withColumn("_over", over)
    return x.select("lat_idx", "lon_idx", ((F.least("_over", permutations - F.col("_over")) + 1) / (permutations + 1)).alias("p_sim"))


def lisa(cells: DataFrame, weights: DataFrame, value: str, permutations: int = 999, seed: int = 42) -> DataFrame:
    p = local_permutations(cells, weights, value, permutations, seed)
    return local_moran(cells, weights, value).join(p, ["lat_idx", "lon_idx"]).withColumn("lisa_cluster", lisa_label(F.col("quadrant"), F.col("p_sim")))


def scatter_line(cells: DataFrame, weights: DataFrame, value: str) -> DataFrame:
    """Slope and intercept of the lag on the value, with both means."""
    x, y = F.col(value).cast("double"), F.col("lag")
    return spatial_lag(cells, weights, value).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(x).alias("mean_value"), F.avg(y).alias("mean_lag"))


def getis_ord(cells: DataFrame, weights: DataFrame, value: str) -> DataFrame:
    """Add gi_star (Getis and Ord 1992, the cell itself included, binary weights) and its level of significance."""
    v = F.col(value).cast("double")
    own = weights.select("src_lat", "src_lon", "dst_lat", "dst_lon").union(cells.select(F.col("lat_idx"), F.col("lon_idx"), F.col("lat_idx"), F.col("lon_idx")))
    x = cells.select(F.col("lat_idx").alias("dst_lat"), F.col("lon_idx").alias("dst_lon"), v.alias("_v"))
    s = own.join(x, ["dst_lat", "dst_lon"]).groupBy(F.col("src_lat").alias("lat_idx"), F.col("src_lon").alias("lon_idx")).agg(F.sum("_v").alias("_s"), F.count("*").alias("_w"))
    g = cells.agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_sd"), F.count("*").alias("_n"))
    z = (F.col("_s") - F.col("_m") * F.col("_w")) / (F.col("_sd") * F.sqrt((F.col("_n") * F.col("_w") - F.col("_w") * F.col("_w")) / (F.col("_n") - 1)))
    out = cells.join(s, ["lat_idx", "lon_idx"]).crossJoin(F.broadcast(g)).withColumn("gi_star", z)
    level = F.when(F.abs("gi_star") >= 3.29, "p001").when(F.abs("gi_star") >= 2.58, "p01").when(F.abs("gi_star") >= 1.96, "p05").otherwise("ns")
    return out.withColumn("significance", level).drop("_s", "_w", "_m", "_sd", "_n")


def getis_ord_by(cells: DataFrame, by: list[str], value: str, reach: int = 1) -> DataFrame:
    """Add gi_star of each cell among those of its group: the cell and the cells of the group at most `reach` steps away, with binary weights.

    Null where a group's values are all alike or every cell is a neighbour of all.
    """
    v, keys = F.col(value).cast("double"), [*by, "lat_idx", "lon_idx"]
    left = cells.select(*keys, F.explode(offsets(2, reach)).alias("_o")).select(*by, F.col("lat_idx").alias("_i"), F.col("lon_idx").alias("_j"), (F.col("lat_idx") + F.col("_o")[0]).alias("lat_idx"), (F.col("lon_idx") + F.col("_o")[1]).alias("lon_idx"))
    sums = left.join(cells.select(*keys, v.alias("_v")), keys).groupBy(*by, F.col("_i").alias("lat_idx"), F.col("_j").alias("lon_idx")).agg(F.sum("_v").alias("_s"), F.count("*").alias("_w"))
    whole = cells.groupBy(*by).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_sd"), F.count("*").alias("_n"))
    scale = F.col("_sd") * F.sqrt((F.col("_n") * F.col("_w") - F.col("_w") * F.col("_w")) / F.nullif(F.col("_n") - 1, F.lit(0)))
    z = (F.col("_s") - F.col("_m") * F.col("_w")) / F.nullif(scale, F.lit(0.0))
    return cells.join(sums, keys).join(F.broadcast(whole), by).withColumn("gi_star", z).drop("_s", "_w", "_m", "_sd", "_n")


def moran_test(cells: DataFrame, weights: DataFrame, value: str, shuffles: int = 999) -> DataFrame:
    """moran_moments with p_sim and z_sim of moran_permutations, or null where `shuffles` is 0: for more cells than can be shuffled the moments answer."""
    m = moran_moments(cells, weights, value)
    if not shuffles:
        return m.withColumns({"p_sim": F.lit(None).cast("double"), "z_sim": F.lit(None).cast("double")})
    return m.crossJoin(moran_permutations(cells, weights, value, shuffles).select("p_sim", "z_sim"))


def summary(cells: DataFrame, weights: DataFrame, value: str, permutations: int = 999, shuffles: int | None = None) -> DataFrame:
    """One row with Moran's I, its moments, p and z, and a map of cells by LISA label. `shuffles` is for the whole pattern, as many as `permutations` unless given."""
    labels = materialize(lisa(cells, weights, value, permutations)).groupBy("lisa_cluster").agg(F.count("*").alias("n"))
    counts = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lisa_cluster", "n")))).alias("lisa_counts"))
    return moran_test(cells, weights, value, permutations if shuffles is None else shuffles).crossJoin(counts)


def normal_tail(z: float) -> float:
    """Two-sided p of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))

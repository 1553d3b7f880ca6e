"""Point-pattern statistics: kernel density, nearest neighbours, Ripley's K and density-based clusters."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake.functions.scalar import EARTH_KM, haversine_km, unit_vector
from gridwake.operators.grid import at_least_percentile
from gridwake.operators.neighbors import nearest_neighbour, offsets, planar_pairs
from gridwake.tables import connected, materialize, met, small

CELL_SIDE, SERIES = 0.4, 12  # cells of the density in bandwidths, and terms of its series along each axis
BLOCK_CELLS = 20  # eight bandwidths
HELD_CELLS = 4096
PAIRS = 4096  # pairs of places that two boxes may have to be settled point by point


def ranked(cells: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their rank from 1 in the given order, from sorted range partitions and their sizes, so that no task sorts all rows."""
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(cells.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row for each partition
    return placed.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, (F.col("_b") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_p", "_b", "_at")


def ranked_hotspots(cells: DataFrame, p: float = 0.95) -> DataFrame:
    """Cells at or over the percentile of density_sum, ranked by intensity_sum, ties by cell."""
    return ranked(at_least_percentile(cells, "density_sum", p), [F.desc("intensity_sum"), F.asc("lat_idx"), F.asc("lon_idx")], "hotspot_rank")


def _derivatives(u: np.ndarray, order: int) -> np.ndarray:
    """Derivatives 0 to order - 1 of exp(-u^2 / 2), along a new last axis: (-1)^m He_m(u) exp(-u^2 / 2)."""
    he = [np.ones_like(u), u]
    for m in range(1, order - 1):
        he.append(u * he[m] - m * he[m - 1])
    return np.stack([(-1) ** m * h for m, h in enumerate(he[:order])], axis=-1) * np.exp(-u * u / 2)[..., None]


def _local_series(pdf: pd.DataFrame, block: tuple[int, int]) -> pd.DataFrame:
    """The density's Taylor coefficients about the centres of a block's cells, from the moments of the cells of the nine blocks around."""
    p, n = SERIES, BLOCK_CELLS
    own = (pdf["cx"] // n == block[0]) & (pdf["cy"] // n == block[1])
    if not own.any():
        return pd.DataFrame({"cx": [], "cy": [], "series": []}).astype({"cx": "int64", "cy": "int64", "series": object})
    x, y = ((pdf[c].to_numpy() - (b - 1) * n) for c, b in zip(("cx", "cy"), block))
    held = np.zeros((3 * n, p, 3 * n, p))
    held[x, :, y, :] = pdf[[f"m{i}" for i in range(p * p)]].to_numpy().reshape(-1, p, p)
    # From a source cell at i to a target cell at n + j, for the k-th moment and the a-th coefficient.
    gap = (n + np.arange(n)[:, None] - np.arange(3 * n)) * CELL_SIDE
    d = _derivatives(gap, 2 * p - 1)
    k = np.arange(p)
    factor = np.array([(-1.0) ** i / math.factorial(i) for i in range(p)])
    shift = (d[:, :, k[:, None] + k] * factor).transpose(0, 2, 1, 3).reshape(n * p, 3 * n * p)
    found = (shift @ held.reshape(3 * n * p, 3 * n * p) @ shift.T).reshape(n, p, n, p)
    tx, ty = x[own] - n, y[own] - n
    return pd.DataFrame({"cx": pdf["cx"][own].to_numpy(), "cy": pdf["cy"][own].to_numpy(), "series": list(found[tx, :, ty, :].reshape(-1, p * p))})


def kernel_density(points: DataFrame, weight: str) -> DataFrame:
    """Add kde_score, a weighted Gaussian density at the points with Scott's bandwidth, and it over its maximum, for any number of points.

    In coordinates in which the kernel is round, points lie in cells of 0.4 bandwidths. Cells send on the moments of their weights, blocks of cells turn those of
    the blocks around into the density's Taylor series in each cell, and points read theirs off: the sum over all points, but for terms over order SERIES, under
    1e-10 of the kernel's height (Cramer's bound), and for points over eight bandwidths away, under 1e-13 of it.
    """
    w, x, y = F.col(weight).cast("double"), F.col("longitude"), F.col("latitude")
    m = points.agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), (F.sum(w * x) / F.sum(w)).alias("mx"), (F.sum(w * y) / F.sum(w)).alias("my")).first()
    if not m["w"]:
        return points.withColumns({"kde_score": F.lit(None).cast("double"), "kde_score_norm": F.lit(None).cast("double")})
    v2 = m["w2"] / m["w"] ** 2
    c = points.agg(F.sum(w * (x - m["mx"]) * (x - m["mx"])).alias("xx"), F.sum(w * (x - m["mx"]) * (y - m["my"])).alias("xy"), F.sum(w * (y - m["my"]) * (y - m["my"])).alias("yy")).first()
    h = np.array([[c["xx"], c["xy"]], [c["xy"], c["yy"]]]) / m["w"] / (1 - v2) * (1 / v2) ** (-2 / 6)
    root, norm = np.linalg.cholesky(h), 2 * math.pi * math.sqrt(np.linalg.det(h))
    zx = (x - m["mx"]) / float(root[0, 0])
    zy = ((y - m["my"]) - zx * float(root[1, 0])) / float(root[1, 1])
    placed = points.withColumns({"_zx": zx / CELL_SIDE, "_zy": zy / CELL_SIDE}).withColumns({"cx": F.floor("_zx").cast("long"), "cy": F.floor("_zy").cast("long")})
    placed = placed.withColumns({"_dx": (F.col("_zx") - F.col("cx") - 0.5) * CELL_SIDE, "_dy": (F.col("_zy") - F.col("cy") - 0.5) * CELL_SIDE})
    names = [f"m{i}" for i in range(SERIES * SERIES)]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def out() -> pd.DataFrame:
            full = pd.DataFrame(np.array(list(held.values())).reshape(-1, len(names)), columns=names)
            full.insert(0, "cy", [k[1] for k in held])
            full.insert(0, "cx", [k[0] for k in held])
            held.clear()
            return full

        for pdf in batches:
            powers = [np.vander(pdf[d].to_numpy(np.float64), SERIES, increasing=True) for d in ("_dx", "_dy")]
            each = (powers[0] * pdf["w"].to_numpy(np.float64)[:, None])[:, :, None] * powers[1][:, None, :]
            cells, at = np.unique(pdf[["cx", "cy"]].to_numpy(np.int64), axis=0, return_inverse=True)
            sums = np.zeros((len(cells), SERIES * SERIES))
            np.add.at(sums, at.ravel(), each.reshape(len(pdf), -1))
            for key, s in zip(map(tuple, cells.tolist()), sums):
                held[key] = held[key] + s if key in held else s
            if len(held) > HELD_CELLS:
                yield out()
        if held:
            yield out()

    sums = placed.select("cx", "cy", "_dx", "_dy", (w / m["w"]).alias("w")).mapInPandas(moments, "cx long, cy long, " + ", ".join(f"{n} double" for n in names))
    cells = materialize(sums.groupBy("cx", "cy").agg(*[F.sum(n).alias(n) for n in names]))
    around = cells.withColumn("_o", F.explode(offsets(2))).withColumns({"bx": F.floor(F.col("cx") / BLOCK_CELLS) + F.col("_o")[0], "by": F.floor(F.col("cy") / BLOCK_CELLS) + F.col("_o")[1]}).drop("_o")
    series = materialize(around.groupBy("bx", "by").applyInPandas(lambda key, pdf: _local_series(pdf, key), "cx long, cy long, series array<double>"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor = np.array([1.0 / math.factorial(i) for i in range(SERIES)])
        for pdf in batches:
            if len(pdf):
                px, py = (np.vander(pdf[d].to_numpy(np.float64), SERIES, increasing=True) * factor for d in ("_dx", "_dy"))
                s = np.array(pdf["series"].tolist()).reshape(-1, SERIES, SERIES)
                yield pdf.drop(columns=["_dx", "_dy", "series"]).assign(kde_score=np.einsum("na,nab,nb->n", px, s, py) / norm)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    at = placed.join(small(series, 8 * len(names) + 64), ["cx", "cy"]).select(*points.columns, "_dx", "_dy", "series")
    scored = materialize(at.mapInPandas(read, f"{fields}, kde_score double"))
    top = scored.agg(F.max("kde_score").alias("_m"))
    return scored.crossJoin(F.broadcast(top)).withColumn("kde_score_norm", F.col("kde_score") / F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)).drop("_m")


def nearest_neighbour_ratio(points: DataFrame) -> DataFrame:
    """Observed mean nearest-neighbour distance, the one expected of random points in the bounding box, and their ratio."""
    box = points.agg(F.count("*").alias("n"), F.min("longitude").alias("w"), F.max("longitude").alias("e"), F.min("latitude").alias("s"), F.max("latitude").alias("nn"))
    near = nearest_neighbour(points).agg(F.avg("km").alias("observed"))
    deg = math.pi * EARTH_KM / 180
    area = F.greatest(F.lit(1.0), (F.col("e") - F.col("w")) * deg * F.cos(F.radians("s")) * (F.col("nn") - F.col("s")) * deg)
    x = box.crossJoin(near).withColumn("expected", F.when(F.col("n") < 2, 0.0).otherwise(0.5 / F.sqrt(F.col("n") / area))).withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    return x.select("n", F.col("observed").alias("observed_km"), F.col("expected").alias("expected_km"), F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")).alias("ratio"))


def radii(lo: float = 0.2, hi: float = 6.0, steps: int = 20) -> list[float]:
    return [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]


def _pair_counts(points: DataFrame, at: list[float], by: list[str]) -> DataFrame:
    """(by, i, within): for each pattern and radius how many ordered pairs of different points lie within it, from bucketed joins."""
    key, reach = [F.col(c) for c in by], max(at)
    first = F.size(F.filter(F.array(*[F.lit(r) for r in at]), lambda r: r < F.col("dist")))
    pairs = planar_pairs(points, reach, "id", by).select(*key, first.alias("i")).groupBy(*key, "i").agg(F.count("*").alias("pairs"))
    every = points.select(*key).distinct() if by else points.sparkSession.range(1).select()
    steps = every.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(at) - 1))))
    total = steps.join(pairs, [*by, "i"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    return total.select(*key, "i", F.sum("pairs").over(Window.partitionBy(*key).orderBy("i")).alias("within"))  # a row for each radius


def ripley_k(points: DataFrame, at: list[float] | None = None) -> DataFrame:
    """(radius, k) with K = area x ordered pairs within the radius / n^2 in degrees; no rows for fewer than 20 points."""
    at = radii() if at is None else at
    box = points.agg(F.count("*").alias("n"), ((F.max("longitude") - F.min("longitude")) * (F.max("latitude") - F.min("latitude"))).alias("area"))
    radius = F.element_at(F.array(*[F.lit(r) for r in at]), F.col("i") + 1)
    total = _pair_counts(points, at, [])
    return total.crossJoin(F.broadcast(box)).where("n >= 20").select(radius.alias("radius"), (F.col("area") * F.col("within") / (F.col("n") * F.col("n"))).alias("k"))


def random_patterns(spark: SparkSession, simulations: int, n: int, box: tuple[float, float, float, float], seed: int = 42) -> DataFrame:
    """(sim, id, longitude, latitude): n uniform points in (west, east, south, north) for each simulation, each from a hash of its own numbers."""
    w, e, s, t = box
    draw = lambda axis: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("sim"), F.col("id"), F.lit(axis)), 11) * 2.0**-53
    at = spark.range(simulations * n).select(F.floor(F.col("id") / n).cast("long").alias("sim"), (F.col("id") % n).alias("id"))
    return at.select("sim", "id", (F.lit(w) + draw(0) * (e - w)).alias("longitude"), (F.lit(s) + draw(1) * (t - s)).alias("latitude"))


def ripley_p(points: DataFrame, simulations: int = 199, seed: int = 42, at: list[float] | None = None) -> DataFrame:
    """(radius, k, p_value): the share of random patterns in the bounding box with at least the observed K.

    All simulations are one table of points and one bucketed join, so neither a task nor the driver holds a pattern.
    """
    at = radii() if at is None else at
    observed = materialize(_pair_counts(points, at, []))
    b = points.agg(F.count("*").alias("n"), F.min("longitude").alias("w"), F.max("longitude").alias("e"), F.min("latitude").alias("s"), F.max("latitude").alias("t")).first()
    n = b["n"]
    if n < 20:
        return ripley_k(points, at).withColumn("p_value", F.lit(None).cast("double"))
    drawn = _pair_counts(random_patterns(points.sparkSession, simulations, n, (b["w"], b["e"], b["s"], b["t"]), seed), at, ["sim"])
    over = drawn.withColumnRenamed("within", "drawn").join(F.broadcast(observed), "i").groupBy("i").agg(F.count_if(F.col("drawn") >= F.col("within")).alias("over"))
    area = float((b["e"] - b["w"]) * (b["t"] - b["s"]))
    radius = F.element_at(F.array(*[F.lit(r) for r in at]), F.col("i") + 1)
    return observed.join(over, "i").select(radius.alias("radius"), (F.lit(area) * F.col("within") / (n * n)).alias("k"), ((F.col("over") + 1) / (simulations + 1)).alias("p_value"))


class _Space:
    """Where points lie for clustering: coordinates u0, u1, .. in which distances are straight, cells c0, c1, .. whose points are all within eps, and the test of a pair."""

    def __init__(self, eps: float, metric: str):
        self.eps, self.sphere = eps, metric == "haversine"
        self.dims = 3 if self.sphere else 2
        self.radius = 2 * math.sin(min(math.pi / 2, eps / (2 * EARTH_KM))) if self.sphere else eps
        self.side = self.radius / math.sqrt(self.dims) * (1 - 1e-9)
        self.u, self.c = [f"u{i}" for i in range(self.dims)], [f"c{i}" for i in range(self.dims)]

    def place(self, points: DataFrame, rank: str) -> DataFrame:
        x, y = F.col("longitude").cast("double"), F.col("latitude").cast("double")
        at = unit_vector(x, y) if self.sphere else (x, y)
        p = points.where(~F.isnan(x) & ~F.isnan(y)).select(F.col(rank).alias("id"), "longitude", "latitude", *[v.alias(n) for v, n in zip(at, self.u)])
        return p.withColumns({c: F.floor(F.col(u) / self.side).cast("long") for c, u in zip(self.c, self.u)})

    def near(self, a: str, b: str) -> Column:
        lon, lat, lon2, lat2 = (F.col(f"{p}{n}") for p in (a, b) for n in ("longitude", "latitude"))
        return haversine_km(lon, lat, lon2, lat2) <= self.eps if self.sphere else F.sqrt(F.pow(lon - lon2, 2) + F.pow(lat - lat2, 2)) <= self.eps

    def around(self, points: DataFrame, others: DataFrame, n: int, keep: list[str]) -> DataFrame:
        """Each point with the n others within eps, itself too if among them, from the cells around; `keep` names columns of the others, prefixed with o_."""
        left = points.select("id", "longitude", "latitude", *self.c, F.explode(offsets(self.dims, 2)).alias("_o")).withColumns({c: F.col(c) + F.col("_o")[i] for i, c in enumerate(self.c)})
        right = others.select(*self.c, *[F.col(n).alias(f"o_{n}") for n in ("longitude", "latitude", *keep)])
        return left.join(met(right, n), self.c).where(self.near("", "o_"))


def _linked_cells(spots: DataFrame, nodes: DataFrame, n: int, space: _Space) -> DataFrame:
    """(a, b): the pairs of cells' nodes with core points within eps of each other, one for each pair of cells. There are at most n nodes and n spots.

    Boxes around the core points of two cells decide most pairs: the greatest distance within eps links them, the least over eps parts them. Boxes with
    few places are settled by their points; the rest are halved and compared again, so that two crowded cells never meet point by point.
    """
    u, c, r = space.u, space.c, space.radius

    def boxes(level: int, prefix: str) -> DataFrame:
        part = [F.floor(F.col(x) / space.side * 2**level).cast("long").alias(f"{prefix}s{i}") for i, x in enumerate(u)]
        return spots.groupBy(*part).agg(*[F.min(x).alias(f"{prefix}lo{i}") for i, x in enumerate(u)], *[F.max(x).alias(f"{prefix}hi{i}") for i, x in enumerate(u)], F.count("*").alias(f"{prefix}n"))

    def parts(prefix: str) -> list[str]:
        return [f"{prefix}s{i}" for i in range(space.dims)]

    def spread(far: bool) -> Column:
        gaps = []
        for i in range(space.dims):
            lo, hi, lo2, hi2 = (F.col(f"{p}{n}{i}") for p in "lr" for n in ("lo", "hi"))
            gaps.append(F.greatest(hi2 - lo, hi - lo2) if far else F.greatest(F.lit(0.0), lo2 - hi, lo - hi2))
        return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))

    named = nodes.select(*[F.col(x).alias(f"_s{i}") for i, x in enumerate(c)], "node")
    side = {p: boxes(0, p).join(met(named.withColumnsRenamed({f"_s{i}": f"{p}s{i}" for i in range(space.dims)}), n), parts(p)).withColumnRenamed("node", end) for p, end in (("l", "a"), ("r", "b"))}
    ahead = side["l"].withColumn("_o", F.explode(offsets(space.dims, 2))).withColumns({f"rs{i}": F.col(f"ls{i}") + F.col("_o")[i] for i in range(space.dims)}).drop("_o")
    open_pairs, found, level = materialize(ahead.join(met(side["r"], n), parts("r")).where("a < b")), [], 0
    pairs = open_pairs.count()
    while True:
        close = open_pairs.where(spread(False) <= r * (1 + 1e-9))
        sure = close.where(spread(True) <= r * (1 - 1e-9)).select("a", "b").distinct()
        open_pairs = materialize(close.join(met(sure, pairs), ["a", "b"], "left_anti"))
        few = open_pairs.where(F.col("ln") * F.col("rn") <= PAIRS)
        at = {p: spots.select("longitude", "latitude", *[F.floor(F.col(x) / space.side * 2**level).cast("long").alias(f"{p}s{i}") for i, x in enumerate(u)]).withColumnsRenamed({"longitude": f"{p}longitude", "latitude": f"{p}latitude"}) for p in "lr"}
        settled = few.select("a", "b", *parts("l"), *parts("r")).join(met(at["l"], n), parts("l")).join(met(at["r"], n), parts("r")).where(space.near("l", "r")).select("a", "b").distinct()
        found.append(materialize(sure.union(settled)))
        many = open_pairs.where(F.col("ln") * F.col("rn") > PAIRS).join(met(found[-1], pairs), ["a", "b"], "left_anti").select("a", "b", *parts("l"), *parts("r"))
        level += 1
        for p in "lr":
            finer = boxes(level, p).withColumns({f"_{x}": F.shiftright(x, 1) for x in parts(p)})
            many = many.withColumnsRenamed({x: f"_{x}" for x in parts(p)}).join(met(finer, n), [f"_{x}" for x in parts(p)]).drop(*[f"_{x}" for x in parts(p)])
        open_pairs = materialize(many)
        pairs = open_pairs.count()
        if not pairs:
            return functools.reduce(DataFrame.union, found).distinct()


def dbscan(points: DataFrame, eps: float = 150.0, min_samples: int = 6, metric: str = "haversine", rank: str = "hotspot_rank") -> DataFrame:
    """Add cluster_id (-1 for noise) and is_noise.

    Points lie in cells so small that all points of one are neighbours. A cell with min_samples points holds cores only; the others' points, fewer than
    min_samples in a cell, count the neighbours in the cells around, themselves included. So work is linear in the points however crowded a cell
    is. Clusters are the connected components of cells with cores; a border point goes to its smallest cluster. Clusters are numbered by the
    smallest rank of their cores. `rank` is unique; points without coordinates are noise.
    """
    space = _Space(eps, metric)
    p = materialize(space.place(points, rank))
    n = p.count()
    sizes = p.groupBy(*space.c).agg(F.count("*").alias("n"))
    sized = materialize(p.join(met(sizes, n), space.c))
    sparse = sized.where(F.col("n") < min_samples).drop("n")
    crowd = space.around(sparse, p, n, []).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("id")
    cores = materialize(sized.where(F.col("n") >= min_samples).drop("n").unionByName(sparse.join(met(crowd, n), "id", "left_semi")))
    k = cores.count()
    nodes = materialize(cores.groupBy(*space.c).agg(F.min("id").alias("node")))
    spots = materialize(cores.select("longitude", "latitude", *space.u).distinct())
    joined = connected(_linked_cells(spots, nodes, k, space))
    roots = materialize(nodes.join(met(joined, k), nodes["node"] == joined["id"], "left").select(*space.c, F.coalesce("root", "node").alias("root")))
    numbers = ranked(roots.select("root").distinct(), [F.asc("root")], "_number").select("root", (F.col("_number") - 1).cast("int").alias("cluster_id"))
    of_core = materialize(cores.join(met(roots, k), space.c).join(met(numbers, k), "root").select("id", "longitude", "latitude", *space.c, "cluster_id"))
    border = space.around(sparse.join(met(cores, k), "id", "left_anti"), of_core, k, ["cluster_id"]).groupBy("id").agg(F.min("o_cluster_id").alias("cluster_id"))
    label = of_core.select("id", "cluster_id").unionByName(border).withColumnRenamed("id", "_id")
    out = points.join(met(label, n), F.col(rank) == F.col("_id"), "left").drop("_id").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    return out.withColumn("is_noise", F.col("cluster_id") < 0)


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Centroid, bounding box, total, maximum and size of each cluster."""
    c = clustered.where("cluster_id >= 0").groupBy("cluster_id")
    return c.agg(F.avg("longitude").alias("centre_lon"), F.avg("latitude").alias("centre_lat"), F.min("longitude").alias("west"), F.max("longitude").alias("east"), F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.sum("density_sum").alias("total_density"), F.max("density_sum").alias("max_density"), F.count("*").alias("size"))


def cluster_counts(clustered: DataFrame) -> DataFrame:
    """Clusters, noise points and sizes by cluster as a map, in one row."""
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col("cluster_id") >= 0).alias("clusters"), F.coalesce(F.sum(F.when(F.col("cluster_id") < 0, F.col("n"))), F.lit(0)).alias("noise"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("cluster_id", "n")))).alias("sizes"))

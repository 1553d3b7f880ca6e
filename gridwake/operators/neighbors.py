"""Neighbour joins on points and grids, by bucketed equi-joins with exact filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions.scalar import EARTH_KM, haversine_km, unit_vector
from gridwake.tables import BROADCAST_BYTES, materialize, small

DESCENT = 2  # doublings of the cells' size from one level of a search to the next
CHORD = 1 / 64  # edge of the cubes in which the nearest of a set is searched, about 100 km


def offsets(dims: int, reach: int = 1) -> Column:
    """All steps of at most `reach` along each of `dims` axes, as an array of arrays."""
    span = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    out = F.transform(span, lambda a: F.array(a))
    for _ in range(dims - 1):
        out = F.flatten(F.transform(out, lambda v: F.transform(span, lambda a: F.concat(v, F.array(a)))))
    return out


def radius_pairs(points: DataFrame, km: float, id_col: str = "id") -> DataFrame:
    """(a, b, km) for all ordered pairs of different points within a great-circle radius.

    Points are put in cubes of the radius' chord in three dimensions, so that neither poles nor the antimeridian are special; each looks
    into the 27 cubes around its own.
    """
    chord = 2 * math.sin(min(math.pi / 2, km / (2 * EARTH_KM)))
    x, y, z = unit_vector(F.col("longitude"), F.col("latitude"))
    p = points.select(F.col(id_col).alias("id"), "longitude", "latitude", *[F.floor(c / chord).cast("int").alias(n) for n, c in (("cx", x), ("cy", y), ("cz", z))])
    left = p.withColumn("o", F.explode(offsets(3))).select(F.col("id").alias("a"), F.col("longitude").alias("lon_a"), F.col("latitude").alias("lat_a"), *[(F.col(n) + F.col("o")[i]).alias(n) for i, n in enumerate(("cx", "cy", "cz"))])
    right = p.withColumnsRenamed({"id": "b", "longitude": "lon_b", "latitude": "lat_b"})
    d = haversine_km(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    return left.join(right, ["cx", "cy", "cz"]).where("a <> b").select("a", "b", d.alias("km")).where(F.col("km") <= km)


def planar_pairs(points: DataFrame, radius: float, id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """(a, b, dist) for all ordered pairs of different points within a radius in degrees, of the same pattern where `by` names its columns."""
    by = by or []
    p = points.select(*by, F.col(id_col).alias("id"), "longitude", "latitude", F.floor(F.col("longitude") / radius).cast("int").alias("cx"), F.floor(F.col("latitude") / radius).cast("int").alias("cy"))
    left = p.withColumn("o", F.explode(offsets(2))).select(*by, F.col("id").alias("a"), F.col("longitude").alias("lon_a"), F.col("latitude").alias("lat_a"), (F.col("cx") + F.col("o")[0]).alias("cx"), (F.col("cy") + F.col("o")[1]).alias("cy"))
    right = p.withColumnsRenamed({"id": "b", "longitude": "lon_b", "latitude": "lat_b"})
    d = F.sqrt(F.pow(F.col("lon_a") - F.col("lon_b"), 2) + F.pow(F.col("lat_a") - F.col("lat_b"), 2))
    return left.join(right, [*by, "cx", "cy"]).where("a <> b").select(*by, "a", "b", d.alias("dist")).where(F.col("dist") <= radius)


def nearest_neighbour(points: DataFrame, id_col: str = "id", start_km: float = 100.0) -> DataFrame:
    """(id, km) to the nearest other point, by radius joins of doubling size for those that have none yet."""
    todo, done, km = points, None, start_km
    while True:
        near = radius_pairs_between(todo, points, km, id_col).groupBy("a").agg(F.min("km").alias("km")).select(F.col("a").alias("id"), "km")
        near = materialize(near)
        done = near if done is None else done.union(near)
        todo = materialize(todo.join(near, todo[id_col] == near["id"], "left_anti"))
        if km > math.pi * EARTH_KM or todo.isEmpty():
            return done
        km *= 4


def radius_pairs_between(some: DataFrame, others: DataFrame, km: float, id_col: str) -> DataFrame:
    """radius_pairs with the first point from `some` only."""
    chord = 2 * math.sin(min(math.pi / 2, km / (2 * EARTH_KM)))

    def placed(d: DataFrame) -> DataFrame:
        x, y, z = unit_vector(F.col("longitude"), F.col("latitude"))
        return d.select(F.col(id_col).alias("id"), "longitude", "latitude", *[F.floor(c / chord).cast("int").alias(n) for n, c in (("cx", x), ("cy", y), ("cz", z))])

    left = placed(some).withColumn("o", F.explode(offsets(3))).select(F.col("id").alias("a"), F.col("longitude").alias("lon_a"), F.col("latitude").alias("lat_a"), *[(F.col(n) + F.col("o")[i]).alias(n) for i, n in enumerate(("cx", "cy", "cz"))])
    right = placed(others).withColumnsRenamed({"id": "b", "longitude": "lon_b", "latitude": "lat_b"})
    d = haversine_km(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    return left.join(right, ["cx", "cy", "cz"]).where("a <> b").select("a", "b", d.alias("km")).where(F.col("km") <= km)


def _gap(own: Column, other: Column, width: float, size: float, far: bool) -> Column:
    """Least or greatest distance along an axis between cell `own` of edge `size` and cell `other` of edge `width`."""
    lo, hi, a, b = own * size, own * size + size, other * width, other * width + width
    return F.greatest(F.abs(hi - a), F.abs(b - lo)) if far else F.greatest(F.lit(0.0), a - hi, lo - b)


def candidate_cells(places: DataFrame, occupied: DataFrame, dims: int, size: float, span: float, slack: float) -> DataFrame:
    """For each cell p0, p1, .. of `places` the cells c0, c1, .. of `occupied` that can hold the nearest thing to one of its points.

    Cells have the edge `size`; every occupied cell holds a point of a thing, no other point of which is further than `slack` from it. The search goes from
    a few cells that hold the whole `span` down: each is replaced by its occupied parts, and parts go whose least distance exceeds the
    greatest distance to another. So a place in the void meets no more cells than one nearby.
    """
    p, c, u = ([f"{x}{i}" for i in range(dims)] for x in "pcu")
    occupied = materialize(occupied.select(*c).distinct())
    sent = F.broadcast if occupied.count() * 32 * dims <= BROADCAST_BYTES else lambda d: d
    top = math.ceil(math.log2(span / size)) + 1
    top += -top % DESCENT
    at = lambda level, names: [F.shiftright(x, level).alias(n) for x, n in zip(c, names)]
    found = places.select(*p).distinct().crossJoin(F.broadcast(occupied.select(*at(top, c)).distinct()))  # 2 ** dims cells at most
    for level in range(top - DESCENT, -1, -DESCENT):
        parts = occupied.select(*at(level + DESCENT, u), *at(level, c)).distinct()
        met = found.withColumnsRenamed(dict(zip(c, u))).join(sent(parts), u).drop(*u)

        def distance(far: bool, width: float = size * 2**level) -> Column:
            gaps = [_gap(F.col(a), F.col(b), width, size, far) for a, b in zip(p, c)]
            return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))

        bound = F.min(distance(True)).over(Window.partitionBy(*p))
        found = met.withColumn("_most", bound).where(distance(False) - slack <= F.col("_most")).drop("_most")
    return found


def nearest_of(places: DataFrame, others: DataFrame, name: str = "km", chord: float = CHORD) -> DataFrame:
    """(longitude, latitude, name): the great-circle distance from each of different places to the nearest of `others`; no row where there is none."""

    def cubes(d: DataFrame, letter: str) -> DataFrame:
        return d.withColumns({f"{letter}{i}": F.floor(v / chord).cast("long") for i, v in enumerate(unit_vector(F.col("longitude"), F.col("latitude")))})

    p = materialize(cubes(places.select("longitude", "latitude").distinct(), "p"))
    o = materialize(cubes(others.select("longitude", "latitude").distinct(), "c").withColumnsRenamed({"longitude": "_lon", "latitude": "_lat"}))
    cells = materialize(candidate_cells(p, o, 3, chord, 2.0, 1e-9))
    met = p.join(cells, ["p0", "p1", "p2"]).join(small(o, 64), ["c0", "c1", "c2"])
    return met.groupBy("longitude", "latitude").agg(F.min(haversine_km(F.col("longitude"), F.col("latitude"), F.col("_lon"), F.col("_lat"))).alias(name))


def knn_grid(cells: DataFrame, k: int = 8, start_reach: int = 2) -> DataFrame:
    """Row-standardised weights (src_lat, src_lon, dst_lat, dst_lon, rank, dist2, w) to the k nearest cells.

    Distances are Euclidean in cells; ties go by (lat_idx, lon_idx). Each round joins the cells without k sure neighbours to those within
    a doubled reach: a neighbour is sure if it is nearer than the reach.
    """
    c = cells.select("lat_idx", "lon_idx")
    todo, done, reach, n = materialize(c), None, start_reach, c.count()
    span = int(c.agg(F.max("lat_idx") - F.min("lat_idx") + F.max("lon_idx") - F.min("lon_idx")).first()[0] or 0) + 1
    want = min(k, max(0, n - 1))
    while want:
        # Coarse buckets of the reach's size: nine of them hold all cells within it.
        b = lambda x: F.floor(x / reach).cast("int")
        left = todo.withColumn("o", F.explode(offsets(2))).select(F.col("lat_idx").alias("src_lat"), F.col("lon_idx").alias("src_lon"), (b(F.col("lat_idx")) + F.col("o")[0]).alias("by"), (b(F.col("lon_idx")) + F.col("o")[1]).alias("bx"))
        right = c.select(F.col("lat_idx").alias("dst_lat"), F.col("lon_idx").alias("dst_lon"), b(F.col("lat_idx")).alias("by"), b(F.col("lon_idx")).alias("bx"))
        d2 = (F.col("src_lat") - F.col("dst_lat")) * (F.col("src_lat") - F.col("dst_lat")) + (F.col("src_lon") - F.col("dst_lon")) * (F.col("src_lon") - F.col("dst_lon"))
        met = left.join(right, ["by", "bx"]).where("src_lat <> dst_lat or src_lon <> dst_lon").withColumn("dist2", d2.cast("long")).where(F.col("dist2") <= reach * reach)
        order = Window.partitionBy("src_lat", "src_lon").orderBy("dist2", "dst_lat", "dst_lon")
        ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)
        full = F.count("*").over(Window.partitionBy("src_lat", "src_lon"))
        sure = materialize(ranked.withColumn("_n", full).where(F.col("_n") == want).drop("_n").select("src_lat", "src_lon", "dst_lat", "dst_lon", "rank", "dist2"))
        done = sure if done is None else done.union(sure)
        got = sure.select(F.col("src_lat").alias("lat_idx"), F.col("src_lon").alias("lon_idx")).distinct()
        todo = materialize(todo.join(got, ["lat_idx", "lon_idx"], "left_anti"))
        if reach > span or todo.isEmpty():
            break
        reach *= 2
    if done is None:
        done = c.select(*[F.col(x).alias(y) for x, y in (("lat_idx", "src_lat"), ("lon_idx", "src_lon"), ("lat_idx", "dst_lat"), ("lon_idx", "dst_lon"))], F.lit(1).alias("rank"), F.lit(0).cast("long").alias("dist2")).limit(0)
    return done.withColumn("w", F.lit(1.0 / max(1, want)))


def spatial_lag(cells: DataFrame, weights: DataFrame, value: str, name: str = "lag") -> DataFrame:
    """Add the weighted mean of the neighbours' values."""
    v = cells.select(F.col("lat_idx").alias("dst_lat"), F.col("lon_idx").alias("dst_lon"), F.col(value).cast("double").alias("_v"))
    lag = weights.join(v, ["dst_lat", "dst_lon"]).groupBy("src_lat", "src_lon").agg(F.sum(F.col("w") * F.col("_v")).alias(name))
    return cells.join(lag.withColumnsRenamed({"src_lat": "lat_idx", "src_lon": "lon_idx"}), ["lat_idx", "lon_idx"])

"""Polygons, anchors and boundary lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions.scalar import equal_area_xy, haversine_km
from gridwake.operators.neighbors import candidate_cells, nearest_of
from gridwake.tables import materialize, small

CELL_DEG = 1.0
CELL_METRES = 100_000.0
WORLD_METRES = 40_000_000.0
ANCHORS = 1000  # so many distances are taken at once for each point; beyond, cells are searched


def edges(countries: DataFrame) -> DataFrame:
    """The line segments of all rings: (country, x1, y1, x2, y2)."""
    ring = countries.select("country", F.explode("rings").alias("ring"))
    pair = ring.select("country", F.explode(F.arrays_zip(F.expr("slice(ring, 1, size(ring) - 1)").alias("a"), F.expr("slice(ring, 2, size(ring) - 1)").alias("b"))).alias("e"))
    return pair.select("country", F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"), F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"))


def _parity_cells(e: DataFrame, cell: float) -> DataFrame:
    """For each cell the latitudes where an odd number of a country's edges lie wholly east of its column: (country, cx, cy, lo, hi), lo included.

    A latitude y meets the edges [lo, hi) that hold it, so the parity of those is that of the ends at or under y. Ends of neighbouring edges cancel
    but where a ring enters or leaves the columns to the east, so few are left. No task sees a whole ring.
    """
    column = F.floor(F.least("x1", "x2") / cell)
    ends = e.select("country", column.alias("c"), F.explode(F.array("y1", "y2")).alias("y")).groupBy("country", "y", "c").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    # The columns k of an end: those with an odd number of its edges beyond them.
    at = ends.groupBy("country", "y").agg(F.sort_array(F.collect_list("c")).alias("c"))  # at most a number for each column
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda i: F.sequence(F.get("c", 2 * i), F.get("c", 2 * i + 1) - 1))
    steps = at.where(F.size("c") > 1).select("country", "y", F.explode(F.flatten(pairs)).alias("cx"))
    order = Window.partitionBy("country", "cx").orderBy("y")
    spans = steps.select("country", "cx", F.col("y").alias("lo"), F.lead("y").over(order).alias("hi"), F.row_number().over(order).alias("i")).where("i % 2 = 1 and hi is not null")
    return spans.select("country", "cx", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))).alias("cy"), "lo", "hi")


def _edge_cells(e: DataFrame, cell: float) -> DataFrame:
    """Edges in the cells of their bounding boxes."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    return e.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))


def within(points: DataFrame, countries: DataFrame, cell_deg: float = CELL_DEG) -> DataFrame:
    """Join points (longitude, latitude) with the polygons that strictly hold them, by the even-odd rule over all rings.

    A ray to the east crosses the edges that meet the point's cell, which are tested one by one, and those wholly east of its column, of which only
    the parity counts, known for each cell beforehand. Both kinds of candidates are summed for each different point and country. Points on a boundary
    are out; points without coordinates are in no country.
    """
    x, y = F.col("longitude"), F.col("latitude")
    e = edges(countries)
    place = F.floor(x / cell_deg).alias("cx"), F.floor(y / cell_deg).alias("cy")
    p = materialize(points.where(~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double"))).select("longitude", "latitude", *place).distinct())
    slope = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    crosses = ((F.col("y1") > y) != (F.col("y2") > y)) & (x < slope[0] * (y - F.col("y1")) / slope[1] + F.col("x1"))
    turn = slope[0] * (y - F.col("y1")) - slope[1] * (x - F.col("x1"))
    on = (turn == 0) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    near = p.join(small(materialize(_edge_cells(e, cell_deg)), 64), ["cx", "cy"]).select("longitude", "latitude", "country", F.coalesce(crosses, F.lit(False)).cast("long").alias("crossed"), on.cast("long").alias("on"))
    far = p.join(small(materialize(_parity_cells(e, cell_deg)), 48), ["cx", "cy"]).select("longitude", "latitude", "country", ((F.col("lo") <= y) & (y < F.col("hi"))).cast("long").alias("crossed"), F.lit(0).cast("long").alias("on"))
    met = near.unionByName(far).groupBy("longitude", "latitude", "country").agg(F.sum("crossed").alias("crossed"), F.max("on").alias("on"))
    return points.join(met.where("crossed % 2 = 1 and on = 0").drop("crossed", "on"), ["longitude", "latitude"]).select(*points.columns, "country")


def zonal_statistics(cells: DataFrame, countries: DataFrame) -> DataFrame:
    """By country: unweighted means of the cells' means, sums, points and number of cells."""
    at = within(cells.withColumn("longitude", F.col("lon_bin")).withColumn("latitude", F.col("lat_bin")), countries)
    return at.groupBy("country").agg(F.avg("density_mean").alias("mean_density"), F.avg("intensity_mean").alias("mean_intensity"), F.sum("density_sum").alias("total_density"), F.sum("points").alias("points"), F.count("*").alias("cells"))


def choropleth(countries: DataFrame, stats: DataFrame) -> DataFrame:
    """All countries, with zeros where there are no cells."""
    return countries.select("country").join(stats, "country", "left").na.fill(0)


def nearest_anchor_km(points: DataFrame, anchors: DataFrame, kind: str, name: str) -> DataFrame:
    """Add the distance to the nearest anchor of a kind: the least of a short list, or by `neighbors.nearest_of` where there are more than ANCHORS.

    Null where there is no anchor of the kind or where a point has no coordinates.
    """
    own = anchors.where(F.col("kind") == kind).select(F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    if own.limit(ANCHORS + 1).count() <= ANCHORS:
        each = own.agg(F.collect_list(F.struct("longitude", "latitude")).alias("_each"))
        nearest = F.array_min(F.transform("_each", lambda p: haversine_km(F.col("longitude"), F.col("latitude"), p["longitude"], p["latitude"])))
        return points.crossJoin(F.broadcast(each)).withColumn(name, nearest).drop("_each")
    places = materialize(points.select("longitude", "latitude").where("longitude is not null and latitude is not null").distinct())
    return points.join(nearest_of(places, own, name), ["longitude", "latitude"], "left").select(*points.columns, name)


def _pieces(countries: DataFrame, size: float) -> DataFrame:
    """Boundary segments in the equal-area plane, once for each cell that holds the middle of one of their pieces of at most `size`: (cx, cy, ax, ay, bx, by)."""
    e = edges(countries)
    (ax, ay), (bx, by) = equal_area_xy(F.col("x1"), F.col("y1")), equal_area_xy(F.col("x2"), F.col("y2"))
    s = e.select(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")).distinct()
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / size))
    s = s.withColumn("t", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: (i - 0.5) / n)))
    middle = lambda a, b: F.floor((F.col(a) + F.col("t") * (F.col(b) - F.col(a))) / size).cast("long")
    return s.select(middle("ax", "bx").alias("cx"), middle("ay", "by").alias("cy"), "ax", "ay", "bx", "by").distinct()


def boundary_km(points: DataFrame, countries: DataFrame, name: str = "distance_to_coast_km", cell_metres: float = CELL_METRES) -> DataFrame:
    """Add the distance to the nearest boundary line of any country, land borders included, in the equal-area plane.

    Segments are laid into plane cells by pieces. For each cell that holds points, `neighbors.candidate_cells` finds the cells that can hold the nearest segment;
    the different points then meet the segments of those alone. Null where there are no boundaries or a point has no coordinates.
    """
    size = float(cell_metres)
    pieces = materialize(_pieces(countries, size).withColumnsRenamed({"cx": "c0", "cy": "c1"}))
    px, py = equal_area_xy(F.col("longitude").cast("double"), F.col("latitude").cast("double"))
    p = points.where(~F.isnan(F.col("longitude").cast("double")) & ~F.isnan(F.col("latitude").cast("double"))).select("longitude", "latitude", px.alias("_x"), py.alias("_y")).distinct()
    p = materialize(p.withColumn("p0", F.floor(F.col("_x") / size).cast("long")).withColumn("p1", F.floor(F.col("_y") / size).cast("long")))
    cells = materialize(candidate_cells(p, pieces, 2, size, WORLD_METRES, size / 2))
    at = p.join(cells, ["p0", "p1"]).join(small(pieces, 64), ["c0", "c1"])
    dx, dy, gx, gy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("_x") - F.col("ax"), F.col("_y") - F.col("ay")
    along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (gx * dx + gy * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300))))
    near = at.groupBy("longitude", "latitude").agg((F.min(F.hypot(gx - along * dx, gy - along * dy)) / 1000).alias(name))
    return points.join(near, ["longitude", "latitude"], "left").select(*points.columns, name)


def port_precision(points: DataFrame, anchors: DataFrame, km: float = 50.0) -> DataFrame:
    """The share of points within `km` of a port."""
    return nearest_anchor_km(points, anchors, "port", "_d").agg(F.count("*").alias("n"), F.avg((F.col("_d") <= km).cast("double")).alias("precision"))

"""Small inputs with answers by hand or by numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwake.functions import scalar as fn
from gridwake.operators import autocorr, geo, grid, neighbors, pointpattern, raster, regression, serving, validate
from gridwake.sources import tables


def column(spark, values, expression):
    return [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "x double").select(expression(F.col("x"))).collect()]


def pixels(spark, values, width=2):
    rows = [("a", i // width, i % width, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "category string, row_id int, col_id int, value int")


def test_wrap_and_bins(spark):
    assert column(spark, [-181, -180, 0, 179.5, 180, 540], fn.wrap_longitude) == [179, -180, 0, 179.5, -180, -180]
    centre = lambda x: fn.bin_centre(fn.bin_index(x, 1.0, 90.0), 1.0, 90.0)
    assert column(spark, [-90, 0.5, 89.99, 90], centre) == [-89.5, 0.5, 89.5, 90.5]
    assert column(spark, [3.49, 3.5, 5.5], fn.resolution_of) == ["low", "mid", "high"]


def test_haversine_and_labels(spark):
    km = lambda a, b, c, d: spark.range(1).select(fn.haversine_km(*[F.lit(float(v)) for v in (a, b, c, d)])).first()[0]
    assert km(0, 0, 90, 0) == pytest.approx(6371.0088 * math.pi / 2)
    assert km(179.5, 0, -179.5, 0) == pytest.approx(111.195, abs=1e-3)
    labels = spark.createDataFrame([(1, 0.05), (1, 0.051), (4, 0.01), (9, 0.01)], "q int, p double").select(fn.lisa_label(F.col("q"), F.col("p"))).collect()
    assert [r[0] for r in labels] == ["HH", "NS", "HL", "NS"]


def test_raster_filters_and_blocks(spark):
    nd = 2147483647
    assert [r.value for r in raster.with_traffic(pixels(spark, [0, 5, nd]), nd).collect()] == [5]
    assert raster.downsample(pixels(spark, [0, 0, 0, 1]), 2, 2, 2, nd).first().value == 0
    assert raster.downsample(pixels(spark, [nd, 4, 4, 4]), 2, 2, 2, nd).first().value == 4
    assert raster.statistics(pixels(spark, [0, 100_000]), nd).first()["std"] == 50_000
    h = {r.label: r.n for r in raster.histogram(pixels(spark, [0, 1, 9, 10, 999, 1000, 100000]), nd).collect()}
    assert [h[label] for _, _, label in raster.HISTOGRAM] == [1, 2, 1, 1, 1, 0, 1]


def test_percentiles_and_normalisation(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "category string, v double")
    assert grid.exact_percentiles(d, "v", {"p": 0.9}).first().p == pytest.approx(9.1)
    zero = spark.createDataFrame([("a", 0.0)], "category string, v double")
    assert grid.normalised_by_max(zero, "v", ["category"], "w").first().w == 0
    cell = spark.createDataFrame([("low", "a", 0.0)], "resolution string, top_category string, raw_weight double")
    assert grid.normalised_by_p99(cell, ["resolution"]).count() == 0


def test_point_in_polygon_and_choropleth(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    c = spark.createDataFrame([("x", [ring, hole])], "country string, rings array<array<struct<lon:double,lat:double>>>")
    p = spark.createDataFrame([(1, 3.0, 3.0), (2, 4.0, 2.0), (3, 1.5, 1.5), (4, 9.0, 9.0), (5, 0.5, 0.5)], "i int, longitude double, latitude double")
    assert sorted(r.i for r in geo.within(p, c).collect()) == [1, 5]
    stats = spark.createDataFrame([], "country string, mean_density double, total_density long")
    assert geo.choropleth(c, stats).first().asDict() == {"country": "x", "mean_density": 0.0, "total_density": 0}


def test_polygon_of_many_edges(spark):
    """A star of 100,000 edges with a star as its hole, other countries inside and beside it, and points on corners, edges and the cells' borders."""
    rng = np.random.default_rng(8)

    def star(n, x, y, r, wobble):
        t = np.linspace(0, 2 * np.pi, n, endpoint=False)
        d = r * (1 + wobble * rng.uniform(-1, 1, n))
        xy = np.c_[x + d * np.cos(t), y + d * np.sin(t)]
        return np.r_[xy, xy[:1]]

    shapes = {"big": [star(100_000, 10.5, 5.5, 20, 0.2), star(300, 11, 5, 6, 0.3)], "inner": [star(7, 11, 5, 3, 0.1)], "box": [np.array([(40.0, -2), (43, -2), (43, 3), (40, 3), (40, -2)])], "dent": [np.array([(-50.0, 0), (-40, 0), (-45, 5), (-40, 10), (-50, 10), (-50, 0)])]}
    c = spark.createDataFrame([(n, [[(float(a), float(b)) for a, b in ring] for ring in rings]) for n, rings in shapes.items()], "country string, rings array<array<struct<lon:double,lat:double>>>")
    xy = np.r_[rng.uniform(-55, 45, (250, 2)) * [1, 0.5], np.array([(40, 1), (41, 3), (43, 3), (42, 1), (41, -2), (-45, 5), (-46, 5), (-44, 5), (-41, 1), (11, 5), (10, 5), (40.0001, 2.9999)]), shapes["big"][0][:5], np.floor(rng.uniform(-20, 30, (30, 2)))]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate([*xy, xy[0]])]
    p = spark.createDataFrame([*rows, (-1, None, 1.0), (-2, float("nan"), 1.0)], "i int, longitude double, latitude double")
    want = set()
    for i, x, y in rows:
        for name, rings in shapes.items():
            x1, y1, x2, y2 = np.concatenate([np.c_[r[:-1], r[1:]] for r in rings]).T
            with np.errstate(divide="ignore", invalid="ignore"):
                crossed = (((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).sum() % 2
            on = (((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))).any()
            if crossed and not on:
                want.add((i, name))
    for cell in (1.0, 7.0):
        got = [(r.i, r.country) for r in geo.within(p, c, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {n for _, n in want} == set(shapes)


def test_boundary_distance_against_all_segments(spark):
    """More segments than any limit, places far out at sea among them, with cells large and small."""
    rng = np.random.default_rng(9)
    t = np.linspace(0, 2 * np.pi, 20_000)
    coast = np.c_[20 + 15 * np.cos(t) + rng.normal(0, 0.05, len(t)), 10 + 12 * np.sin(t) + rng.normal(0, 0.05, len(t))]
    wide = np.array([(-170.0, 60), (-100, 62), (-120, 75), (-170, 60)])
    c = spark.createDataFrame([(n, [[(float(a), float(b)) for a, b in ring]]) for n, ring in (("a", coast), ("b", wide))], "country string, rings array<array<struct<lon:double,lat:double>>>")
    xy = np.r_[rng.uniform(-1, 1, (150, 2)) * [180, 85], coast[:3], [[20, 10]]]
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate([*xy, xy[0]])] + [(-1, None, 1.0)], "i int, longitude double, latitude double")

    def plane(lonlat):
        s, e = np.sin(np.radians(lonlat[:, 1])), math.sqrt(fn.WGS84_E2)
        k = math.cos(math.radians(30)) / math.sqrt(1 - fn.WGS84_E2 * 0.25)
        q = (1 - e * e) * (s / (1 - e * e * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))
        return np.c_[6378137 * k * np.radians(lonlat[:, 0]), 6378137 * q / (2 * k)]

    a, b = (np.concatenate([plane(r)[i : len(r) - 1 + i] for r in (coast, wide)]) for i in (0, 1))
    want = []
    for q in plane(xy):
        d, g = b - a, q - a
        along = np.clip((g * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
        want.append(np.hypot(*(g - along[:, None] * d).T).min() / 1000)
    for cell in (50_000.0, 700_000.0):
        got = {r.i: r.distance_to_coast_km for r in geo.boundary_km(p, c, cell_metres=cell).collect()}
        assert got.pop(-1) is None and got[len(xy)] == got[0]
        assert [got[i] for i in range(len(xy))] == pytest.approx(want, abs=1e-6)
    assert [r.distance_to_coast_km for r in geo.boundary_km(p, c.limit(0)).collect()] == [None] * (len(xy) + 2)


def test_nearest_anchor_by_list_and_by_cells(spark, monkeypatch):
    rng = np.random.default_rng(10)
    own = [(float(a), float(b)) for a, b in rng.uniform(-1, 1, (40, 2)) * [30, 20]] + [(179.9, 1.0), (0.0, 90.0)]
    anchors = spark.createDataFrame([("port", *a) for a in own] + [("strait", 0.0, 0.0)], "kind string, lon double, lat double")
    places = [(float(a), float(b)) for a, b in rng.uniform(-1, 1, (120, 2)) * [180, 90]] + [(-179.9, 1.0), (10.0, -90.0), own[0]]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate([*places, places[0]])] + [(-1, None, 0.0)], "i int, longitude double, latitude double")

    def km(x, y):
        a, b, c, d = np.radians([*x, *y])
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2)))

    want = [min(km(x, y) for y in own) for x in [*places, places[0]]]
    for limit in (1000, 2):
        monkeypatch.setattr(geo, "ANCHORS", limit)
        got = {r.i: r.d for r in geo.nearest_anchor_km(p, anchors, "port", "d").collect()}
        assert got.pop(-1) is None and [got[i] for i in range(len(want))] == pytest.approx(want, abs=1e-6)
    assert geo.nearest_anchor_km(p, anchors, "lighthouse", "d").where("d is not null").count() == 0


def test_boundary_distance(spark):
    ring = [(0.0, -1.0), (10.0, -1.0), (10.0, 1.0), (0.0, 1.0), (0.0, -1.0)]
    c = spark.createDataFrame([("x", [ring])], "country string, rings array<array<struct<lon:double,lat:double>>>")
    p = spark.createDataFrame([(-1.0, 0.0)], "longitude double, latitude double")
    one_degree = 6378.137 * math.cos(math.radians(30)) / math.sqrt(1 - fn.WGS84_E2 * 0.25) * math.pi / 180
    assert geo.boundary_km(p, c).first().distance_to_coast_km == pytest.approx(one_degree, rel=1e-6)


def points(spark, lonlat):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(lonlat)], "hotspot_rank long, longitude double, latitude double").withColumn("id", F.col("hotspot_rank"))


def labels(df):
    return {r.hotspot_rank: r.cluster_id for r in df.collect()}


def test_dbscan(spark):
    near = [(0.1 * i, 0.0) for i in range(6)]
    assert labels(pointpattern.dbscan(points(spark, [*near, (90, 40)]))) == {**dict.fromkeys(range(6), 0), 6: -1}
    assert set(labels(pointpattern.dbscan(points(spark, near[:5]))).values()) == {-1}
    across = [(179.5, 0.0)] * 3 + [(-179.5, 0.0)] * 3
    assert set(labels(pointpattern.dbscan(points(spark, across))).values()) == {0}


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(c, 0.8, (40, 2)) for c in ((0, 0), (20, 10), (-40, 30))] + [rng.uniform(-60, 60, (30, 2))])
    got = labels(pointpattern.dbscan(points(spark, xy), 60.0, 5))
    rad = np.radians(xy)
    a = np.sin((rad[:, None, 1] - rad[:, 1]) / 2) ** 2 + np.cos(rad[:, None, 1]) * np.cos(rad[:, 1]) * np.sin((rad[:, None, 0] - rad[:, 0]) / 2) ** 2
    near = 2 * 6371.0088 * np.arcsin(np.minimum(1, np.sqrt(a))) <= 60
    core = near.sum(axis=1) >= 5
    want, number = np.full(len(xy), -1), 0
    for i in range(len(xy)):
        if core[i] and want[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if want[j] < 0:
                    want[j] = number
                    stack += [k for k in np.flatnonzero(near[j] & core) if want[k] < 0]
            number += 1
    for i in np.flatnonzero(~core):
        c = want[near[i] & core]
        want[i] = c.min() if len(c) else -1
    assert got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("n", [40, 60_000])
def test_kernel_density_against_the_sum(spark, n):
    """The series of cells gives what the sum over all points gives, for few points and for more than fit one array of pairs."""
    rng = np.random.default_rng(14)
    xy = np.concatenate([rng.normal((10, 5), (3, 1), (n // 2, 2)), rng.normal((-20, 0), (1, 4), (n // 4, 2)), rng.uniform(-60, 60, (n - n // 2 - n // 4, 2))])
    w = rng.gamma(1, 2, n)
    d = spark.createDataFrame(pd.DataFrame({"i": range(n), "longitude": xy[:, 0], "latitude": xy[:, 1], "w": w, "kde": "x"}))
    got = pointpattern.kernel_density(d, "w").toPandas().set_index("i").sort_index()
    p = w / w.sum()
    m = (p[:, None] * xy).sum(axis=0)
    h = ((xy - m).T * p) @ (xy - m) / (1 - (p**2).sum()) * (1 / (p**2).sum()) ** (-1 / 3)
    some = rng.choice(n, min(n, 300), replace=False)
    gap = xy[some][:, None] - xy
    want = (np.exp(-0.5 * np.einsum("nij,jk,nik->ni", gap, np.linalg.inv(h), gap)) * p).sum(axis=1) / (2 * np.pi * np.linalg.det(h) ** 0.5)
    assert len(got) == n and np.abs(got["kde_score"][some].to_numpy() - want).max() < 1e-9 * got["kde_score"].max()
    assert got["kde_score_norm"].max() == 1 and list(got.columns) == ["longitude", "latitude", "w", "kde", "kde_score", "kde_score_norm"]


def test_ripley_p_against_counting(spark):
    """Twelve pairs a hundredth apart: K and p from counts over the same drawn patterns."""
    rng = np.random.default_rng(15)
    xy = rng.uniform((0, 0), (20, 10), (25, 2))
    xy = np.r_[xy, xy[:12] + 0.01]
    at, n, runs = [0.05, 0.5, 2.0, 6.0], len(xy), 49
    count = lambda z: np.array([(np.hypot(*(z[:, None] - z).T) <= r).sum() - len(z) for r in at])
    west, south, east, north = *xy.min(axis=0), *xy.max(axis=0)
    drawn = pointpattern.random_patterns(spark, runs, n, (west, east, south, north)).toPandas()
    assert drawn.groupby("sim").size().eq(n).all() and drawn.longitude.between(west, east).all() and drawn.latitude.between(south, north).all()
    assert abs(drawn.longitude.mean() - (west + east) / 2) < 0.05 * (east - west) and abs(np.corrcoef(drawn.longitude, drawn.latitude)[0, 1]) < 0.1
    over = sum(count(z[["longitude", "latitude"]].to_numpy()) >= count(xy) for _, z in drawn.groupby("sim"))
    got = sorted(pointpattern.ripley_p(points(spark, xy), runs, at=at).collect())
    assert [r.radius for r in got] == at
    assert [r.k for r in got] == pytest.approx(((east - west) * (north - south) * count(xy) / n**2).tolist())
    assert [r.p_value for r in got] == pytest.approx(((over + 1) / (runs + 1)).tolist()) and got[0].p_value == pytest.approx(0.02)
    assert {r.p_value for r in pointpattern.ripley_p(points(spark, xy[:5]), runs, at=at).collect()} <= {None}


def plain_dbscan(near, least):
    """Labels from a matrix of neighbours: clusters by their first core, border points in their smallest cluster."""
    core, label, number = near.sum(axis=1) >= least, np.full(len(near), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = number
                    stack += np.flatnonzero(near[j] & core & (label < 0)).tolist()
            number += 1
    for i in np.flatnonzero(~core):
        of = label[near[i] & core]
        label[i] = of.min() if len(of) else -1
    return label


@pytest.mark.parametrize("metric", ["haversine", "planar"])
@pytest.mark.parametrize("pairs", [4096, 1])
def test_dbscan_of_crowds(spark, monkeypatch, metric, pairs):
    """Crowded cells side by side, many points on one place, and chains of just eps: boxes are halved until all is settled."""
    monkeypatch.setattr(pointpattern, "PAIRS", pairs)
    rng = np.random.default_rng(13)
    eps = 111.0 if metric == "haversine" else 1.0
    xy = np.concatenate([rng.normal((0, 0), 0.5, (500, 2)), np.tile([[5.0, 5.0]], (60, 1)), [[5.9, 5.0], [5.0, 5.95]], [[20 + 0.999 * i, 3.0] for i in range(12)], rng.uniform((30, 0), (33, 3), (150, 2)), rng.uniform(-80, 80, (60, 2)), [[179.9, 10.0]] * 4 + [[-179.9, 10.0]] * 4])
    xy = xy[rng.permutation(len(xy))]
    d = xy[:, None] - xy
    if metric == "haversine":
        rad = np.radians(xy)
        h = np.sin((rad[:, None, 1] - rad[:, 1]) / 2) ** 2 + np.cos(rad[:, None, 1]) * np.cos(rad[:, 1]) * np.sin((rad[:, None, 0] - rad[:, 0]) / 2) ** 2
        near = 2 * 6371.0088 * np.arcsin(np.minimum(1, np.sqrt(h))) <= eps
    else:
        near = np.sqrt((d**2).sum(axis=2)) <= eps
    want = plain_dbscan(near, 5)
    got = labels(pointpattern.dbscan(points(spark, xy), eps, 5, metric))
    assert [got[i] for i in range(len(xy))] == want.tolist() and want.max() >= 2


def test_pixel_clusters(spark):
    """The registered query finds the clusters that all pairs give, and there are some."""
    from gridwake.plans import catalogue

    r = sorted(catalogue.QUERIES["g9_planar_dbscan"](spark, "/root/testdata/sf0.01").collect(), key=lambda r: r.hotspot_rank)
    at = np.array([(r.lat_idx * 0.005 - 90 + 0.0025, r.lon_idx * 0.005 - 180 + 0.0025) for r in r])
    want = plain_dbscan(np.hypot(*(at[:, None] - at).T) <= 0.05, 10)
    assert [x.cluster_id for x in r] == want.tolist() and want.max() >= 3 and (want < 0).any()


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {runs.apply(i).executionId() for i in range(runs.size())}


def broadcast_rows(spark, runs):
    """Rows of each broadcast of the given SQL executions."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    for run in sorted(runs):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            each = [metrics.apply(i) for i in range(metrics.size())] if node.name() == "BroadcastExchange" else []
            out += [int(values.get(m.accumulatorId()).get().replace(",", "")) for m in each if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return out


def test_dbscan_keeps_tables_from_the_driver(spark):
    """Many points far apart and three chains: their compressed tables look small, but only those with few rows are to be broadcast."""
    n, chain = 70_000, F.col("id") - 70_000
    far = [(F.col("id") % 400) * 0.5, F.floor(F.col("id") / 400) * 0.5]
    at = [F.when(F.col("id") < n, x).otherwise(y) for x, y in zip(far, (-50 + chain % 20 * 0.04, -50 + F.floor(chain / 20)))]
    xy = spark.range(n + 60).select((F.col("id") + 1).alias("hotspot_rank"), at[0].alias("longitude"), at[1].alias("latitude"))
    before = executions(spark)
    got = labels(pointpattern.dbscan(xy, 0.05, 3, "planar"))
    assert [got[i] for i in sorted(got)] == [-1] * n + [0] * 20 + [1] * 20 + [2] * 20
    sent = broadcast_rows(spark, executions(spark) - before)
    assert sent and max(sent) <= 1 << 16


def test_nearest_and_ripley_small(spark):
    one = pointpattern.nearest_neighbour_ratio(points(spark, [(0, 0)])).first()
    assert (one.observed_km, one.expected_km, one.ratio) == (0, 0, None)
    assert pointpattern.ripley_k(points(spark, [(i, i) for i in range(19)])).count() == 0


def cells(spark, n, value):
    return spark.createDataFrame([(i, j, float(value(i, j))) for i in range(n) for j in range(n)], "lat_idx int, lon_idx int, v double")


def test_knn_lag_and_moran(spark):
    c = cells(spark, 5, lambda i, j: 7)
    w = neighbors.knn_grid(c)
    mid = w.where("src_lat = 2 and src_lon = 2").collect()
    assert {(r.dst_lat, r.dst_lon) for r in mid} == {(i, j) for i in (1, 2, 3) for j in (1, 2, 3)} - {(2, 2)}
    assert {r.lag for r in neighbors.spatial_lag(c, w, "v").collect()} == {7.0}
    assert w.groupBy("src_lat", "src_lon").count().where("count <> 8").count() == 0
    line = spark.createDataFrame([(0, i, float(i)) for i in range(11)], "lat_idx int, lon_idx int, v double")
    assert autocorr.moran(line, neighbors.knn_grid(line), "v").first().expected_i == pytest.approx(-0.1)


def test_knn_of_scattered_cells(spark):
    rng = np.random.default_rng(1)
    at = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (90, 2))})
    w = neighbors.knn_grid(spark.createDataFrame(at, "lat_idx int, lon_idx int")).collect()
    for s in at:
        want = sorted((((s[0] - t[0]) ** 2 + (s[1] - t[1]) ** 2), *t) for t in at if t != s)[:8]
        assert sorted((r["rank"], r.dst_lat, r.dst_lon) for r in w if (r.src_lat, r.src_lon) == s) == [(i + 1, *t[1:]) for i, t in enumerate(want)]


@pytest.mark.parametrize("n", [8, 20, 2000])
def test_draws_are_distinct_and_even(n):
    draw = autocorr.distinct_draws(np.random.default_rng(3), n, 5000, 8)
    assert draw.shape == (5000, 8) and draw.min() >= 0 and draw.max() < n
    assert (np.diff(np.sort(draw, axis=1), axis=1) > 0).all()
    times = np.bincount(draw.ravel(), minlength=n)
    assert abs(times - 5000 * 8 / n).max() <= 6 * np.sqrt(5000 * 8 / n)


def test_permutations_tell_order_from_noise(spark):
    c = cells(spark, 12, lambda i, j: i)
    w = neighbors.knn_grid(c)
    m = autocorr.moran_permutations(c, w, "v", 99).first()
    assert m.p_sim == pytest.approx(0.01) and m.z_sim > 5
    assert autocorr.lisa(c, w, "v", 99).where("lat_idx = 11").select("lisa_cluster").distinct().first()[0] == "HH"


def _matrix(w, at):
    m = np.zeros((len(at), len(at)))
    for r in w.collect():
        m[at[r.src_lat, r.src_lon], at[r.dst_lat, r.dst_lon]] = r.w
    return m


def test_moran_moments_are_the_textbooks(spark, monkeypatch):
    monkeypatch.setattr(autocorr, "PERMUTED_CELLS", 10)  # moments have no limit
    rng = np.random.default_rng(11)
    at = {k: i for i, k in enumerate(sorted({(int(a), int(b)) for a, b in rng.integers(0, 15, (80, 2))}))}
    v = rng.gamma(1.0, size=len(at))
    c = spark.createDataFrame([(*k, float(v[i])) for k, i in at.items()], "lat_idx int, lon_idx int, v double")
    w = neighbors.knn_grid(c, 5)
    m, n, z = _matrix(w, at), len(at), v - v.mean()
    s0, s1, s2 = m.sum(), ((m + m.T) ** 2).sum() / 2, ((m.sum(axis=1) + m.sum(axis=0)) ** 2).sum()
    i, e, k = n / s0 * (z @ m @ z) / (z @ z), -1 / (n - 1), n * (z**4).sum() / (z @ z) ** 2
    q = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - e * e
    r = autocorr.moran_moments(c, w, "v").first()
    assert (r.n, r.moran_i, r.expected_i, r.variance, r.z_norm) == pytest.approx((n, i, e, q, (i - e) / q**0.5))
    assert r.p_norm == pytest.approx(math.erfc(abs(i - e) / (2 * q) ** 0.5))
    drawn = [n / s0 * (p @ m @ p) / (z @ z) for p in (rng.permutation(z) for _ in range(4000))]
    assert np.mean(drawn) == pytest.approx(e, abs=5 * (q / 4000) ** 0.5) and np.var(drawn) == pytest.approx(q, rel=0.12)
    whole = autocorr.summary(c, w, "v", 19, shuffles=0).first()  # more cells than may be shuffled
    assert whole.z_norm == pytest.approx(r.z_norm) and whole.p_sim is None and sum(whole.lisa_counts.values()) == n
    flat = autocorr.moran_moments(c.withColumn("v", F.lit(1.0)), w, "v").first()
    assert flat.variance is None and flat.z_norm is None and flat.moran_i is None


def test_conditional_permutations_without_limit(spark, monkeypatch):
    """The shared draws give exactly what a loop over cells gives for them, and p as from draws of each cell's own."""
    monkeypatch.setattr(autocorr, "PERMUTED_CELLS", 10)
    rng = np.random.default_rng(12)
    at = {k: i for i, k in enumerate(sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (90, 2))}))}
    v = rng.normal(size=len(at)) + np.array([a for a, _ in at]) * 0.3
    c = spark.createDataFrame([(*k, float(v[i])) for k, i in at.items()], "lat_idx int, lon_idx int, v double")
    w = neighbors.knn_grid(c, 4)
    n, k, runs, z = len(at), 4, 499, v - v.mean()
    own = z * (_matrix(w, at) @ z)
    draws = [autocorr.distinct_draws(np.random.default_rng([42, p]), n, 1, k + 1)[0] for p in range(runs)]
    got = {at[r.lat_idx, r.lon_idx]: r.p_sim for r in autocorr.local_permutations(c, w, "v", runs).collect()}
    free = []
    for i in range(n):
        lags = [z[[d[k] if j == i else j for j in d[:k]]].mean() for d in draws]
        over = sum(z[i] * x >= own[i] for x in lags)
        assert got[i] == pytest.approx((min(over, runs - over) + 1) / (runs + 1), abs=1.01 / (runs + 1))
        others = np.delete(z, i)
        lags = np.array([rng.choice(others, k, replace=False).mean() for _ in range(2000)])
        over = (z[i] * lags >= own[i]).mean()
        free.append(min(over, 1 - over))
    assert np.abs(np.array([got[i] for i in range(n)]) - free).max() < 5 * (0.25 / runs) ** 0.5


def test_log_determinant_by_traces(spark):
    c = cells(spark, 24, lambda i, j: 0)
    w = neighbors.knn_grid(c)
    exact, traces = regression.ExactLogDeterminant(w, c, 576), regression.TraceLogDeterminant(w, c, 576)
    while traces.refine(0.6):
        pass
    for rho in (-0.4, 0.1, 0.4, 0.6):
        assert abs(traces.value(rho) - exact.value(rho)) <= 1.5 * traces.error(rho) + 1e-9
    assert 0 < traces.error(0.6) < 0.05 * abs(exact.value(0.6)) and traces.error(0.1) < 0.01 and exact.error(0.6) == 0


def test_ols(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    d = pd.DataFrame(x, columns=["a", "b", "c"])
    d["y"] = 2 + 3 * d.a - d.b
    t, fit, _ = regression.ols(spark.createDataFrame(d), "y", ["a", "b", "c"])
    assert [r.coefficient for r in t.collect()] == pytest.approx([2, 3, -1, 0], abs=1e-9)
    assert fit.first().r2 == pytest.approx(1)
    assert regression.t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)


@pytest.mark.parametrize("exact_rows", [4000, 0])
def test_spatial_lag_model_finds_rho(spark, monkeypatch, exact_rows):
    monkeypatch.setattr(regression, "EXACT_ROWS", exact_rows)
    n, rho = 20, 0.6
    c = cells(spark, n, lambda i, j: 0)
    w = neighbors.knn_grid(c)
    at = {(r.lat_idx, r.lon_idx): i for i, r in enumerate(c.collect())}
    m = np.zeros((n * n, n * n))
    for r in w.collect():
        m[at[r.src_lat, r.src_lon], at[r.dst_lat, r.dst_lon]] = r.w
    rng = np.random.default_rng(5)
    x = rng.normal(size=n * n)
    y = np.linalg.solve(np.eye(n * n) - rho * m, 1 + 2 * x + 0.3 * rng.normal(size=n * n))
    d = spark.createDataFrame([(*k, float(x[i]), float(y[i])) for k, i in at.items()], "lat_idx int, lon_idx int, x double, y double")
    table, fit = regression.spatial_lag_model(d, w, "y", ["x"])
    assert fit.first().rho == pytest.approx(rho, abs=0.06)
    assert {r.variable: r.coefficient for r in table.collect()}["x"] == pytest.approx(2, abs=0.1)
    found = {r.variable: r for r in table.collect()}
    r, b = fit.first().rho, np.array([found["const"].coefficient, found["x"].coefficient])
    xx, wy, g = np.column_stack([np.ones(n * n), x]), m @ y, m @ np.linalg.inv(np.eye(n * n) - r * m)
    e = y - r * wy - xx @ b
    s2 = e @ e / (n * n)
    h = np.zeros((4, 4))  # the observed information of (const, x, rho, variance)
    h[:2, :2], h[:2, 2], h[2, :2] = xx.T @ xx / s2, xx.T @ wy / s2, xx.T @ wy / s2
    h[2, 2], h[2, 3], h[3, 2], h[3, 3] = np.trace(g @ g) + wy @ wy / s2, wy @ e / s2**2, wy @ e / s2**2, n * n / (2 * s2**2)
    errors = np.sqrt(np.diag(np.linalg.inv(h)))
    assert [found[v].std_error for v in ("const", "x", "W_y")] == pytest.approx(errors[:3].tolist(), rel=0.002)
    assert found["const"].std_error > 1.5 * math.sqrt(s2 * np.linalg.inv(xx.T @ xx)[0, 0])


def test_range_modes_and_empty_filters(spark):
    p = spark.createDataFrame([(0.0, 180.0)], "latitude double, longitude double")
    assert validate.coordinate_errors(p).first().invalid_lon == 0
    assert validate.coordinate_errors(p, lon_upper_inclusive=False).first().invalid_lon == 1
    assert serving.in_categories(spark.createDataFrame([("a",)], "category string"), []).count() == 0


def test_required_columns():
    class Frame:
        columns = ["latitude"]

    with pytest.raises(ValueError, match="density.*intensity.*longitude"):
        tables.require_columns(Frame())


def test_grid_job_with_skew(spark):
    """All rows in a few cells: sums and counts still add up."""
    d = spark.range(20000).select(F.lit("a").alias("category"), F.lit(10.1).alias("latitude"), (F.col("id") % 2 * 0.25).alias("longitude"), F.lit(3).cast("long").alias("density"), F.lit("0.5").cast("decimal(10,4)").alias("intensity"))
    g = grid.aggregate_grid(d, 0.25).collect()
    assert sorted((r.points, r.density_sum, r.intensity_sum) for r in g) == [(10000, 30000, 5000.0)] * 2
    p = grid.pyramid(d, "density").groupBy("resolution", "top_category").agg(F.sum("raw_weight").alias("s")).collect()
    assert {r.s for r in p} == {60000.0} and len(p) == 6


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    p = points(spark, rng.normal(0, 2, (80, 2)))
    assert labels(pointpattern.dbscan(p.repartition(1), 80.0, 4)) == labels(pointpattern.dbscan(p.repartition(7), 80.0, 4))


def test_entry_points_import_without_optional_parts():
    import __spark_entry__ as e

    assert len(e.queries()) >= len(e.oracle_sql()) > 70


@pytest.mark.parametrize("name", ["e7_boundary_distance", "h6_h7_c20_lisa"])
def test_cells_are_of_one_degree(spark, sf_dir, name):
    from gridwake import fixtures as fx
    from gridwake.plans import catalogue

    assert catalogue.QUERIES[name](spark, sf_dir).count() == grid.aggregate_grid(fx.traffic(spark, sf_dir), 1.0).count()


def test_residual_moran_has_p_of_999_permutations(spark, sf_dir):
    from gridwake.plans import catalogue

    row = catalogue.QUERIES["i3_residual_moran"](spark, sf_dir).first()
    assert 0 < row.p_sim <= 0.501 and row.p_sim * 1000 == pytest.approx(round(row.p_sim * 1000))


def test_p_values_have_the_reference_steps(spark, sf_dir):
    from gridwake.plans import catalogue

    p = [r.p_sim * 1000 for r in catalogue.QUERIES["h9_feature_table"](spark, sf_dir).select("p_sim").collect()]
    assert all(x == pytest.approx(round(x)) for x in p) and any(round(x) % 5 for x in p)


def test_percentiles_of_distinct_values_settle_in_brackets(spark):
    """Groups beyond SMALL_GROUP with no equal values, with many equal ones, and a small one with nulls, against numpy."""
    import numpy as np
    from pyspark.sql import functions as F

    from gridwake.operators import grid

    n = 60_000
    x = spark.range(n).select(F.lit("distinct").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 1024.0).alias("v"))
    x = x.union(spark.range(n).select(F.lit("ties"), F.floor(F.sqrt(F.col("id") % 100)).cast("double"))).union(spark.range(7).select(F.lit("few"), F.when(F.col("id") > 1, F.col("id").cast("double"))))
    at = {"low": 0.0, "median": 0.5, "p95": 0.95, "p999": 0.999, "top": 1.0}
    got = {r.g: r for r in grid.exact_percentiles(x, "v", at, ["g"]).collect()}
    for g in ("distinct", "ties", "few"):
        v = np.array([r.v for r in x.where(F.col("g") == g).collect() if r.v is not None])
        assert all(abs(got[g][name] - np.quantile(v, p)) <= 1e-9 * max(1.0, abs(got[g][name])) for name, p in at.items())
    whole = grid.exact_percentiles(x, "v", {"m": 0.5}).first().m
    assert whole == np.quantile(np.array([r.v for r in x.collect() if r.v is not None]), 0.5)


def test_inventory_names_what_is_there(spark, sf_dir):
    from gridwake.plans import catalogue

    got = {r["name"]: (r.present, r.mb) for r in catalogue.QUERIES["a9_e12_file_inventory"](spark, sf_dir).collect()}
    assert {n for n, (present, _) in got.items() if present} == {"lineitem.parquet", "nation.parquet", "events.parquet", "region.parquet"} and got["traffic.csv"] == (False, None)

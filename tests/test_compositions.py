"""Queries that SQL can't express, held against plain numpy on what they read, or against their tested parts."""

import math

import numpy as np
import pytest

from gridwake.operators import autocorr, neighbors, pointpattern, regression
from gridwake.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    """The regression's table, its weights, and both as arrays."""
    from gridwake.tables import materialize

    m = materialize(catalogue._model(spark, SF))
    w = materialize(neighbors.knn_grid(m))
    rows = m.toPandas().sort_values(["lat_idx", "lon_idx"]).reset_index(drop=True)
    at = {k: i for i, k in enumerate(zip(rows.lat_idx, rows.lon_idx))}
    near = np.full((len(rows), 8), -1)
    for r in w.collect():
        near[at[r.src_lat, r.src_lon], r["rank"] - 1] = at[r.dst_lat, r.dst_lon]
    assert (near >= 0).all()
    return m, w, rows, near


def fitted(rows):
    x = np.c_[np.ones(len(rows)), rows[catalogue.XS].to_numpy()]
    y = rows["log_density"].to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    r = y - x @ beta
    se = np.sqrt(r @ r / (len(y) - 4) * np.diag(np.linalg.inv(x.T @ x)))
    return beta, se, r


def test_regression_table(spark, model):
    beta, se, _ = fitted(model[2])
    got = {r.variable: r for r in catalogue.QUERIES["i1_ols_table"](spark, SF).collect()}
    for name, b, s in zip(["const", *catalogue.XS], beta, se):
        assert (got[name].coefficient, got[name].std_error, got[name].t_stat) == pytest.approx((b, s, b / s), rel=1e-6, abs=1e-9)
        assert got[name].p_value == pytest.approx(math.erfc(abs(b / s) / math.sqrt(2)), abs=2e-3)  # the normal's tail is close at so many rows


def test_residuals_autocorrelation(spark, model):
    _, _, rows, near = model
    r = fitted(rows)[2]
    z = r - r.mean()
    i = lambda v: (v * v[near].mean(axis=1)).sum() / (z @ z)
    drawn = np.array([i(np.random.default_rng([42, k]).permutation(z)) for k in range(999)])
    over = (drawn >= i(z)).sum()
    got = catalogue.QUERIES["i3_residual_moran"](spark, SF).first()
    assert got.moran_i == pytest.approx(i(z), abs=1e-9) and got.expected_i == pytest.approx(-1 / (len(z) - 1))
    assert got.p_sim == pytest.approx((min(over, 999 - over) + 1) / 1000, abs=0.0011) and got.z_sim == pytest.approx((i(z) - drawn.mean()) / drawn.std(), abs=1e-3)


def test_lag_model_on_all_rows(spark, model):
    """The registered query reads every cell, and its rho is where the likelihood with the exact determinant peaks."""
    _, _, rows, near = model
    n, y, x = len(rows), rows["log_density"].to_numpy(), np.c_[np.ones(len(rows)), rows[catalogue.XS].to_numpy()]
    wy = y[near].mean(axis=1)
    e, f = (v - x @ np.linalg.lstsq(x, v, rcond=None)[0] for v in (y, wy))
    got = catalogue.QUERIES["i4_i7_spatial_lag_model"](spark, SF).first()
    w = np.zeros((n, n))
    w[np.arange(n)[:, None], near] = 1 / 8
    like = lambda r: -n / 2 * math.log(((e - r * f) ** 2).sum() / n) + np.linalg.slogdet(np.eye(n) - r * w)[1]
    assert got.n == n and set(got.coefficients) == {"const", *catalogue.XS, "W_y"}
    assert like(got.rho) >= max(like(got.rho - 0.01), like(got.rho + 0.01))


def test_feature_table(spark, model):
    _, _, rows, near = model
    got = catalogue.QUERIES["h9_feature_table"](spark, SF).toPandas().sort_values(["lat_bin", "lon_bin"]).reset_index(drop=True)
    v = rows["log_density"].to_numpy()
    z = v - v.mean()
    lag = z[near].mean(axis=1)
    assert len(got) == len(rows)
    for name, want in (("log_density", v), ("spatial_lag_log_density", v[near].mean(axis=1)), ("local_i", z * lag * (len(z) - 1) / (z @ z)), ("distance_to_port_km", rows["port"] * 1000), ("distance_to_coast_km", rows["coast"] * 1000), ("distance_to_strait_km", rows["strait"] * 1000)):
        assert np.allclose(got[name], want, atol=1e-6), name
    quadrant = np.where(lag > 0, np.where(z > 0, 1, 2), np.where(z > 0, 4, 3))
    assert (got["quadrant"] == quadrant).all()
    label = np.where(got["p_sim"] > 0.05, "NS", np.array(["", "HH", "LH", "LL", "HL"])[quadrant])
    assert (got["lisa_cluster"] == label).all() and got["p_sim"].between(0.001, 0.5).all()


def test_summaries_equal_their_parts(spark, model):
    m, w, _, _ = model
    s = catalogue.QUERIES["h10_autocorrelation_summary"](spark, SF).first()
    labels = {r.lisa_cluster: r["count"] for r in autocorr.lisa(m, w, "log_density").groupBy("lisa_cluster").count().collect()}
    assert s.lisa_counts == labels and sum(labels.values()) == m.count()
    assert s.moran_i == pytest.approx(autocorr.moran(m, w, "log_density").first().moran_i, abs=1e-9)
    hot = catalogue._hot_points(spark, SF)
    g = catalogue.QUERIES["g7_pattern_metrics"](spark, SF).first()
    counts = pointpattern.cluster_counts(pointpattern.dbscan(hot)).first()
    assert (g.clusters, g.noise, g.sizes) == (counts.clusters, counts.noise, counts.sizes)
    assert g.ratio == pytest.approx(pointpattern.nearest_neighbour_ratio(hot).first().ratio)
    k = {r.radius: r.k for r in pointpattern.ripley_k(hot).collect()}
    assert {r.radius: r.k for r in g.ripley} == pytest.approx(k) and all(0.005 <= r.p_value <= 1 for r in g.ripley)
    assert regression.t_tail(0.0, 5) == 1.0

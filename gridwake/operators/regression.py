"""Ordinary and spatial-lag regression from one pass of cross products."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.operators.autocorr import moran_test, normal_tail
from gridwake.operators.neighbors import spatial_lag
from gridwake.tables import materialize

SAMPLE_ROWS = 4000
EXACT_ROWS = 4000  # up to here the determinant comes from eigenvalues
PROBES = 32
STEP_POWERS, MOST_POWERS = 6, 120
TAIL = 0.01  # of the log-likelihood, that powers left out may hold


def _products(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of the products of all pairs of columns, and of the constant, in one aggregate."""
    names = ["_one", *columns]
    x = df.withColumn("_one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = x.agg(*[F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")).alias(f"s{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((len(names), len(names)))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    return m


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(tiny, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = (tiny if abs(d) < tiny else d), (tiny if abs(c) < tiny else c)
            d = 1 / d
            h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return h


def t_tail(t: float, df: int) -> float:
    """Two-sided p of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def ols(df: DataFrame, y: str, xs: list[str]) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Coefficient table (variable, coefficient, std_error, t_stat, p_value), a one-row summary, and the coefficients."""
    m = _products(df, [*xs, y])
    k, n = len(xs) + 1, m[0, 0]
    xx, xy, yy = m[:k, :k], m[:k, k], m[k, k]
    beta = np.linalg.solve(xx, xy)
    ssr = max(0.0, float(yy - beta @ xy))
    sst = float(yy - m[0, k] ** 2 / n)
    dof = int(n) - k
    se = np.sqrt(np.maximum(0, ssr / max(dof, 1) * np.diag(np.linalg.inv(xx))))
    rows = []
    for name, b, s in zip(["const", *xs], beta.tolist(), se.tolist()):
        t = b / s if s > 0 else math.inf
        rows.append((name, float(b), float(s), float(t), t_tail(float(t), dof) if math.isfinite(t) and dof > 0 else 0.0))
    loglik = -n / 2 * (math.log(2 * math.pi * max(ssr, 1e-300) / n) + 1)
    r2 = 1 - ssr / sst if sst > 0 else 1.0
    fit = [(int(n), *map(float, (r2, 1 - (1 - r2) * (n - 1) / max(dof, 1), -2 * loglik + 2 * k, -2 * loglik + k * math.log(n))))]
    spark = df.sparkSession
    return spark.createDataFrame(rows, "variable string, coefficient double, std_error double, t_stat double, p_value double"), spark.createDataFrame(fit, "n long, r2 double, adj_r2 double, aic double, bic double"), beta


def residuals(df: DataFrame, y: str, xs: list[str], beta: np.ndarray) -> DataFrame:
    fitted = F.lit(float(beta[0]))
    for x, b in zip(xs, beta[1:].tolist()):
        fitted = fitted + F.col(x) * b
    return df.withColumn("residual", F.col(y) - fitted)


def residual_moran(df: DataFrame, weights: DataFrame, y: str, xs: list[str], shuffles: int = 999) -> DataFrame:
    """Moran's I of the residuals of an ordinary fit, against its moments and, unless `shuffles` is 0, against shuffled values."""
    r = materialize(residuals(df, y, xs, ols(df, y, xs)[2]))
    return moran_test(r, weights, "residual", shuffles)


def seeded_rows(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """n rows by the order of an integer hash of the cell and the seed, the same whatever the partitioning."""
    h = ((F.col("lat_idx").cast("long") * 1000003 + F.col("lon_idx").cast("long") * 7919 + seed * 104729) * 48271) % 2147483647
    return df.orderBy(h, "lat_idx", "lon_idx").limit(n)


class ExactLogDeterminant:
    """log|I - rho W| from the eigenvalues of a few rows' weights."""

    def __init__(self, weights: DataFrame, cells: DataFrame, n: int):
        c = cells.select("lat_idx", "lon_idx").toPandas().reset_index(drop=True)
        at = {t: i for i, t in enumerate(zip(c.lat_idx, c.lon_idx))}
        w = np.zeros((n, n))
        for r in weights.toPandas().itertuples():
            w[at[r.src_lat, r.src_lon], at[r.dst_lat, r.dst_lon]] = r.w
        self.values = np.linalg.eigvals(w)

    def value(self, rho: float) -> float:
        return float(np.log(np.abs(1 - rho * self.values)).sum())

    def error(self, rho: float) -> float:
        return 0.0

    def refine(self, rho: float) -> bool:
        return False


class TraceLogDeterminant:
    """log|I - rho W| as minus the sum of rho^k tr(W^k) / k, by joins alone (Barry and Pace 1999).

    tr(W) and tr(W^2) are exact; further traces are means over probes of random signs, one join of the weights with the probes for each power. What
    powers over m hold is at most F rho^(m+1) / ((m+1) (1 - rho)) with F the square norm of W^(m/2), since eigenvalues of row-standardised weights lie in the
    unit circle and their squares sum to no more than that norm (Schur). The error is twice the probes' standard error plus that.
    """

    def __init__(self, weights: DataFrame, cells: DataFrame, n: int):
        self.weights, self.names = weights, [f"p{i}" for i in range(PROBES)]
        back = weights.select(F.col("dst_lat").alias("src_lat"), F.col("dst_lon").alias("src_lon"), F.col("src_lat").alias("dst_lat"), F.col("src_lon").alias("dst_lon"), F.col("w").alias("v"))
        self.second = weights.join(back, ["src_lat", "src_lon", "dst_lat", "dst_lon"]).agg(F.sum(F.col("w") * F.col("v"))).first()[0] or 0.0
        own = weights.where("src_lat = dst_lat and src_lon = dst_lon").agg(F.sum("w"))
        self.first = own.first()[0] or 0.0
        self.x = cells.select("lat_idx", "lon_idx", *[self._sign(i).alias(p) for i, p in enumerate(self.names)])
        self.traces, self.norms = [], [float(n)]  # by power: one number for each probe; square norms

    @staticmethod
    def _sign(i: int):
        return F.when(F.xxhash64("lat_idx", "lon_idx", F.lit(i)) % 2 == 0, 1.0).otherwise(-1.0)

    def _power(self) -> None:
        v = self.x.withColumnsRenamed({"lat_idx": "dst_lat", "lon_idx": "dst_lon"})
        lagged = self.weights.join(v, ["dst_lat", "dst_lon"]).groupBy(F.col("src_lat").alias("lat_idx"), F.col("src_lon").alias("lon_idx")).agg(*[F.sum(F.col("w") * F.col(p)).alias(p) for p in self.names])
        self.x = materialize(lagged)
        row = self.x.agg(*[F.sum(F.col(p) * self._sign(i)).alias(p) for i, p in enumerate(self.names)], *[F.sum(F.col(p) * F.col(p)).alias(f"s{p}") for p in self.names]).first()
        self.traces.append(np.array([row[p] or 0.0 for p in self.names]))
        self.norms.append(float(np.mean([row[f"s{p}"] or 0.0 for p in self.names])))

    def _sums(self, rho: float) -> np.ndarray:
        return -sum((rho**k * t / k for k, t in enumerate(self.traces, 1) if k > 2), np.zeros(PROBES))

    def value(self, rho: float) -> float:
        return float(self._sums(rho).mean() - rho * self.first - rho * rho * self.second / 2)

    def _tail(self, rho: float) -> float:
        m, r = len(self.traces), abs(rho)
        return self.norms[m // 2] * r ** (m + 1) / ((m + 1) * (1 - r)) if r < 1 else math.inf

    def error(self, rho: float) -> float:
        return float(2 * self._sums(rho).std(ddof=1) / math.sqrt(PROBES) + self._tail(rho))

    def refine(self, rho: float) -> bool:
        """Take more powers if those left out may matter at rho; whether any were taken."""
        if self.traces and (self._tail(rho) <= TAIL or len(self.traces) >= MOST_POWERS):
            return False
        for _ in range(STEP_POWERS):
            self._power()
        return True


def spatial_lag_model(df: DataFrame, weights: DataFrame, y: str, xs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Maximum-likelihood y = rho W y + X b + e: (variable, coefficient, std_error, z_stat, p_value) and (rho, aic, pseudo_r2, n, logdet_error).

    The likelihood, concentrated in rho, needs one aggregate of cross products and the log-determinant: from eigenvalues up to EXACT_ROWS rows, else from traces,
    with powers until those left out can't move it, and a bound of its error. Standard errors come from the observed information of all parameters.
    """
    lagged = spatial_lag(df, weights, y, "_wy")
    m = _products(lagged, [*xs, y, "_wy"])
    k, n = len(xs) + 1, int(m[0, 0])
    xx = m[:k, :k]
    inv = np.linalg.inv(xx)
    by, bw = inv @ m[:k, k], inv @ m[:k, k + 1]
    ee = m[k, k] - by @ m[:k, k]
    ew = m[k, k + 1] - by @ m[:k, k + 1]
    ww = m[k + 1, k + 1] - bw @ m[:k, k + 1]
    logdet = ExactLogDeterminant(weights, df, n) if n <= EXACT_ROWS else TraceLogDeterminant(weights, df, n)

    def loglik(rho: float) -> float:
        s2 = max(1e-300, (ee - 2 * rho * ew + rho * rho * ww) / n)
        return -n / 2 * (math.log(2 * math.pi * s2) + 1) + logdet.value(rho)

    def peak() -> float:
        lo, hi, g = -0.99, 0.999, (math.sqrt(5) - 1) / 2
        for _ in range(80):  # golden section; the concentrated likelihood has one peak
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if loglik(a) > loglik(b) else (a, hi)
        return (lo + hi) / 2

    rho = 0.5
    while logdet.refine(rho):
        rho = peak()
    rho = peak()
    s2 = (ee - 2 * rho * ew + rho * rho * ww) / n
    h = 1e-4
    curve = -(loglik(rho + h) - 2 * loglik(rho) + loglik(rho - h)) / h**2
    beta = by - rho * bw
    of_rho = 1 / curve if curve > 0 else math.nan
    # The coefficients are by - rho bw, so rho's variance adds to theirs: the inverse of the observed information, block by block.
    se = [*np.sqrt(s2 * np.diag(inv) + bw * bw * of_rho).tolist(), math.sqrt(of_rho)]
    rows = [(name, float(b), float(s), float(b / s) if s else math.inf, normal_tail(b / s) if s else 0.0) for name, b, s in zip(["const", *xs, "W_y"], [*beta.tolist(), rho], se)]
    fitted = F.lit(rho) * F.col("_wy") + F.lit(float(beta[0]))
    for x, b in zip(xs, beta[1:].tolist()):
        fitted = fitted + F.col(x) * b
    r = lagged.agg(F.corr(F.col(y), fitted).alias("r")).first()["r"] or 0.0
    spark = df.sparkSession
    fit = [(float(rho), float(-2 * loglik(rho) + 2 * (k + 1)), float(r * r), n, logdet.error(rho))]
    return spark.createDataFrame(rows, "variable string, coefficient double, std_error double, z_stat double, p_value double"), spark.createDataFrame(fit, "rho double, aic double, pseudo_r2 double, n long, logdet_error double")


def documents(coefficients: DataFrame, fit: DataFrame) -> DataFrame:
    """One row: the fit's columns and a map from variable to coefficient."""
    c = coefficients.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", "coefficient")))).alias("coefficients"))
    return fit.crossJoin(c)


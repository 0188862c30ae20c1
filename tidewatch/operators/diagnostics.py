"""Decomposition, stationarity and residual diagnostics per series, as DataFrames of numbers.

Autocorrelations are joins-free window aggregates; loess, unit-root and partial autocorrelation kernels run per series
as Arrow-backed grouped functions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import ratio
from ..functions.ship import ship
from ..functions.special import NORMAL, chi2_sf
from .series import _numbered


def acf(df: DataFrame, by: list[str], order: str, value: str, nlags: int) -> DataFrame:
    """by, lag, acf, band (1.96 / sqrt n), n: biased autocorrelations of lags 0 to nlags, all lags in one pass."""
    whole = W.partitionBy(*by)
    rows = _numbered(df, by, order, value).withColumn("z", F.col("y") - F.avg("y").over(whole))
    w = whole.orderBy("i")
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("z") * F.lag("z", k).over(w)).alias("p")) for k in range(nlags + 1)])
    long = rows.withColumn("lags", lags).select(*by, "n", F.explode("lags").alias("x")).groupBy(*by, F.col("x.lag").alias("lag")).agg(F.sum("x.p").alias("c"), F.max("n").alias("n"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("c"))).over(whole)
    return long.withColumn("acf", ratio(F.col("c"), zero)).filter(F.col("lag") < F.col("n")).select(*by, "lag", "acf", (1.96 / F.sqrt("n")).alias("band"), "n")


def ljung_box(df: DataFrame, by: list[str], order: str, value: str, nlags: int = 10) -> DataFrame:
    """by, lb_stat, lb_pvalue over lags 1 to min(nlags, n // 5)."""
    rows = acf(df, by, order, value, nlags).filter((F.col("lag") >= 1) & (F.col("lag") <= F.greatest(F.lit(1), F.floor(F.col("n") / 5))))
    q = rows.groupBy(*by).agg((F.max("n") * (F.max("n") + 2) * F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag")))).alias("lb_stat"), F.count("*").alias("k"))
    p = F.udf(lambda x, k: None if x is None else chi2_sf(x, k), "double")  # one call a series
    return ship(q).select(*by, "lb_stat", p("lb_stat", "k").alias("lb_pvalue"))


def _grouped(df: DataFrame, by: list[str], order: str, value: str, kernel, schema: str) -> DataFrame:
    """Run kernel(array) -> dict of equally long lists on every ordered series."""
    ship(df)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        made = kernel(pdf[value].to_numpy(float))
        n = len(next(iter(made.values())))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * n for c in by}, **made})

    keys = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in by)
    return df.select(*by, order, F.col(value).cast("double").alias(value)).groupBy(*by).applyInPandas(run, f"{keys}, {schema}")


def _loess(y: np.ndarray, span: int, at: np.ndarray, jump_ends: int = 0) -> np.ndarray:
    """Local lines with tricube weights at positions ``at`` of an equally spaced series."""
    n, x = len(y), np.arange(len(y), dtype=float)
    out = np.empty(len(at))
    q = min(span, n)
    for k, p in enumerate(at):
        lo = int(min(max(0, round(p - (q - 1) / 2)), n - q))
        xs, ys = x[lo : lo + q], y[lo : lo + q]
        h = max(abs(p - xs[0]), abs(xs[-1] - p)) + (span - n) // 2 * (span > n)
        u = np.clip(np.abs(xs - p) / (h if h > 0 else 1), 0, 1)
        w = (1 - u**3) ** 3
        w = np.where(w > 0, w, 0)
        if w.sum() <= 0:
            w = np.ones(q)
        w = w / w.sum()
        centre = (w * xs).sum()
        var = (w * (xs - centre) ** 2).sum()
        out[k] = (w * ys).sum() + ((p - centre) * (w * (xs - centre) * ys).sum() / var if var > 1e-12 else 0.0)
    return out


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(y, np.ones(n) / n, "valid")


def stl(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend parts by loess (Cleveland et al. 1990), without robustness weights."""
    n = len(y)
    trend_span = math.ceil(1.5 * period / (1 - 1.5 / seasonal))
    trend_span += trend_span % 2 == 0
    low_span = period + (period % 2 == 0)
    trend, season = np.zeros(n), np.zeros(n)
    for _ in range(inner):
        d = y - trend
        cycle = np.empty(n + 2 * period)
        for s in range(period):
            sub = d[s::period]
            cycle[s::period][: len(sub) + 2] = _loess(sub, seasonal, np.arange(-1, len(sub) + 1, dtype=float))
        low = _moving(_moving(_moving(cycle, period), period), 3)[:n]
        season = cycle[period : period + n] - _loess(low, low_span, np.arange(n, dtype=float))
        trend = _loess(y - season, trend_span, np.arange(n, dtype=float))
    return season, trend


def mstl(y: np.ndarray, periods: list[int], iterate: int = 2) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Trend, seasonal parts and remainder for several periods (Bandara et al. 2021)."""
    periods = sorted(p for p in periods if 1 < p < len(y) / 2)
    if not periods:
        trend = _loess(y, max(7, len(y) // 2 * 2 + 1), np.arange(len(y), dtype=float))
        return trend, [], y - trend
    seasons = [np.zeros(len(y)) for _ in periods]
    left, trend = y.copy(), np.zeros(len(y))
    for _ in range(iterate if len(periods) > 1 else 1):
        for k, p in enumerate(periods):
            left = left + seasons[k]
            seasons[k], trend = stl(left, p, 11 + 4 * k)
            left = left - seasons[k]
    return trend, seasons, left - trend


def seasonal_decompose(df: DataFrame, by: list[str], order: str, value: str, periods: int | list[int]) -> DataFrame:
    """by, i, y, trend, seasonal (array, one part per usable period), resid."""
    periods = [periods] if isinstance(periods, int) else list(periods)

    def kernel(y):
        trend, seasons, resid = mstl(y, periods)
        parts = np.stack(seasons, axis=1).tolist() if seasons else [[]] * len(y)
        return {"i": list(range(len(y))), "y": y, "trend": trend, "seasonal": parts, "resid": resid}

    return _grouped(df, by, order, value, kernel, "i long, y double, trend double, seasonal array<double>, resid double")


def decomposition_summary(df: DataFrame, by: list[str], order: str, value: str, periods: int | list[int], nlags: int = 10) -> DataFrame:
    """by, trend_r2, trend_p, lb_stat, lb_pvalue of the remainder."""
    from .series import trend_significance

    parts = seasonal_decompose(df, by, order, value, periods)
    trend = trend_significance(df, by, order, value).withColumnsRenamed({"r2": "trend_r2", "p_value": "trend_p"})
    return trend.join(ljung_box(parts, by, "i", "resid", nlags), by)


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    rss = float(e @ e)
    cov = np.linalg.pinv(x.T @ x) * rss / max(1, len(y) - x.shape[1])
    return beta, np.sqrt(np.diag(cov)), rss


def adf(y: np.ndarray) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller statistic with a constant, its p-value (MacKinnon 1994) and the lag of least AIC."""
    n = len(y)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if top < 0 or np.ptp(y) == 0:
        return math.nan, math.nan, 0
    d = np.diff(y)

    def design(lags: int, skip: int):
        rows = np.arange(skip, len(d))
        return np.column_stack([y[rows], *[d[rows - k] for k in range(1, lags + 1)], np.ones(len(rows))]), d[rows]

    best = (math.inf, 0)
    for lags in range(top + 1):
        x, z = design(lags, top)
        _, _, rss = _ols(x, z)
        if rss > 0:
            best = min(best, (len(z) * (math.log(2 * math.pi * rss / len(z)) + 1) + 2 * x.shape[1], lags))
    x, z = design(best[1], best[1])
    beta, se, _ = _ols(x, z)
    t = float(beta[0] / se[0])
    if t > 2.74:
        return t, 1.0, best[1]
    if t < -18.83:
        return t, 0.0, best[1]
    fit = (2.1659, 1.4412, 0.038269) if t <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    return t, NORMAL.cdf(sum(c * t**k for k, c in enumerate(fit))), best[1]


def pacf(y: np.ndarray, nlags: int) -> np.ndarray:
    """Partial autocorrelations by Yule-Walker (adjusted) and Durbin-Levinson."""
    z = y - y.mean()
    n = len(z)
    r = np.array([(z[k:] @ z[: n - k]) / (n - k) for k in range(nlags + 1)])
    r = r / r[0] if r[0] > 0 else r * np.nan
    out, phi = [1.0], np.zeros(0)
    for k in range(1, nlags + 1):
        a = (r[k] - phi @ r[1:k][::-1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
        phi = np.append(phi - a * phi[::-1], a)
        out.append(float(a))
    return np.array(out)


def stationarity(df: DataFrame, by: list[str], order: str, value: str, nlags: int = 30) -> DataFrame:
    """by, adf_stat, adf_pvalue, adf_lag, pacf (array of lags 0 to min(nlags, n // 2 - 1)); acf() has the rest."""

    def kernel(y):
        t, p, lag = adf(y)
        return {"adf_stat": [t], "adf_pvalue": [p], "adf_lag": [lag], "pacf": [pacf(y, max(0, min(nlags, len(y) // 2 - 1))).tolist()]}

    return _grouped(df, by, order, value, kernel, "adf_stat double, adf_pvalue double, adf_lag int, pacf array<double>")


def arch_lm(y: np.ndarray, nlags: int) -> tuple[float, float]:
    """Engle's test: n R^2 of squared residuals on their own lags."""
    s = y**2
    k = min(nlags, len(s) // 5)
    if k < 1:
        return math.nan, math.nan
    x = np.column_stack([*[s[k - j : len(s) - j] for j in range(1, k + 1)], np.ones(len(s) - k)])
    z = s[k:]
    _, _, rss = _ols(x, z)
    tss = float(((z - z.mean()) ** 2).sum())
    stat = len(z) * (1 - rss / tss) if tss > 0 else math.nan
    return stat, chi2_sf(stat, k) if stat == stat else math.nan


def residual_analysis(df: DataFrame, by: list[str], order: str, value: str, nlags: int = 10) -> DataFrame:
    """by, lb_stat, lb_pvalue, arch_stat, arch_pvalue."""

    def kernel(y):
        stat, p = arch_lm(y, nlags)
        return {"arch_stat": [stat], "arch_pvalue": [p]}

    return ljung_box(df, by, order, value, nlags).join(_grouped(df, by, order, value, kernel, "arch_stat double, arch_pvalue double"), by)


def qq(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, rank, theoretical, sample: normal order-statistic medians (Filliben) against sorted values."""
    w = W.partitionBy(*by)
    rows = df.select(*by, F.col(value).cast("double").alias("sample"), F.row_number().over(w.orderBy(value)).alias("rank"), F.count("*").over(w).alias("n"))
    end = F.pow(F.lit(0.5), 1 / F.col("n"))
    u = F.when(F.col("rank") == F.col("n"), end).when(F.col("rank") == 1, 1 - end).otherwise((F.col("rank") - 0.3175) / (F.col("n") + 0.365))

    import pandas as pd

    def inverse(s: pd.Series) -> pd.Series:
        return s.map(NORMAL.inv_cdf)

    inverse.__annotations__ = {"s": pd.Series, "return": pd.Series}
    ppf = F.pandas_udf(inverse, "double")

    return ship(rows).select(*by, "rank", ppf(u).alias("theoretical"), "sample")

"""Operators on ordered series of a panel: features, windows, complexity, memory, interpolation and stability.

Rows have no order of their own, so every function takes the grouping columns ``by``, the ``order`` column and the
``value`` column. Everything is window functions, joins and aggregates per series; only folds over earlier outputs
(``hfi``, ``rsi``) are kernels over a series.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import ratio
from ..functions.ship import ship
from ..functions.special import t_sf

SEASONS = {"daily": (F.hour, 24), "weekly": (F.weekday, 7), "monthly": (F.month, 12), "quarterly": (F.quarter, 4), "yearly": (F.dayofyear, 365)}


def _w(by: list[str], order: str):
    return W.partitionBy(*by).orderBy(order)


def _numbered(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, i (from 0), y, n (length)."""
    return df.select(*by, (F.row_number().over(_w(by, order)) - 1).cast("long").alias("i"), F.col(value).cast("double").alias("y"), F.count("*").over(W.partitionBy(*by)).alias("n"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_median(a: Column) -> Column:
    return let(F.sort_array(a), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


# Features ---------------------------------------------------------------------------------------------------------


def fourier_seasonality(df: DataFrame, time: str, seasonality: list[str]) -> DataFrame:
    """Adds NAME_sin and NAME_cos of the calendar position for each season named."""
    for name in seasonality:
        if name not in SEASONS:
            raise ValueError(f"unknown seasonality {name!r}")
        part, period = SEASONS[name]
        angle = part(F.col(time)) * (2 * math.pi / period)
        df = df.withColumn(f"{name}_sin", F.sin(angle)).withColumn(f"{name}_cos", F.cos(angle))
    return df


def remove_leading_zeros(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows from the first one that is not 0 on (a null counts as such); a series of zeros stays whole."""
    other = F.coalesce(F.col(value) != 0, F.lit(True))
    rows = df.withColumn("_on", F.max(other).over(_w(by, order).rowsBetween(W.unboundedPreceding, 0))).withColumn("_any", F.max(other).over(W.partitionBy(*by)))
    return rows.filter(F.col("_on") | ~F.col("_any")).drop("_on", "_any")


def is_obsolete(df: DataFrame, by: list[str], time: str, value: str, days: int) -> DataFrame:
    """by, obsolete: all zero over the last ``days`` days of the series, both ends included."""
    last = df.withColumn("_last", F.max(time).over(W.partitionBy(*by))).filter(F.col(time) >= F.col("_last") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return last.groupBy(*by).agg(F.every(F.coalesce(F.col(value) == 0, F.lit(False))).alias("obsolete"))


def generate_lag(df: DataFrame, by: list[str], order: str, value: str, lag: int = 1, name: str = "diff") -> DataFrame:
    """Adds the seasonal difference to ``lag`` rows before."""
    return df.withColumn(name, F.col(value) - F.lag(value, lag).over(_w(by, order)))


def standardize_returns(df: DataFrame, by: list[str], order: str, value: str, log: bool = True, standardize: bool = True, name: str = "returns") -> DataFrame:
    r = ratio(F.col(value), F.lag(value).over(_w(by, order)))
    df = df.withColumn(name, F.log(F.when(r > 0, r)) if log else r - 1)
    if standardize:
        whole = W.partitionBy(*by)
        df = df.withColumn(name, ratio(F.col(name) - F.avg(name).over(whole), F.stddev_pop(name).over(whole)))
    return df


def estimate_history_length(seasonal_period: int, horizon: int) -> int:
    return int(1.25 * max(seasonal_period, horizon))


# Interpolation ----------------------------------------------------------------------------------------------------


def _share(w: float) -> None:
    if not 0 <= w <= 1:
        raise ValueError("the weight lies in [0, 1]")


def vi(forecasts: DataFrame, anchors: DataFrame, on: list[str], y_hat: str, anchor: str, w: float) -> DataFrame:
    """Vertical: w anchor + (1 - w) forecast, joined on ``on``."""
    _share(w)
    return forecasts.join(anchors, on).withColumn("vi", w * F.col(anchor).cast("double") + (1 - w) * F.col(y_hat).cast("double"))


def hpi(df: DataFrame, by: list[str], order: str, y_hat: str, w: float) -> DataFrame:
    """Horizontal partial: each forecast with the original before it."""
    _share(w)
    y = F.col(y_hat).cast("double")
    return df.withColumn("hpi", F.coalesce(w * F.lag(y).over(_w(by, order)) + (1 - w) * y, y))


def _folded(df: DataFrame, by: list[str], order: str, value: str, fold: Callable[[list[float]], list[float]], name: str) -> DataFrame:
    """by, order, ``name``: fold maps a series' ordered values to as many, in one pass; a series a task. Null is NaN to it."""

    def kernel(pdf):
        import pandas as pd

        pdf = pdf.sort_values([order, value])
        return pd.DataFrame({**{c: pdf[c] for c in [*by, order]}, name: fold(pdf[value].to_list())})

    keys = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in [*by, order])
    return ship(df).select(*by, order, F.col(value).cast("double").alias(value)).groupBy(*by).applyInPandas(kernel, f"{keys}, `{name}` double")


def hfi(df: DataFrame, by: list[str], order: str, y_hat: str, w: float) -> DataFrame:
    """Horizontal full: w times the output before + (1 - w) forecast."""
    _share(w)
    return _folded(df, by, order, y_hat, lambda a: list(accumulate(a, lambda last, y: w * last + (1 - w) * y)), "hfi")


# Windows ----------------------------------------------------------------------------------------------------------


def rolling_window(df: DataFrame, by: list[str], order: str, value: str, window_size: int, func: Callable[[Column], Column], name: str = "rolling") -> DataFrame:
    """Trailing window of an aggregate; rows before the first full window take its value."""
    if window_size < 2:
        raise ValueError("window_size is 2 or more")
    return _filled(df, by, order, func(F.col(value)).over(_w(by, order).rowsBetween(1 - window_size, 0)), window_size, name)


def expanding_window(df: DataFrame, by: list[str], order: str, value: str, func: Callable[[Column], Column], window_size: int = 1, name: str = "expanding") -> DataFrame:
    """Aggregate of all rows so far, from ``window_size`` rows on; earlier rows take the first value."""
    return _filled(df, by, order, func(F.col(value)).over(_w(by, order).rowsBetween(W.unboundedPreceding, 0)), window_size, name)


def _filled(df: DataFrame, by: list[str], order: str, made: Column, size: int, name: str) -> DataFrame:
    rows = df.withColumn(name, F.when(F.row_number().over(_w(by, order)) >= size, made))
    first = F.first(name, ignorenulls=True).over(_w(by, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn(name, F.coalesce(name, first))


def hampel_filter(df: DataFrame, by: list[str], order: str, value: str, window_size: int = 3, factor: float = 3.0, scale: float = 1.4826, name: str = "outlier") -> DataFrame:
    """Whether a value is over factor * scale * MAD from the median of its trailing window; false before a full one."""
    w = _w(by, order)
    rows = df.withColumn("_a", F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(1 - window_size, 0)))
    rows = rows.withColumn("_m", array_median(F.col("_a"))).withColumn("_d", array_median(F.transform("_a", lambda x: F.abs(x - F.col("_m")))))
    full = F.row_number().over(w) >= window_size
    return rows.withColumn(name, full & (F.abs(F.col(value) - F.col("_m")) > factor * scale * F.col("_d"))).drop("_a", "_m", "_d")


def bollinger_bands(df: DataFrame, by: list[str], order: str, value: str, window_size: int = 20, center: Callable = F.avg, spread: Callable = F.stddev_pop, factor: float = 2.0, name: str = "outlier") -> DataFrame:
    """Whether a value lies outside centre +- factor * spread of its trailing window."""
    df = rolling_window(df, by, order, value, window_size, center, "_c")
    df = rolling_window(df, by, order, value, window_size, spread, "_s")
    y, c, s = F.col(value), F.col("_c"), F.col("_s")
    return df.withColumn(name, (y < c - factor * s) | (y > c + factor * s)).drop("_c", "_s")


def rsi(df: DataFrame, by: list[str], order: str, value: str, window: int = 14) -> DataFrame:
    """Relative strength index by Wilder's recursion. The seed takes the first window + 1 differences over ``window``,
    and the first ``window`` outputs are its value; 0 where no loss has been seen."""

    def index(up: float, down: float) -> float:
        return 0.0 if down == 0 else 100 - 100 / (1 + up / down)

    def fold(a: list[float]) -> list[float]:
        deltas = [q - p for p, q in zip(a, a[1:])] or [0.0] * len(a)
        up, down = (sum(max(0.0, sign * d) for d in deltas[: window + 1]) / window for sign in (1, -1))
        out = [index(up, down)] * window
        for d in deltas[window - 1 :]:
            up, down = (up * (window - 1) + max(0.0, d)) / window, (down * (window - 1) + max(0.0, -d)) / window
            out.append(index(up, down))
        return out[: len(a)]

    return _folded(df, by, order, value, fold, "rsi")


# Scalars per series -----------------------------------------------------------------------------------------------


def adi_cv(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, adi (rows per row that is not 0), cv2 (squared variation, sample deviation, zeros included)."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(ratio(F.count("*"), F.count_if(v != 0)).alias("adi"), F.pow(ratio(F.stddev_samp(v), F.avg(v)), 2.0).alias("cv2"))


def trend_significance(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, r2, p_value of a straight line over the positions 0, 1, ..."""
    fit = _numbered(df, by, order, value).groupBy(*by).agg(F.regr_r2("y", "i").alias("r2"), F.count("*").alias("n"))
    p = F.udf(lambda r2, n: None if r2 is None or n < 3 else 0.0 if r2 >= 1 else 2 * t_sf(math.sqrt(r2 * (n - 2) / (1 - r2)), n - 2), "double")  # one call a series
    return ship(fit).select(*by, "r2", p("r2", "n").alias("p_value"))


def foreca(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, omega: 1 - spectral entropy of the demeaned series' periodogram, over its largest value."""
    ship(df)

    def kernel(pdf):
        import numpy as np
        import pandas as pd

        y = pdf.sort_values(order)[value].to_numpy(float)
        power = np.abs(np.fft.rfft(y - y.mean())) ** 2
        power[1 : -1 if len(y) % 2 == 0 else None] *= 2
        p = power / power.sum() if power.sum() > 0 else power * np.nan
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "omega": [1 + (p * np.log2(p + 1e-12)).sum() / np.log2(len(p))]})

    keys = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in by)
    return df.select(*by, order, F.col(value).cast("double").alias(value)).groupBy(*by).applyInPandas(kernel, f"{keys}, omega double")


def detrend(df: DataFrame, by: list[str], order: str, value: str, kind: str = "linear") -> DataFrame:
    """by, i, y, n with a fitted line or the mean taken off y."""
    rows, w = _numbered(df, by, order, value), W.partitionBy(*by)
    if kind == "constant":
        return rows.withColumn("y", F.col("y") - F.avg("y").over(w))
    sxy, sxx = F.covar_pop("i", "y").over(w), F.var_pop("i").over(w)
    slope = F.coalesce(ratio(sxy, sxx), F.lit(0.0))
    return rows.withColumn("y", F.col("y") - F.avg("y").over(w) - slope * (F.col("i") - F.avg("i").over(w)))


def sample_entropy(df: DataFrame, by: list[str], order: str, value: str, m: int = 1, tolerance: float | None = None, detrended: bool = False) -> DataFrame:
    """by, sampen, regularity (exp of its negative). Pairs of templates nearer than the tolerance (0.2 deviations unless
    given) are joined on cells one tolerance wide, so a series meets its neighbours and not itself squared."""
    if tolerance is not None and tolerance <= 0:
        raise ValueError("the tolerance is positive")
    rows = _numbered(df, by, order, value)
    if detrended:
        sig = trend_significance(df, by, order, value).select(*by, F.coalesce((F.col("r2") > 0.3) & (F.col("p_value") < 0.05), F.lit(False)).alias("_line"))
        line, flat = (detrend(df, by, order, value, k) for k in ("linear", "constant"))
        rows = line.join(sig.filter("_line").drop("_line"), by).unionByName(flat.join(sig.filter("not _line").drop("_line"), by))
    w = W.partitionBy(*by).orderBy("i")
    tol = F.lit(float(tolerance)) if tolerance else 0.2 * F.stddev_pop("y").over(W.partitionBy(*by))
    rows = rows.withColumn("tol", tol).withColumn("t", F.array(*[F.lead("y", k).over(w) for k in range(m + 1)]))
    rows = rows.filter((F.col("i") < F.col("n") - m) & (F.col("tol") > 0)).withColumn("cell", F.floor(F.col("y") / F.col("tol")))
    left = rows.select(*by, F.col("i").alias("a"), F.col("t").alias("ta"), "tol", "n", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("cell"))
    right = rows.select(*by, F.col("i").alias("b"), F.col("t").alias("tb"), "cell")
    near = lambda k: F.forall(F.slice(F.zip_with("ta", "tb", lambda p, q: F.abs(p - q)), 1, k), lambda d: d < F.col("tol"))
    longer = (F.col("b") < F.col("n") - m - 1) & near(m + 1)
    counts = left.join(right, [*by, "cell"]).filter((F.col("a") < F.col("b")) & near(m)).groupBy(*by).agg(F.count("*").alias("b_n"), F.count_if(longer).alias("a_n"))
    found = rows.select(*by).distinct().join(counts, by, "left")
    s = -F.log(F.when((F.col("a_n") > 0) & (F.col("b_n") > 0), F.col("a_n") / F.col("b_n")))
    return found.select(*by, s.alias("sampen"), F.exp(-s).alias("regularity"))


def _patterns(df: DataFrame, by: list[str], order: str, value: str, m: int, delay: int) -> DataFrame:
    """by, i, p: ordinal pattern of the m values from i on, ties by position."""
    rows = _numbered(df, by, order, value)
    w = W.partitionBy(*by).orderBy("i")
    cells = F.array(*[F.struct(F.lead("y", k * delay).over(w).alias("v"), F.lit(k).alias("k")) for k in range(m)])
    made = F.array_join(F.transform(F.sort_array(cells), lambda x: x["k"].cast("string")), "-")
    return rows.select(*by, "i", F.when(F.col("i") < F.col("n") - delay * (m - 1), made).alias("p")).filter("p is not null")


def _entropy(rows: DataFrame, by: list[str], what: list[str], name: str) -> DataFrame:
    counts = rows.groupBy(*by, *what).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(*by))
    return counts.withColumn("q", p).groupBy(*by).agg((-F.sum(F.col("q") * F.log2("q"))).alias(name))


def permutation_entropy(df: DataFrame, by: list[str], order: str, value: str, m: int = 3, delay: int = 1, normalize: bool = True) -> DataFrame:
    """by, entropy, limit (1 - normalised entropy)."""
    if m < 2 or delay < 1:
        raise ValueError("m is 2 or more, delay 1 or more")
    top = math.log2(math.factorial(m))
    h = _entropy(_patterns(df, by, order, value, m, delay), by, ["p"], "h")
    return h.select(*by, (F.col("h") / top if normalize else F.col("h")).alias("entropy"), (1 - F.col("h") / top).alias("limit"))


def pami(df: DataFrame, by: list[str], order: str, value: str, taus: list[int], m: int = 3, delay: int = 1, normalize: bool = False) -> DataFrame:
    """by, tau, pami: mutual information between ordinal patterns ``tau`` apart, for all taus in one pass."""
    w = W.partitionBy(*by).orderBy("i")
    p = _patterns(df, by, order, value, m, delay)
    pairs = F.array(*[F.struct(F.lit(t).alias("tau"), F.lead("p", t).over(w).alias("z")) for t in taus])
    rows = p.withColumn("pairs", pairs).select(*by, "p", F.explode("pairs").alias("x")).select(*by, F.col("x.tau").alias("tau"), "p", F.col("x.z").alias("z")).filter("z is not null")
    by = [*by, "tau"]
    joint = rows.groupBy(*by, "p", "z").agg(F.count("*").alias("c"))
    n = F.sum("c").over(W.partitionBy(*by))
    joint = joint.withColumn("q", F.col("c") / n).withColumn("qp", F.sum("c").over(W.partitionBy(*by, "p")) / n).withColumn("qz", F.sum("c").over(W.partitionBy(*by, "z")) / n)
    out = joint.groupBy(*by).agg(F.sum(F.col("q") * F.log2(F.col("q") / (F.col("qp") * F.col("qz")))).alias("i"), (-F.sum(F.col("q") * F.log2("qp"))).alias("hp"), (-F.sum(F.col("q") * F.log2("qz"))).alias("hz"))
    low = F.least("hp", "hz")
    return out.select(*by, (F.coalesce(ratio(F.col("i"), low), F.lit(0.0)) if normalize else F.col("i")).alias("pami"))


def pami_minima(df: DataFrame, by: list[str], order: str, value: str, nlags: int = 30, **options) -> DataFrame:
    """pami() over lags 1 to nlags with ``minimum``: lower than at both neighbouring lags."""
    rows = pami(df, by, order, value, list(range(1, nlags + 1)), **options)
    w = W.partitionBy(*by).orderBy("tau")
    low = (F.col("pami") < F.lag("pami").over(w)) & (F.col("pami") < F.lead("pami").over(w))
    return rows.withColumn("minimum", F.coalesce(low, F.lit(False)))


def hurst_exponent(df: DataFrame, by: list[str], order: str, value: str, d: int = 1) -> DataFrame:
    """by, hurst, p_value (of a random walk) by rescaled ranges over windows of 2, 4, 8, ... differences."""
    if d not in (0, 1, 2):
        raise ValueError("d is 0, 1 or 2")
    rows = _numbered(df, by, order, value).filter("n >= 30")
    w = W.partitionBy(*by).orderBy("i")
    for _ in range(d):
        rows = rows.withColumn("y", F.col("y") - F.lag("y").over(w))
    rows = rows.filter("y is not null").withColumn("i", F.row_number().over(w) - 1).withColumn("size", F.count("*").over(W.partitionBy(*by)))
    sizes = F.transform(F.sequence(F.lit(1), F.floor(F.log2("size")).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("long"))
    parts = rows.select(*by, "i", "y", "size", F.explode(sizes).alias("w")).withColumn("g", F.floor(F.col("i") / F.col("w"))).filter("(g + 1) * w <= size")
    block = W.partitionBy(*by, "w", "g")
    parts = parts.withColumn("z", F.col("y") - F.avg("y").over(block)).withColumn("s", F.sum("z").over(block.orderBy("i")))
    each = parts.groupBy(*by, "w", "g").agg(ratio(F.max("s") - F.min("s"), F.stddev_samp("y")).alias("rs"))
    each = each.groupBy(*by, "w").agg(F.when(F.count("rs") == F.count("*"), F.avg("rs")).alias("rs")).filter("rs > 0")
    x, y = F.log(F.col("w").cast("double")), F.log("rs")
    fit = each.groupBy(*by).agg(F.regr_slope(y, x).alias("hurst"), F.regr_syy(y, x).alias("syy"), F.regr_sxx(y, x).alias("sxx"), F.count("*").alias("k"))
    se = F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("syy") - F.col("hurst") ** 2 * F.col("sxx"), (F.col("k") - 2) * F.col("sxx"))))
    p = F.udf(lambda h, se, k: None if h is None or not se else 2 * t_sf(abs((h - 0.5) / se), k - 2), "double")  # one call a series
    return ship(fit).withColumn("se", se).select(*by, "hurst", p("hurst", "se", "k").alias("p_value"))


def stability(pairs: DataFrame, train: DataFrame, by: list[str], h: str, y_hat: str, y_prev: str, order: str, y: str, seasonality: int = 1) -> DataFrame:
    """by, macv, mach, mascv, masch, rmsscv, rmssch: how forecasts of two origins, or along the horizon, differ, plain
    and over the seasonal differences of the training series."""
    w = _w(by, h)
    rows = pairs.select(*by, F.abs(F.col(y_hat) - F.col(y_prev)).alias("v"), (F.col(y_hat) - F.lag(y_hat).over(w)).alias("dh"), (F.col(y_hat) - F.lead(y_prev).over(w)).alias("dv"))
    top = rows.groupBy(*by).agg(F.count("*").alias("h"), F.avg("v").alias("macv"), F.avg(F.abs("dh")).alias("mach"), *[f.alias(n) for n, f in (("ah", F.sum(F.abs("dh"))), ("av", F.sum(F.abs("dv"))), ("qh", F.sum(F.col("dh") ** 2)), ("qv", F.sum(F.col("dv") ** 2)))])
    d = F.col("y") - F.lag("y", seasonality).over(W.partitionBy(*by).orderBy("i"))
    base = _numbered(train, by, order, y).withColumn("d", d).filter("d is not null")
    cut = F.col("i") < F.col("n") - 1
    low = base.groupBy(*by).agg(F.count("*").alias("nh"), F.count_if(cut).alias("nv"), F.sum(F.abs("d")).alias("sh"), F.sum(F.when(cut, F.abs("d"))).alias("sv"), F.sum(F.col("d") ** 2).alias("th"), F.sum(F.when(cut, F.col("d") ** 2)).alias("tv"))
    both = top.join(low, by, "left")

    def scaled(num: str, scale: str, n: str) -> Column:
        den = (F.col("h") - 1) / F.when(F.col(n) > 0, F.col(n)) * F.col(scale)
        none = F.col(n).isNull() | (F.col(n) == 0)
        return F.when(F.col("h") > 1, F.when(none, F.lit(float("inf"))).when(den == 0, F.when(F.col(num) == 0, 0.0).otherwise(float("inf"))).otherwise(ratio(F.col(num), den)))

    return both.select(*by, "macv", "mach", scaled("av", "sv", "nv").alias("mascv"), scaled("ah", "sh", "nh").alias("masch"), F.sqrt(scaled("qv", "tv", "nv")).alias("rmsscv"), F.sqrt(scaled("qh", "th", "nh")).alias("rmssch"))


def wape(df: DataFrame, by: list[str], y: str, y_hat: str) -> DataFrame:
    """by, wape: sum of absolute errors over the sum of absolute values."""
    return df.groupBy(*by).agg(ratio(F.sum(F.abs(F.col(y) - F.col(y_hat))), F.sum(F.abs(y))).alias("wape"))

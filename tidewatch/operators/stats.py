"""Aggregates: dispersion, guarantees, comparability, resampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import keyed, ratio
from ..functions.ship import ship
from ..functions.special import NORMAL, t_ppf


def chebyshev_guaranteed_percentage(df: DataFrame, by: list[str], value: str, interval: tuple[float | None, float | None]) -> DataFrame:
    """by, guaranteed: share of values Chebyshev's inequality puts inside the interval (1 - 1/k^2, 0 for k <= 1)."""
    lo, hi = interval
    if lo is None and hi is None:
        raise ValueError("a bound is needed")
    df, by = keyed(df, by)
    stats = df.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    sides = [ratio(d, F.col("s")) for d in ([F.col("m") - lo] if lo is not None else []) + ([F.lit(hi) - F.col("m")] if hi is not None else [])]
    k = F.least(*sides) if len(sides) == 2 else sides[0]
    return stats.select(*by, F.when(k > 1, 1 - 1 / (k * k)).otherwise(0.0).alias("guaranteed"))


def assess_comparability(df: DataFrame, features: str | list[str], group_col: str = "group", treatment: str | list[str] = "treatment", control: str = "control") -> DataFrame:
    """group, feature, cohen_d of each treatment against the control, pooled by the mean of both sample variances."""
    features = [features] if isinstance(features, str) else list(features)
    treatments = [treatment] if isinstance(treatment, str) else list(treatment)
    missing = [c for c in [*features, group_col] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    long = df.filter(F.col(group_col).isin([*treatments, control])).select(F.col(group_col).alias("group"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("z"))
    stats = long.groupBy("group", F.col("z.feature").alias("feature")).agg(F.avg("z.x").alias("m"), F.var_samp("z.x").alias("v"))
    base = stats.filter(F.col("group") == control).select("feature", F.col("m").alias("cm"), F.col("v").alias("cv"))
    d = ratio(F.abs(F.col("m") - F.col("cm")), F.sqrt((F.col("v") + F.col("cv")) / 2))
    return stats.filter(F.col("group") != control).join(base, "feature").select("group", "feature", d.alias("cohen_d"))


def mean_interval(df: DataFrame, by: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """by, n, mean, lower, upper: t interval of the mean; no bounds below two values."""
    stats = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.udf(lambda n: None if n < 2 else t_ppf((1 + confidence) / 2, n - 1), "double")  # one call a group
    half = t("n") * F.col("sd") / F.sqrt("n")
    return ship(stats).select(*by, "n", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr for all pairs of columns, in one pass of sums; NULL beside a constant column."""
    n = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    full = df.filter(F.forall(F.array(*x), lambda v: v.isNotNull()))
    aggs = [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]
    cov = lambda i, j: F.col(f"c{min(i, j)}_{max(i, j)}")
    cells = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), ratio(cov(i, j), F.sqrt(cov(i, i) * cov(j, j))).alias("corr")) for i in range(n) for j in range(n)]
    return full.agg(*aggs).select(F.explode(F.array(*cells)).alias("z")).select("z.*")


def jackknife_mean(df: DataFrame, by: list[str], value: str, name: str = "jackknife") -> DataFrame:
    """Adds each row's leave-one-out mean, from the group's sum and count."""
    df, by = keyed(df, by)
    from pyspark.sql import Window as W

    w = W.partitionBy(*by)
    return df.withColumn(name, ratio(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1))


def jackknife(df: DataFrame, by: list[str], order: str, value: str, func: Callable[[np.ndarray], float]) -> DataFrame:
    """by, i, jackknife: leave-one-out values of any function of an array, a group a task."""

    def kernel(pdf):
        import pandas as pd

        x = pdf.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(x) for c in by}, "i": range(len(x)), "jackknife": [float(func(np.delete(x, k))) for k in range(len(x))]})

    keys = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in by)
    return ship(df).groupBy(*by).applyInPandas(kernel, f"{keys}, i long, jackknife double")


def acceleration(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, acceleration of the mean: sum d^3 / (6 (sum d^2)^1.5), d the jackknife values less their mean."""
    from pyspark.sql import Window as W

    df, by = keyed(df, by)
    rows = jackknife_mean(df, by, value, "_j").withColumn("_d", F.col("_j") - F.avg("_j").over(W.partitionBy(*by)))
    return rows.groupBy(*by).agg(ratio(F.sum(F.col("_d") ** 3), 6 * F.pow(F.sum(F.col("_d") ** 2), 1.5)).alias("acceleration"))


class BootstrapBCA:
    """Bias-corrected accelerated bootstrap intervals, a group a task; the seed fixes the resamples."""

    def compute_interval(self, df: DataFrame, by: list[str], value: str, confidence_level: float = 0.95, statistic: Callable[[np.ndarray], float] = np.mean, n_resamples: int = 1000, random_state: int = 42, order: str | None = None) -> DataFrame:
        df, by = keyed(df, by)

        def kernel(pdf):
            import pandas as pd

            x = pdf.sort_values(order or value)[value].dropna().to_numpy(float)
            rng = np.random.RandomState(random_state)
            boot = np.asarray([statistic(rng.choice(x, len(x), replace=True)) for _ in range(n_resamples)])
            left = np.asarray([statistic(np.delete(x, k)) for k in range(len(x))])
            d = left - left.mean()
            a = (d**3).sum() / (6 * (d**2).sum() ** 1.5) if (d**2).sum() > 0 else 0.0
            bias = float((boot < statistic(x)).mean())
            lo = hi = np.nan
            if 0 < bias < 1:
                z0 = NORMAL.inv_cdf(bias)
                ends = []
                for q in ((1 - confidence_level) / 2, (1 + confidence_level) / 2):
                    z = z0 + NORMAL.inv_cdf(q)
                    ends.append(float(np.quantile(boot, NORMAL.cdf(z0 + z / (1 - a * z)))))
                lo, hi = ends
            return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "lower": [lo], "upper": [hi]})

        keys = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in by)
        return ship(df).groupBy(*by).applyInPandas(kernel, f"{keys}, lower double, upper double")


def poisson_bootstrap(df: DataFrame, key: str, value: str, n_resamples: int = 200, seed: int = 42) -> DataFrame:
    """resample, mean: a distributed bootstrap of the mean, every row drawn Poisson(1) times in each resample. The draw
    is a hash of seed, resample and the row's ``key``, so that it does not depend on the partitioning."""
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "resample", F.col("key"))), 1, 13), 16, 10).cast("double")
    steps: Column = F.lit(0)
    total, p = 0.0, np.exp(-1)
    cuts = []
    for j in range(1, 9):
        total += p
        cuts.append(total)
        p /= j
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(n_resamples))).alias("resample"))
    rows = rows.withColumn("u", part / float(1 << 52))
    for c in cuts:
        steps = steps + F.when(F.col("u") >= c, 1).otherwise(0)
    return rows.groupBy("resample").agg(ratio(F.sum(F.col("x") * steps), F.sum(steps)).alias("mean"))

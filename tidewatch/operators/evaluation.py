"""The numbers behind calibration, confusion, conformal and power plots, as DataFrames."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import ratio
from ..functions.special import t_test_power, t_test_size
from .intervals import exact_quantiles

#: Shares of treatment in an allocation, and error rates of conformal sets.
SPLITS = (*(k / 100 for k in range(5, 50, 10)), 0.5, *(k / 100 for k in range(55, 100, 10)))
ALPHAS = (0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10, 0.05)


def reliability_curve(df: DataFrame, y: str, p: str, n_bins: int = 15) -> DataFrame:
    """bin, n, prob_true, prob_pred over quantile bins (the edge belongs to the lower bin); empty bins are left out."""
    if n_bins < 2:
        raise ValueError("n_bins is 2 or more")
    cuts = [float(c) for c in exact_quantiles(df, p, np.linspace(0, 1, n_bins + 1)[1:-1].tolist()) if c is not None]
    rows = df.withColumn("bin", F.size(F.filter(F.lit(cuts), lambda e: e < F.col(p))) if cuts else F.lit(0))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("prob_true"), F.avg(p).alias("prob_pred"))


def calibration_summary(df: DataFrame, y: str, p: str, n_bins: int = 15) -> DataFrame:
    """brier, mean_error, max_error."""
    gap = F.abs(F.col("prob_true") - F.col("prob_pred"))
    errors = reliability_curve(df, y, p, n_bins).agg(F.avg(gap).alias("mean_error"), F.max(gap).alias("max_error"))
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2.0)).alias("brier")).crossJoin(errors)


def score_distribution(df: DataFrame, p: str, nbins: int = 15) -> DataFrame:
    """bin, n: histogram over equal bins of the range of ``p``."""
    span = df.agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
    cell = F.coalesce(F.floor(ratio((F.col(p) - F.col("lo")) * nbins, F.col("hi") - F.col("lo"))), F.lit(0))
    return df.crossJoin(F.broadcast(span)).groupBy(F.least(F.lit(nbins - 1).cast("long"), cell).alias("bin")).agg(F.count("*").alias("n"))  # one row


def confusion_matrix(df: DataFrame, y: str, predicted: str, percentage_by_class: bool = True) -> DataFrame:
    """cell (FN, TN, TP, FP), n, percentage of its column ([FN, TP] and [TN, FP]) or of all."""
    t, q = F.col(y) == 1, F.col(predicted) == 1
    counts = df.agg(*[F.count_if(c).alias(k) for k, c in (("FN", t & ~q), ("TN", ~t & ~q), ("TP", t & q), ("FP", ~t & q))])
    left, right = F.col("FN") + F.col("TP"), F.col("TN") + F.col("FP")
    base = (lambda k: left if k in ("FN", "TP") else right) if percentage_by_class else (lambda k: left + right)
    cells = [F.struct(F.lit(k).alias("cell"), F.col(k).alias("n"), (ratio(F.col(k), base(k)) * 100).alias("percentage")) for k in ("FN", "TN", "TP", "FP")]
    return counts.select(F.explode(F.array(*cells)).alias("z")).select("z.*")


def efficiency_curve(df: DataFrame, alpha: str, prediction_set: str) -> DataFrame:
    """error_rate, efficiency (share of sets of one class), validity (mean set size), by error rate."""
    size = F.size(F.filter(prediction_set, lambda x: x))
    return df.groupBy(F.col(alpha).alias("error_rate")).agg(F.avg((size == 1).cast("double")).alias("efficiency"), F.avg(size.cast("double")).alias("validity"))


def beta_confidence_analysis(spark: SparkSession, alpha: float, beta: float, points: int = 1000) -> DataFrame:
    """x, pdf of a beta distribution over a grid of [0, 1]."""
    if alpha <= 0 or beta <= 0:
        raise ValueError("both parameters are positive")
    scale = math.lgamma(alpha + beta) - math.lgamma(alpha) - math.lgamma(beta)
    x = F.col("id") / (points - 1)
    inside = F.exp(F.lit(scale) + (alpha - 1) * F.log(F.when(F.col("x") > 0, F.col("x"))) + (beta - 1) * F.log(F.when(F.col("x") < 1, 1 - F.col("x"))))
    edge = lambda k: 0.0 if k > 1 else math.exp(scale) if k == 1 else math.inf
    return spark.range(points).select(x.alias("x")).withColumn("pdf", F.when(F.col("x") == 0, edge(alpha)).when(F.col("x") == 1, edge(beta)).otherwise(inside))


def _effect(d: float) -> str:
    return "very small" if d < 0.2 else "small" if d < 0.5 else "medium" if d < 0.8 else "large"


def power_curve(spark: SparkSession, effect_size: float, alpha: float = 0.05, power_target: float = 0.80) -> DataFrame:
    """n, power, n_required, effect for group sizes from 10 to 1.8 times the size that gives the target."""
    if effect_size <= 0 or not 0 < alpha < 1 or not 0 < power_target < 1:
        raise ValueError("effect_size is positive, alpha and power_target lie between 0 and 1")
    need = t_test_size(effect_size, power_target, alpha)
    rows = [(n, t_test_power(effect_size, n, n, alpha), math.ceil(need), _effect(effect_size)) for n in range(10, int(need * 1.8) + 1)]
    return spark.createDataFrame(rows, "n int, power double, n_required int, effect string")


def power_vs_allocation(spark: SparkSession, effect_size: float, sample_size: int, alpha: float = 0.05) -> DataFrame:
    """treatment_share, power for eleven splits of one sample; 0 with fewer than two controls."""
    if effect_size <= 0 or sample_size <= 0 or not 0 < alpha < 1:
        raise ValueError("effect_size and sample_size are positive, alpha lies between 0 and 1")
    rows = []
    for share in SPLITS:
        control = sample_size * (1 - share)
        rows.append((share, 0.0 if control < 2 else t_test_power(effect_size, control, sample_size * share, alpha)))
    return spark.createDataFrame(rows, "treatment_share double, power double")

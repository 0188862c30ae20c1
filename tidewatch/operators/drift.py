"""Drift detectors: categorical and continuous, per entity and time bucket, with thresholds fitted on a reference.

``scope="global"`` compares a bucket with all buckets before it in (entity, time) order, other entities included;
``scope="entity"`` stays within the entity, and scales by it. Only observed (entity, bucket) pairs are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import ratio
from ..sources import validate
from .intervals import interval

_LEFT = {"D": "day", "H": "hour", "MS": "month", "QS": "quarter", "YS": "year", "T": "minute", "MIN": "minute"}


def bucket(time: Column, freq: str) -> Column:
    """Label of the time bucket: W closes on Sunday, ME, QE and YE are the period's last day, others its start; a number
    before h, min or D makes longer buckets."""
    number = freq.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-")
    unit = freq[len(number) :].upper()
    n = int(number or 1)
    trunc = lambda u: F.date_trunc(u, time).cast("timestamp_ntz")
    if unit in ("W", "W-SUN") and n == 1:
        return trunc("week") + F.expr("INTERVAL 6 DAYS")
    if unit in ("ME", "M") and n == 1:
        return trunc("month") + F.expr("INTERVAL 1 MONTH") - F.expr("INTERVAL 1 DAY")
    if unit in ("QE", "Q") and n == 1:
        return trunc("quarter") + F.expr("INTERVAL 3 MONTHS") - F.expr("INTERVAL 1 DAY")
    if unit in ("YE", "Y", "A") and n == 1:
        return trunc("year") + F.expr("INTERVAL 1 YEAR") - F.expr("INTERVAL 1 DAY")
    if unit in _LEFT and n == 1:
        return trunc(_LEFT[unit])
    if unit in ("H", "MIN", "T", "D"):
        return F.window(time.cast("timestamp_ntz"), f"{n} {'hour' if unit == 'H' else 'day' if unit == 'D' else 'minute'}")["start"].cast("timestamp_ntz")
    raise ValueError(f"unknown frequency {freq!r}")


def chebyshev(p: Column, q: Column) -> Column:
    """Aggregate over categories: largest absolute difference."""
    return F.max(F.abs(p - q))


def psi(p: Column, q: Column, eps: float = 1e-4) -> Column:
    """Aggregate over categories: population stability index, probabilities clipped to [eps, 1]."""
    o, e = (F.least(F.greatest(x, F.lit(eps)), F.lit(1.0)) for x in (p, q))
    return F.sum((o - e) * F.log(o / e))


def jensenshannon(p: Column, q: Column) -> Column:
    """Aggregate over categories: square root of the Jensen-Shannon divergence (natural log) of p and q, which sum to 1."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log(x / F.when(m > 0, m))).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), F.sum(part(p) + part(q)) / 2))


METRICS = {"chebyshev": chebyshev, "psi": psi, "jensenshannon": jensenshannon}


def shares(counts: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """keys, x and ``w``: the share of ``n`` in its key's sum, times ``sign``. The sums are joined: a window would hold all
    rows of a key in one task."""
    sums = counts.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.sum("n").alias("_sum"))
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return counts.join(sums, on).select(*keys, "x", (sign * F.col("n") / F.col("_sum")).alias("w"))


def weights(rows: DataFrame, keys: list[str], value: str, sign: int = 1) -> DataFrame:
    """keys, x, w: a sample's distinct values, each with its share of the key's rows, times ``sign``."""
    return shares(rows.groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("n")), keys, sign)


def wasserstein(rows: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Wasserstein-1 distance per key of two samples given as signed weights that sum to 1 and to -1. A task holds the
    distinct values of a key; nulls keep their weight and have no place."""
    merged = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    steps = merged.select(*keys, F.sum("_w").over(w).alias("_f"), (F.lead(value).over(w) - F.col(value)).alias("_gap"))
    return steps.groupBy(*keys).agg(F.coalesce(F.sum(F.abs("_f") * F.col("_gap")), F.lit(0.0)).alias(name))


class _Drift:
    def __init__(self, freq: str | None, func: str, drift_limit="auto", method: str = "expanding", scope: str = "global"):
        if not freq:
            raise ValueError("a frequency is needed")
        if method not in ("expanding", "jackknife"):
            raise ValueError("method is expanding or jackknife")
        if scope not in ("global", "entity"):
            raise ValueError("scope is global or entity")
        self.freq, self.func, self.drift_limit, self.method, self.scope = freq, func, drift_limit, method, scope
        self.threshold_frame: DataFrame | None = None

    def _rows(self, df: DataFrame, id_col: str, time_col: str, target_col: str) -> DataFrame:
        validate.panel(df, id_col, time_col, target_col)
        rows = df.select(F.col(id_col).alias("id"), bucket(F.col(time_col), self.freq).alias("bucket"), F.col(target_col).alias("x"))
        return rows.filter("id is not null and bucket is not null")

    def _fit_thresholds(self, distances: DataFrame) -> None:
        self.distances = distances
        self.threshold_frame = interval(distances, ["id"], "metric", self.drift_limit).select("id", F.col("upper").alias("threshold"))

    @property
    def thresholds(self) -> dict:
        """Threshold by entity; one number each, collected."""
        if self.threshold_frame is None:
            raise ValueError("fit first")
        return {r["id"]: r["threshold"] for r in self.threshold_frame.collect()}

    def predict(self, df: DataFrame, id_col: str = "unique_id", time_col: str = "ds", target_col: str = "y") -> DataFrame:
        """score() and drift: whether the metric reaches the entity's threshold (false where there is none)."""
        rows = self.score(df, id_col, time_col, target_col)
        limits = self.threshold_frame.withColumnRenamed("id", "_id")
        flag = F.coalesce((F.col("metric") >= F.col("threshold")) & ~F.isnan("threshold"), F.lit(False))
        return rows.join(limits, F.col(id_col) == F.col("_id"), "left").select(*rows.columns, flag.alias("drift"))


class CatDrift(_Drift):
    """Drift of a category's distribution. ``compat``: reference shares are of all rows of the reference, as a whole, so
    an entity's sum to its own share; else they sum to 1 within the entity."""

    def __init__(self, freq: str | None = None, func: str = "chebyshev", drift_limit="auto", method: str = "expanding", scope: str = "global", compat: bool = True):
        if func not in METRICS:
            raise ValueError(f"func is one of {', '.join(METRICS)}")
        super().__init__(freq, func, drift_limit, method, scope)
        self.compat = compat

    def _counts(self, df: DataFrame, *cols: str) -> DataFrame:
        """Zero-filled counts n of (id, bucket, x): observed buckets by the domain of categories."""
        rows = self._rows(df, *cols).filter("x is not null").groupBy("id", "bucket", "x").agg(F.count("*").alias("n"))
        grid = rows.select("id", "bucket").distinct().crossJoin(rows.select("x").distinct())
        return grid.join(rows, ["id", "bucket", "x"], "left").select("id", "bucket", "x", F.coalesce("n", F.lit(0)).alias("n"))

    def _distance(self, rows: DataFrame, p: Column, q: Column) -> Column:
        return METRICS[self.func](p, q)

    def fit(self, df: DataFrame, id_col: str = "unique_id", time_col: str = "ds", target_col: str = "y") -> CatDrift:
        counts = self._counts(df, id_col, time_col, target_col)
        own = ["x"] if self.scope == "global" else ["id", "x"]
        w = W.partitionBy(*own).orderBy("id", "bucket")
        other = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)) if self.method == "expanding" else F.sum("n").over(W.partitionBy(*own)) - F.col("n")
        group = W.partitionBy("id", "bucket")
        rows = counts.withColumn("o", F.coalesce(other, F.lit(0))).withColumn("nt", F.sum("n").over(group)).withColumn("ot", F.sum("o").over(group))
        d = METRICS[self.func](ratio(F.col("n"), F.col("nt")), ratio(F.col("o"), F.col("ot")))
        self._fit_thresholds(rows.groupBy("id", "bucket").agg(F.when(F.max("ot") > 0, d).otherwise(0.0).alias("metric")))
        shares = counts.groupBy("id", "x").agg(F.sum("n").alias("n"))
        total = F.sum("n").over(W.partitionBy("id"))
        if self.compat:
            shares, total = shares.crossJoin(F.broadcast(shares.agg(F.sum("n").alias("total")))), F.col("total")  # one row
        self.reference = shares.select("id", "x", F.bround(F.col("n") / total, 4).alias("q"))
        return self

    def score(self, df: DataFrame, id_col: str = "unique_id", time_col: str = "ds", target_col: str = "y") -> DataFrame:
        """id, time (bucket), metric: each bucket against the entity's reference, over categories both have."""
        if self.threshold_frame is None:
            raise ValueError("fit first")
        group = W.partitionBy("id", "bucket")
        rows = self._counts(df, id_col, time_col, target_col).withColumn("p", ratio(F.col("n"), F.sum("n").over(group)))
        rows = rows.join(self.reference, ["id", "x"])
        if self.func == "jensenshannon":
            rows = rows.withColumn("p", ratio(F.col("p"), F.sum("p").over(group))).withColumn("q", ratio(F.col("q"), F.sum("q").over(group)))
        return rows.groupBy(F.col("id").alias(id_col), F.col("bucket").alias(time_col)).agg(METRICS[self.func](F.col("p"), F.col("q")).alias("metric"))


class ConDrift(_Drift):
    """Drift of a number's distribution by the Wasserstein distance. Nulls are left out."""

    def __init__(self, freq: str | None = None, func: str = "ws", drift_limit="auto", method: str = "expanding", scope: str = "global"):
        if func != "ws":
            raise ValueError("func is ws")
        super().__init__(freq, func, drift_limit, method, scope)

    def _values(self, df: DataFrame, *cols: str) -> DataFrame:
        return self._rows(df, *cols).select("id", "bucket", F.col("x").cast("double").alias("x")).filter("x is not null").groupBy("id", "bucket", "x").agg(F.count("*").alias("n"))

    def fit(self, df: DataFrame, id_col: str = "unique_id", time_col: str = "ds", target_col: str = "y") -> ConDrift:
        values = self._values(df, id_col, time_col, target_col)
        own = [] if self.scope == "global" else ["id"]
        periods = values.groupBy("id", "bucket").agg(F.sum("n").alias("size"))
        w = W.partitionBy(*own).orderBy("id", "bucket")
        periods = periods.withColumn("seq", F.row_number().over(w)).withColumn("before", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("total", F.sum("size").over(W.partitionBy(*own))).withColumn("last", F.count("*").over(W.partitionBy(*own)))
        rows = values.join(periods, ["id", "bucket"])
        # Every row meets the periods it is compared with by their numbers, an equi-join after an explode.
        others = F.expr("CASE WHEN seq < last THEN sequence(seq + 1, last) ELSE array() END") if self.method == "expanding" else F.expr("filter(sequence(1, last), s -> s <> seq)")
        past = rows.select(*own, "x", "n", F.explode(others).alias("seq"))
        goal = periods.select(F.col("id").alias("gid"), F.col("bucket").alias("gb"), *[F.col(c).alias(f"g_{c}") for c in own], F.col("seq").alias("gs"), "before", (F.col("total") - F.col("size")).alias("rest"))
        on = F.col("seq") == F.col("gs")
        for c in own:
            on = on & (F.col(c) == F.col(f"g_{c}"))
        size = F.col("before") if self.method == "expanding" else F.col("rest")
        past = past.join(goal, on).select(F.col("gid").alias("id"), F.col("gb").alias("bucket"), "x", (F.col("n") / size).alias("w"))
        now = rows.select("id", "bucket", "x", (-F.col("n") / F.col("size")).alias("w"))
        compared = periods.filter((F.col("before") if self.method == "expanding" else F.col("total") - F.col("size")) > 0).select("id", "bucket")
        d = wasserstein(past.unionByName(now), ["id", "bucket"], "x", "w", "metric").join(compared, ["id", "bucket"], "left_semi")
        rest = periods.select("id", "bucket").join(d, ["id", "bucket"], "left")
        self._fit_thresholds(rest.select("id", "bucket", F.coalesce("metric", F.lit(0.0)).alias("metric")))
        small = values.groupBy("id", F.col("x").cast("float").cast("double").alias("x")).agg(F.sum("n").alias("n"))
        self.reference = shares(small, ["id"])
        return self

    def score(self, df: DataFrame, id_col: str = "unique_id", time_col: str = "ds", target_col: str = "y") -> DataFrame:
        """id, time (bucket), metric: each bucket against the entity's reference sample (kept in single precision)."""
        if self.threshold_frame is None:
            raise ValueError("fit first")
        values = self._values(df, id_col, time_col, target_col)
        now = shares(values, ["id", "bucket"], -1)
        past = values.select("id", "bucket").distinct().join(self.reference, "id").select("id", "bucket", "x", "w")
        both = now.join(past.select("id").distinct(), "id", "left_semi").unionByName(past)
        return wasserstein(both, ["id", "bucket"], "x", "w", "metric").select(F.col("id").alias(id_col), F.col("bucket").alias(time_col), "metric")

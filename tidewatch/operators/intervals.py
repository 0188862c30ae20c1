"""Statistical intervals: an aggregate per group that gives a lower and an upper bound."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import keyed
from ..functions.ship import ship

NAMED = ("auto", "stddev", "mad", "iqr")


#: Up to so many rows a whole table's percentiles are one aggregate; beyond, ranks are found by refined histograms.
SMALL = 1_000_000
#: Up to so many edges a bin is found by compiled comparisons.
COMPILED = 64


def count_below(x: Column, edges: list[float], equal: bool = False) -> Column:
    """Number of sorted edges below x, or up to x if ``equal``; 0 for NULL. Up to COMPILED edges are nested comparisons,
    which are compiled, while a filter of an array calls its function for each edge of each row."""
    if len(edges) > COMPILED:
        return F.size(F.filter(F.lit([float(e) for e in edges]), (lambda e: e <= x) if equal else (lambda e: e < x)))

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= edges[mid] if equal else x > edges[mid], among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, len(edges))


def _cells(df: DataFrame, x: Column, spans: list[tuple[float, float]], bins: int) -> DataFrame:
    """x and ``c``: the number of the span that holds x, times ``bins``, plus the cell in it; NULL where none does. The spans
    are sorted and don't overlap."""
    rows = df.select(x.alias("x"), (count_below(x, [lo for lo, _ in spans], True) - 1).alias("k"))
    v, k = F.col("x"), F.col("k")
    lo, hi, width = (F.get(F.lit([float(e) for e in z]), k) for z in zip(*[(lo, hi, hi - lo) for lo, hi in spans]))
    share = (v - lo) / width
    if not all(math.isfinite(hi - lo) for lo, hi in spans):
        share = F.when(width < float("inf"), share).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
    return rows.select("x", F.when(v <= hi, k.cast("long") * bins + F.least(F.lit(bins - 1).cast("long"), F.floor(share * bins))).alias("c"))


def select_ranks(df: DataFrame, value: str, ranks: list[int], bins: int = 1024) -> dict[int, float]:
    """Exact values at 0-based ranks of a whole column, without sorting it: each round counts ``bins`` cells of the range
    that holds a rank, per cell with least and greatest value, and goes on inside the cell; a task returns counts only. NaN
    and infinity have no place in the range: ValueError."""
    x = F.col(value).cast("double")
    ends = df.filter(x.isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if ends["lo"] is not None and not (math.isfinite(ends["lo"]) and math.isfinite(ends["hi"])):
        raise ValueError(f"{value} holds values that are not finite")
    state = {r: (ends["lo"], ends["hi"], 0) for r in ranks}
    found = {r: lo for r, (lo, hi, _) in state.items() if lo == hi}
    while len(found) < len(ranks):
        spans = sorted({state[r][:2] for r in ranks if r not in found})  # cells of one round, so they don't overlap
        cells: list[list] = [[] for _ in spans]
        for c in _cells(df, x, spans, bins).groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():  # spans x bins rows at most
            if c["c"] is not None:
                cells[c["c"] // bins].append(c)
        for r in ranks:
            if r in found:
                continue
            lo, hi, below = state[r]
            for c in sorted(cells[spans.index((lo, hi))], key=lambda c: c["c"]):
                if r < below + c["n"]:
                    state[r] = (c["lo"], c["hi"], below)
                    if c["lo"] == c["hi"]:
                        found[r] = c["lo"]
                    break
                below += c["n"]
    return found


def exact_quantiles(df: DataFrame, value: str, qs: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles of a whole column."""
    n = df.filter(F.col(value).isNotNull()).count()
    if n <= SMALL:
        return list(df.agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(q)) for q in qs])).alias("q")).first()["q"] or [None] * len(qs))
    at = [q * (n - 1) for q in qs]
    held = select_ranks(df, value, sorted({int(a) for a in at} | {min(n - 1, int(a) + 1) for a in at}))
    return [held[int(a)] + (a - int(a)) * (held[min(n - 1, int(a) + 1)] - held[int(a)]) for a in at]


def whole_order_statistic(df: DataFrame, value: str, q: float, side: str) -> float | None:
    """order_statistic of a whole column, as a number."""
    n = df.filter(F.col(value).isNotNull()).count()
    if not n:
        return None
    rank = math.floor(q * (n - 1) + 1e-9) if side == "lower" else math.ceil(q * (n - 1) - 1e-9)
    return select_ranks(df, value, [rank])[rank]


def whole_bounds(df: DataFrame, columns: list[str], method="auto") -> dict[str, tuple[float | None, float | None]]:
    """interval() of several whole columns, as numbers: moments, quartiles and deviations of all of them in an aggregate
    each, while a column has at most SMALL values."""
    if not isinstance(method, str) or not columns:
        found = {c: interval(df, [], c, method).first() for c in columns}
        return {c: (b["lower"], b["upper"]) if b else (None, None) for c, b in found.items()}
    if method not in NAMED:
        raise ValueError(f"unknown interval method {method!r}")
    v = {c: F.col(c).cast("double") for c in columns}
    row = df.agg(*[a.alias(f"{k}{i}") for i, x in enumerate(v.values()) for k, a in (("n", F.count(x)), ("m", F.avg(x)), ("s", F.stddev_pop(x)), ("sk", F.skewness(x)), ("ku", F.kurtosis(x)))]).first()
    kinds = {c: method for c in columns}
    if method == "auto":
        numbers = lambda i: [F.lit(row[f"{k}{i}"]).cast("double") for k in ("m", "s", "sk", "ku")]
        made = df.sparkSession.range(1).select(*[_auto(*numbers(i)).alias(f"k{i}") for i in range(len(columns))]).first()
        kinds = {c: made[f"k{i}"] for i, c in enumerate(columns)}
    ranked = [c for c in columns if kinds[c] != "stddev" and row[f"n{columns.index(c)}"]]
    small = all(row[f"n{columns.index(c)}"] <= SMALL for c in ranked)
    q, mads = {}, {}
    if ranked and small:
        got = df.agg(*[F.percentile(v[c], F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias(f"q{i}") for i, c in enumerate(ranked)]).first()
        q = {c: got[f"q{i}"] for i, c in enumerate(ranked)}
        wide = [c for c in ranked if kinds[c] == "mad"]
        if wide:
            got = df.agg(*[F.percentile(F.abs(v[c] - q[c][1]), F.lit(0.5)).alias(f"d{i}") for i, c in enumerate(wide)]).first()
            mads = {c: got[f"d{i}"] for i, c in enumerate(wide)}
    else:
        for c in ranked:
            q[c] = exact_quantiles(df.select(v[c].alias(c)), c, [0.25, 0.5, 0.75])
            if kinds[c] == "mad":
                mads[c] = exact_quantiles(df.select(F.abs(v[c] - q[c][1]).alias(c)), c, [0.5])[0]
    out = {}
    for i, c in enumerate(columns):
        if not row[f"n{i}"]:
            out[c] = (None, None)
            continue
        centre, spread = (row[f"m{i}"], 3 * row[f"s{i}"]) if kinds[c] == "stddev" else (q[c][1], 3 * mads[c] if kinds[c] == "mad" else 1.5 * (q[c][2] - q[c][0]))
        out[c] = (centre - spread, centre + spread)
    return out


def order_statistic(df: DataFrame, by: list[str], value: str, q: float, side: str, name: str) -> DataFrame:
    """The value at 0-based rank floor or ceil of q (n - 1): numpy's ``lower`` and ``higher`` quantiles."""
    w = W.partitionBy(*by)
    at = F.lit(q) * (F.col("_n") - 1)
    rank = F.floor(at + 1e-9) if side == "lower" else F.ceil(at - 1e-9)
    rows = df.filter(F.col(value).isNotNull()).select(*by, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count("*").over(w).alias("_n"))
    return rows.filter(F.col("_r") - 1 == rank).groupBy(*by).agg(F.max(value).alias(name))


def mad(df: DataFrame, by: list[str], value: str, name: str = "mad") -> DataFrame:
    """Median of absolute deviations from the median, per group: one pass for either median."""
    df, by = keyed(df, by)
    centre = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("_med"))
    return df.select(*by, value).join(centre, by).groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("_med")), F.lit(0.5)).alias(name))


def _auto(mean: Column, sd: Column, skew: Column, kurt: Column) -> Column:
    cv = F.when(mean == 0, F.lit(float("inf"))).otherwise(sd / F.abs(F.when(mean != 0, mean)))
    normal = F.coalesce((F.abs(skew) <= 0.5) & (F.abs(kurt) <= 1), F.lit(False))
    odd = (cv > 1.5) | F.coalesce(skew > 0.5, F.lit(False))
    return F.when(normal, F.when(cv < 0.15, "stddev").when(cv < 0.30, "iqr").otherwise("mad")).otherwise(F.when(odd, "mad").otherwise("iqr"))


def interval(df: DataFrame, by: list[str], value: str, method="auto") -> DataFrame:
    """by, method, lower, upper per group.

    ``method``: "stddev" (mean +- 3 population deviations), "mad" (median +- 3 MAD), "iqr" (median +- 1.5 interquartile
    ranges), "auto" (one of these by skewness, kurtosis and variation), ("quantile", lo, hi), a pair of bounds, or a
    function from a numpy array to a pair, run once per group. None as a bound gives NULL.
    """
    if not by and (method in NAMED if isinstance(method, str) else isinstance(method, (tuple, list)) and len(method) == 3):
        return _whole(df.select(F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull()), value, method)
    df, by = keyed(df, by)
    df = df.select(*by, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    if callable(method):

        def kernel(pdf):
            import pandas as pd

            lo, hi = method(pdf[value].to_numpy())
            return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "method": ["custom"], "lower": [lo], "upper": [hi]})

        keys = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in by)
        return ship(df).groupBy(*by).applyInPandas(kernel, f"{keys}, method string, lower double, upper double")
    if isinstance(method, (tuple, list)):
        if len(method) == 3 and method[0] == "quantile":
            out = df.select(*by).distinct().withColumn("method", F.lit("quantile"))
            for q, side, name in ((method[1], "lower", "lower"), (method[2], "higher", "upper")):
                out = out.withColumn(name, F.lit(None).cast("double")) if q is None else out.join(order_statistic(df, by, value, q, side, name), by)
            return out
        if len(method) == 2:
            return df.select(*by).distinct().select(*by, F.lit("bounds").alias("method"), *[F.lit(b).cast("double").alias(n) for b, n in zip(method, ("lower", "upper"))])
    if method not in NAMED:
        raise ValueError(f"unknown interval method {method!r}")
    v = F.col(value)
    stats = df.groupBy(*by).agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.skewness(v).alias("sk"), F.kurtosis(v).alias("ku"), F.percentile(v, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias("q"))
    if method in ("auto", "mad"):
        stats = stats.join(mad(df, by, value), by)
    else:
        stats = stats.withColumn("mad", F.lit(None).cast("double"))
    kind = _auto(F.col("m"), F.col("s"), F.col("sk"), F.col("ku")) if method == "auto" else F.lit(method)
    centre = F.when(F.col("method") == "stddev", F.col("m")).otherwise(F.col("q")[1])
    spread = F.when(F.col("method") == "stddev", 3 * F.col("s")).when(F.col("method") == "mad", 3 * F.col("mad")).otherwise(1.5 * (F.col("q")[2] - F.col("q")[0]))
    return stats.withColumn("method", kind).select(*by, "method", (centre - spread).alias("lower"), (centre + spread).alias("upper"))


def _whole(df: DataFrame, value: str, method) -> DataFrame:
    """interval() of a whole column: a few numbers reach the driver, and no task holds the column."""
    spark, schema = df.sparkSession, "method string, lower double, upper double"
    if not isinstance(method, str):
        return spark.createDataFrame([("quantile", *[None if q is None else whole_order_statistic(df, value, q, s) for q, s in zip(method[1:], ("lower", "higher"))])], schema)
    v = F.col(value)
    row = df.agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.skewness(v).alias("sk"), F.kurtosis(v).alias("ku")).first()
    if row["m"] is None:
        return spark.createDataFrame([], schema)
    kind = method
    if method == "auto":
        kind = df.limit(1).select(_auto(*[F.lit(row[k]).cast("double") for k in ("m", "s", "sk", "ku")])).first()[0]
    if kind == "stddev":
        centre, spread = row["m"], 3 * row["s"]
    elif kind == "mad":
        centre = exact_quantiles(df, value, [0.5])[0]
        spread = 3 * exact_quantiles(df.select(F.abs(v - centre).alias(value)), value, [0.5])[0]
    else:
        lo, centre, hi = exact_quantiles(df, value, [0.25, 0.5, 0.75])
        spread = 1.5 * (hi - lo)
    return spark.createDataFrame([(kind, centre - spread, centre + spread)], schema)


def from_expressions(df: DataFrame, by: list[str], value: str, center: Callable[[Column], Column], spread: Callable[[Column], Column], factor: float = 3.0) -> DataFrame:
    """Interval center +- factor * spread of two aggregate expressions."""
    df, by = keyed(df, by)
    c, s = center(F.col(value)), spread(F.col(value))
    return df.groupBy(*by).agg((c - factor * s).alias("lower"), (c + factor * s).alias("upper"))

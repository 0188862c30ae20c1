"""Operators on ordered series: daily event values and monthly order totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics, series
from .base import DAILY, DAYS, MONTHS, R, T_TAILS, daily, monthly, query, table

BY = ["unique_id"]


def _sides(n: int):
    return f"max(CASE WHEN n - i <= {n} THEN y END)"


_SEASONS = {"daily": ("hour(ds)", 24), "weekly": ("(isodow(ds) - 1)", 7), "monthly": ("month(ds)", 12), "quarterly": ("quarter(ds)", 4), "yearly": ("dayofyear(ds)", 365)}


@query("SELECT event_id, " + ", ".join(R(f"{f}({e} * (2 * pi() / {p}))", f"{n}_{f}") for n, (e, p) in _SEASONS.items() for f in ("sin", "cos")) + " FROM (SELECT event_id, ts AS ds FROM events)")
def PRJ1_fourier_seasonality(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").alias("ds"))
    return series.fourier_seasonality(rows, "ds", list(_SEASONS)).drop("ds")


_GAPS = "g AS (SELECT unique_id, ds, CASE WHEN i < 4 OR unique_id = 'click' THEN 0.0 WHEN i > n - 6 AND unique_id = 'view' THEN 0.0 ELSE y END AS y FROM s)"


def _gaps(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("unique_id")
    rows = daily(spark, sf).withColumn("i", F.row_number().over(w.orderBy("ds")) - 1).withColumn("n", F.count("*").over(w))
    zero = (F.col("i") < 4) | (F.col("unique_id") == "click") | ((F.col("i") > F.col("n") - 6) & (F.col("unique_id") == "view"))
    return rows.select("unique_id", "ds", F.when(zero, 0.0).otherwise(F.col("y")).alias("y"))


@query(f"WITH {DAYS}, {_GAPS} SELECT unique_id, ds, {R('y', 'y')} FROM (SELECT *, bool_or(y <> 0) OVER (PARTITION BY unique_id ORDER BY ds) AS seen, bool_or(y <> 0) OVER (PARTITION BY unique_id) AS hit FROM g) WHERE seen OR NOT hit")
def PRJ2_remove_leading_zeros(spark, sf):
    return series.remove_leading_zeros(_gaps(spark, sf), BY, "ds", "y")


@query(f"WITH {DAYS}, {_GAPS} SELECT unique_id, bool_and(y = 0) AS obsolete FROM (SELECT *, max(ds) OVER (PARTITION BY unique_id) AS last FROM g) WHERE ds >= last - INTERVAL 3 DAY GROUP BY unique_id")
def PRJ3_is_obsolete(spark, sf):
    return series.is_obsolete(_gaps(spark, sf), BY, "ds", "y", 3)


@query(f"WITH {DAYS} SELECT unique_id, ds, {R('y', 'y')}, {R('y - lag(y, 7) OVER (PARTITION BY unique_id ORDER BY ds)', 'diff')} FROM s")
def PRJ4_seasonal_difference(spark, sf):
    return series.generate_lag(daily(spark, sf), BY, "ds", "y", 7)


@query(f"WITH {MONTHS}, r AS (SELECT unique_id, ds, ln(y / lag(y) OVER (PARTITION BY unique_id ORDER BY ds)) AS r FROM s) SELECT unique_id, ds, {R('(r - avg(r) OVER g) / stddev_pop(r) OVER g', 'returns')} FROM r WINDOW g AS (PARTITION BY unique_id)")
def PRJ5_standardize_returns(spark, sf):
    return series.standardize_returns(monthly(spark, sf), BY, "ds", "y").drop("y")


_PAIRS = "p AS (SELECT unique_id, i - (n - 12) AS h, y AS y_hat, lag(y) OVER (PARTITION BY unique_id ORDER BY i) AS y_prev FROM s QUALIFY i >= n - 12)"


def _numbered(spark, sf):
    return series._numbered(monthly(spark, sf), BY, "ds", "y")


def _pairs(spark, sf):
    from pyspark.sql import Window as W

    rows = _numbered(spark, sf).withColumn("y_prev", F.lag("y").over(W.partitionBy("unique_id").orderBy("i")))
    return rows.filter("i >= n - 12").select("unique_id", (F.col("i") - F.col("n") + 12).alias("h"), F.col("y").alias("y_hat"), "y_prev")


@query(f"WITH {MONTHS}, {_PAIRS} SELECT unique_id, h, {R('0.3 * y_prev + 0.7 * y_hat', 'vi')} FROM p")
def PRJ6_vertical_interpolation(spark, sf):
    rows = _pairs(spark, sf)
    return series.vi(rows.select("unique_id", "h", "y_hat"), rows.select("unique_id", "h", "y_prev"), ["unique_id", "h"], "y_hat", "y_prev", 0.3).select("unique_id", "h", "vi")


@query(f"WITH {MONTHS}, {_PAIRS} SELECT unique_id, h, {R('coalesce(0.3 * lag(y_hat) OVER (PARTITION BY unique_id ORDER BY h) + 0.7 * y_hat, y_hat)', 'hpi')} FROM p")
def PRJ7_horizontal_partial_interpolation(spark, sf):
    return series.hpi(_pairs(spark, sf), BY, "h", "y_hat", 0.3).select("unique_id", "h", "hpi")


@query(f"WITH RECURSIVE {MONTHS}, {_PAIRS}, f AS (SELECT unique_id, h, y_hat AS v FROM p WHERE h = 0 UNION ALL SELECT p.unique_id, p.h, 0.3 * f.v + 0.7 * p.y_hat FROM f JOIN p ON p.unique_id = f.unique_id AND p.h = f.h + 1) SELECT unique_id, h, {R('v', 'hfi')} FROM f")
def PRJ8_horizontal_full_interpolation(spark, sf):
    return series.hfi(_pairs(spark, sf), BY, "h", "y_hat", 0.3)


@query("SELECT n_nationkey AS s, r_regionkey AS h, floor(1.25 * greatest(n_nationkey, r_regionkey))::INTEGER AS length FROM nation, region")
def PRJ9_history_length(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s")).crossJoin(table(spark, sf, "region").select(F.col("r_regionkey").alias("h")))  # two tables of fixed size
    return rows.withColumn("length", F.floor(F.greatest("s", "h") * 1.25).cast("int"))


@query(f"""WITH {DAYS}, r AS (SELECT *, CASE WHEN i >= 4 THEN avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS 4 PRECEDING) END AS r FROM s)
SELECT unique_id, ds, {R('coalesce(r, max(CASE WHEN i = 4 THEN r END) OVER (PARTITION BY unique_id))', 'rolling')} FROM r""")
def WIN1_rolling_window(spark, sf):
    return series.rolling_window(daily(spark, sf), BY, "ds", "y", 5, F.avg).drop("y")


@query(f"""WITH {DAYS}, r AS (SELECT *, CASE WHEN i >= 2 THEN stddev_pop(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS UNBOUNDED PRECEDING) END AS r FROM s)
SELECT unique_id, ds, {R('coalesce(r, max(CASE WHEN i = 2 THEN r END) OVER (PARTITION BY unique_id))', 'expanding')} FROM r""")
def WIN2_expanding_window(spark, sf):
    return series.expanding_window(daily(spark, sf), BY, "ds", "y", F.stddev_pop, 3).drop("y")


@query(f"""WITH {DAYS}, a AS (SELECT *, list(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS 4 PRECEDING) AS a FROM s), m AS (SELECT *, list_median(a) AS m FROM a)
SELECT unique_id, ds, i >= 4 AND abs(y - m) > 2 * 1.4826 * list_median(list_transform(a, lambda x: abs(x - m))) AS outlier FROM m""")
def WIN3_hampel_filter(spark, sf):
    return series.hampel_filter(daily(spark, sf), BY, "ds", "y", 5, 2.0).drop("y")


@query(f"""WITH {DAYS}, r AS (SELECT *, CASE WHEN i >= 6 THEN avg(y) OVER g END AS c0, CASE WHEN i >= 6 THEN stddev_pop(y) OVER g END AS s0 FROM s WINDOW g AS (PARTITION BY unique_id ORDER BY ds ROWS 6 PRECEDING)),
f AS (SELECT *, coalesce(c0, max(CASE WHEN i = 6 THEN c0 END) OVER (PARTITION BY unique_id)) AS c, coalesce(s0, max(CASE WHEN i = 6 THEN s0 END) OVER (PARTITION BY unique_id)) AS d FROM r)
SELECT unique_id, ds, y < c - 1.5 * d OR y > c + 1.5 * d AS outlier FROM f""")
def WIN4_bollinger_bands(spark, sf):
    return series.bollinger_bands(daily(spark, sf), BY, "ds", "y", 7, factor=1.5).drop("y")


_UP, _DOWN = "CASE WHEN d > 0 THEN d ELSE 0 END", "CASE WHEN d < 0 THEN -d ELSE 0 END"


@query(f"""WITH RECURSIVE {DAYS}, e AS (SELECT unique_id, i, y - lag(y) OVER (PARTITION BY unique_id ORDER BY i) AS d FROM s),
seed AS (SELECT unique_id, sum({_UP}) / 5 AS up, sum({_DOWN}) / 5 AS down FROM e WHERE i BETWEEN 1 AND 6 GROUP BY 1),
f AS (SELECT unique_id, 4::BIGINT AS i, up, down FROM seed UNION ALL SELECT e.unique_id, e.i, (f.up * 4 + {_UP}) / 5, (f.down * 4 + {_DOWN}) / 5 FROM f JOIN e ON e.unique_id = f.unique_id AND e.i = f.i + 1),
x AS (SELECT unique_id, i, CASE WHEN down = 0 THEN 0 ELSE 100 - 100 / (1 + up / down) END AS r FROM f)
SELECT s.unique_id, s.ds, {R('coalesce(x.r, z.r)', 'rsi')} FROM s LEFT JOIN x USING (unique_id, i) JOIN x z ON z.unique_id = s.unique_id AND z.i = 4""")
def WIN5_rsi(spark, sf):
    return series.rsi(daily(spark, sf), BY, "ds", "y", 5)


@query("SELECT l_returnflag AS unique_id, " + R("count(*) / count(*) FILTER (l_discount <> 0)::DOUBLE", "adi") + ", " + R("power(stddev_samp(l_discount) / avg(l_discount), 2)", "cv2") + " FROM lineitem GROUP BY 1")
def AGG12_adi_cv(spark, sf):
    return series.adi_cv(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "unique_id"), BY, "l_discount")


@query(f"WITH {DAYS} SELECT unique_id, {R('regr_r2(y, i)', 'r2')} FROM s GROUP BY 1")
def AGG13_trend_r2(spark, sf):
    return series.trend_significance(daily(spark, sf), BY, "ds", "y").select("unique_id", "r2")


@query(f"""WITH {DAYS}, f AS (SELECT unique_id, regr_r2(y, i) AS r2, count(*) - 2 AS nu FROM s GROUP BY 1), t AS (SELECT unique_id, r2, nu, sqrt(r2 * nu / (1 - r2)) AS t FROM f)
SELECT unique_id, {R('r2', 'r2')}, {R(T_TAILS, 'p_value')} FROM t""")
def AGG13_trend_significance(spark, sf):
    return series.trend_significance(daily(spark, sf), BY, "ds", "y")


@query(f"""WITH {MONTHS}, z AS (SELECT unique_id, i, n, y - avg(y) OVER (PARTITION BY unique_id) AS z FROM s),
k AS (SELECT unique_id, k, n, power(sum(z * cos(2 * pi() * k * i / n)), 2) + power(sum(z * sin(2 * pi() * k * i / n)), 2) AS p FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM z) GROUP BY ALL),
q AS (SELECT unique_id, CASE WHEN k = 0 OR 2 * k = n THEN p ELSE 2 * p END AS p FROM k),
w AS (SELECT unique_id, p / sum(p) OVER (PARTITION BY unique_id) AS p, count(*) OVER (PARTITION BY unique_id) AS c FROM q)
SELECT unique_id, {R('1 + sum(p * log2(p + 1e-12)) / log2(max(c))', 'omega')} FROM w GROUP BY 1""")
def TS1_foreca(spark, sf):
    return series.foreca(monthly(spark, sf), BY, "ds", "y")


@query(f"""WITH {MONTHS}, t AS (SELECT unique_id, i, n, y, lead(y) OVER g AS y1, lead(y, 2) OVER g AS y2, 0.2 * stddev_pop(y) OVER (PARTITION BY unique_id) AS tol FROM s WINDOW g AS (PARTITION BY unique_id ORDER BY i)),
c AS (SELECT a.unique_id, count(*) AS b, count(*) FILTER (abs(a.y2 - b.y2) < a.tol AND b.i < b.n - 3) AS a FROM t a JOIN t b ON a.unique_id = b.unique_id AND a.i < b.i AND b.i < b.n - 2 AND abs(a.y - b.y) < a.tol AND abs(a.y1 - b.y1) < a.tol GROUP BY 1)
SELECT unique_id, {R('-ln(a / b::DOUBLE)', 'sampen')}, {R('a / b::DOUBLE', 'regularity')} FROM (SELECT unique_id, nullif(a, 0) AS a, nullif(b, 0) AS b FROM (SELECT DISTINCT unique_id FROM s) LEFT JOIN c USING (unique_id))""")
def TS2_sample_entropy(spark, sf):
    return series.sample_entropy(monthly(spark, sf), BY, "ds", "y", m=2)


_PATTERN = "o AS (SELECT unique_id, i, list_transform(list_sort([{'v': y, 'k': 0}, {'v': lead(y) OVER g, 'k': 1}, {'v': lead(y, 2) OVER g, 'k': 2}]), lambda x: x.k)::VARCHAR AS p FROM s WINDOW g AS (PARTITION BY unique_id ORDER BY i) QUALIFY i < n - 2)"


@query(f"WITH {MONTHS}, {_PATTERN}, q AS (SELECT unique_id, count(*) / sum(count(*)) OVER (PARTITION BY unique_id)::DOUBLE AS q FROM o GROUP BY unique_id, p) SELECT unique_id, {R('-sum(q * log2(q)) / log2(6)', 'entropy')}, {R('1 + sum(q * log2(q)) / log2(6)', 'limit')} FROM q GROUP BY 1")
def TS4_permutation_entropy(spark, sf):
    return series.permutation_entropy(monthly(spark, sf), BY, "ds", "y")


def _pami_sql(taus: str, normal: bool) -> str:
    value = "coalesce(i / nullif(least(hp, hz), 0), 0)" if normal else "i"
    return f"""{_PATTERN}, t AS (SELECT a.unique_id, t.tau, a.p, b.p AS z FROM o a JOIN (SELECT unnest({taus}) AS tau) t ON true JOIN o b ON b.unique_id = a.unique_id AND b.i = a.i + t.tau),
    j AS (SELECT unique_id, tau, p, z, count(*) AS c FROM t GROUP BY ALL),
    w AS (SELECT *, c / sum(c) OVER (PARTITION BY unique_id, tau)::DOUBLE AS q, sum(c) OVER (PARTITION BY unique_id, tau, p) / sum(c) OVER (PARTITION BY unique_id, tau)::DOUBLE AS qp, sum(c) OVER (PARTITION BY unique_id, tau, z) / sum(c) OVER (PARTITION BY unique_id, tau)::DOUBLE AS qz FROM j),
    m AS (SELECT unique_id, tau, {value} AS v FROM (SELECT unique_id, tau, sum(q * log2(q / (qp * qz))) AS i, -sum(q * log2(qp)) AS hp, -sum(q * log2(qz)) AS hz FROM w GROUP BY ALL))"""


@query(f"WITH {MONTHS}, {_pami_sql('[1, 2, 6]', True)} SELECT unique_id, tau::INTEGER AS tau, {R('v', 'pami')} FROM m")
def TS6_pami(spark, sf):
    return series.pami(monthly(spark, sf), BY, "ds", "y", [1, 2, 6], normalize=True)


@query(f"WITH {MONTHS}, {_pami_sql('range(1, 13)', False)} SELECT unique_id, tau::INTEGER AS tau, {R('v', 'pami')}, coalesce(round(v, 9) < round(lag(v) OVER g, 9) AND round(v, 9) < round(lead(v) OVER g, 9), false) AS minimum FROM m WINDOW g AS (PARTITION BY unique_id ORDER BY tau)")
def PL5_pami_minima(spark, sf):
    return series.pami_minima(monthly(spark, sf), BY, "ds", "y", 12)


def _hurst(source: str) -> str:
    """Rescaled ranges rs by series and window w."""
    return f"""{source}, d AS (SELECT unique_id, y - lag(y) OVER (PARTITION BY unique_id ORDER BY i) AS y, i - 1 AS i, n - 1 AS size FROM s WHERE n >= 30),
e AS (SELECT *, unnest(list_transform(range(1, 1 + floor(log2(size))::BIGINT), lambda k: (2 ** k)::BIGINT)) AS w FROM d WHERE y IS NOT NULL),
g AS (SELECT unique_id, w, i, i // w AS g, y FROM e WHERE (i // w + 1) * w <= size),
z AS (SELECT unique_id, w, g, i, y, y - avg(y) OVER (PARTITION BY unique_id, w, g) AS z FROM g),
c AS (SELECT unique_id, w, g, y, sum(z) OVER (PARTITION BY unique_id, w, g ORDER BY i) AS c FROM z),
r AS (SELECT unique_id, w, (max(c) - min(c)) / nullif(stddev_samp(y), 0) AS rs FROM c GROUP BY unique_id, w, g),
a AS (SELECT unique_id, w, avg(rs) AS rs FROM r GROUP BY ALL HAVING count(rs) = count(*) AND avg(rs) > 0)"""


@query(f"""WITH {_hurst(MONTHS)}
SELECT unique_id, {R('regr_slope(ln(rs), ln(w))', 'hurst')} FROM a GROUP BY 1""")
def TS7_hurst(spark, sf):
    return series.hurst_exponent(monthly(spark, sf), BY, "ds", "y").select("unique_id", "hurst")


@query(f"""WITH {_hurst(DAYS)}, f AS (SELECT unique_id, regr_slope(ln(rs), ln(w)) AS h, regr_syy(ln(rs), ln(w)) AS syy, regr_sxx(ln(rs), ln(w)) AS sxx, count(*) - 2 AS nu FROM a GROUP BY 1),
t AS (SELECT unique_id, h, nu, abs(h - 0.5) / nullif(sqrt(greatest(0.0, (syy - h * h * sxx) / nullif(nu * sxx, 0))), 0) AS t FROM f)
SELECT unique_id, {R('h', 'hurst')}, {R(T_TAILS, 'p_value')} FROM t""")
def TS7_hurst_significance(spark, sf):
    return series.hurst_exponent(daily(spark, sf), BY, "ds", "y")


@query(f"WITH {DAYS}, f AS (SELECT unique_id, regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM s GROUP BY 1) SELECT unique_id, i, {R('y - a - b * i', 'y')}, n FROM s JOIN f USING (unique_id)")
def TS8_detrend(spark, sf):
    return series.detrend(daily(spark, sf), BY, "ds", "y")


_D = "y - lag(y, 12) OVER (PARTITION BY unique_id ORDER BY i)"


@query(f"""WITH {MONTHS}, {_PAIRS}, r AS (SELECT unique_id, h, abs(y_hat - y_prev) AS v, y_hat - lag(y_hat) OVER g AS dh, y_hat - lead(y_prev) OVER g AS dv FROM p WINDOW g AS (PARTITION BY unique_id ORDER BY h)),
t AS (SELECT unique_id, count(*) AS h, avg(v) AS macv, avg(abs(dh)) AS mach, sum(abs(dh)) AS ah, sum(abs(dv)) AS av, sum(dh * dh) AS qh, sum(dv * dv) AS qv FROM r GROUP BY 1),
u AS (SELECT unique_id, y, row_number() OVER (PARTITION BY unique_id ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM s WHERE i < n - 12),
b AS (SELECT *, {_D} AS d FROM u QUALIFY d IS NOT NULL),
l AS (SELECT unique_id, count(*) AS nh, count(*) FILTER (i < n - 1) AS nv, sum(abs(d)) AS sh, sum(abs(d)) FILTER (i < n - 1) AS sv, sum(d * d) AS th, sum(d * d) FILTER (i < n - 1) AS tv FROM b GROUP BY 1)
SELECT unique_id, {R('macv', 'macv')}, {R('mach', 'mach')}, {R('av / ((h - 1) / nv::DOUBLE * sv)', 'mascv')}, {R('ah / ((h - 1) / nh::DOUBLE * sh)', 'masch')}, {R('sqrt(qv / ((h - 1) / nv::DOUBLE * tv))', 'rmsscv')}, {R('sqrt(qh / ((h - 1) / nh::DOUBLE * th))', 'rmssch')} FROM t JOIN l USING (unique_id)""")
def ST1_to_6_stability(spark, sf):
    train = _numbered(spark, sf).filter("i < n - 12").select("unique_id", "i", "y")
    return series.stability(_pairs(spark, sf), train, BY, "h", "y_hat", "y_prev", "i", "y", 12)


@query(f"WITH {MONTHS}, {_PAIRS} SELECT unique_id, {R('sum(abs(y_hat - y_prev)) / sum(abs(y_hat))', 'wape')} FROM p GROUP BY 1")
def EX_wape(spark, sf):
    return series.wape(_pairs(spark, sf), BY, "y_hat", "y_prev")


_ACF = f"{DAILY}, s AS (SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY unique_id) AS n, y - avg(y) OVER (PARTITION BY unique_id) AS z FROM daily), a AS (SELECT s.unique_id, l.lag, max(s.n) AS n, coalesce(sum(s.z * b.z), 0) / max(v.v) AS acf FROM s JOIN (SELECT unnest(range(0, 11)) AS lag) l ON true LEFT JOIN s b ON b.unique_id = s.unique_id AND b.i = s.i - l.lag JOIN (SELECT unique_id, sum(z * z) AS v FROM s GROUP BY 1) v ON v.unique_id = s.unique_id GROUP BY ALL)"


@query(f"WITH {_ACF} SELECT unique_id, lag::INTEGER AS lag, {R('acf', 'acf')}, {R('1.96 / sqrt(n)', 'band')}, n FROM a WHERE lag < n")
def PL3_acf(spark, sf):
    return diagnostics.acf(daily(spark, sf), BY, "ds", "y", 10)


@query(f"WITH {_ACF} SELECT unique_id, {R('max(n) * (max(n) + 2) * sum(acf * acf / (n - lag))', 'lb_stat')} FROM a WHERE lag >= 1 AND lag <= greatest(1, n // 5) GROUP BY 1")
def PL4_ljung_box(spark, sf):
    return diagnostics.ljung_box(daily(spark, sf), BY, "ds", "y", 10).select("unique_id", "lb_stat")


@query()
def PL3_stationarity(spark, sf):
    return diagnostics.stationarity(monthly(spark, sf), BY, "ds", "y", 12)


@query()
def PL4_residual_analysis(spark, sf):
    return diagnostics.residual_analysis(monthly(spark, sf), BY, "ds", "y")


#: Standard normal distribution function of x, as a series, and its inverse at u by Newton's method.
_PHI = "(0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(80), lambda k: power(x, 2 * k + 1) * exp(k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))))"
_PPF = f"list_reduce(list_prepend(ln(u / (1 - u)) / 1.702, list_transform(range(9), lambda q: 0.0::DOUBLE)), lambda x, q: x - ({_PHI} - u) * sqrt(2 * pi()) * exp(x * x / 2))"


@query(f"""WITH {DAYS}, r AS (SELECT unique_id, y, n, row_number() OVER (PARTITION BY unique_id ORDER BY y) AS rank FROM s),
m AS (SELECT unique_id, y, rank, CASE WHEN rank = n THEN power(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - power(0.5, 1.0 / n) ELSE (rank - 0.3175) / (n + 0.365) END::DOUBLE AS u FROM r)
SELECT unique_id, rank::INTEGER AS rank, {R(_PPF, 'theoretical')}, {R('y', 'sample')} FROM m""")
def PL4_qq(spark, sf):
    return diagnostics.qq(daily(spark, sf), BY, "y")


@query()
def PL2_seasonal_decompose(spark, sf):
    return diagnostics.seasonal_decompose(monthly(spark, sf), BY, "ds", "y", [12]).withColumn("seasonal", F.array_join(F.transform("seasonal", lambda x: F.round(x, 4).cast("string")), ","))


@query()
def PL2_decomposition_summary(spark, sf):
    return diagnostics.decomposition_summary(monthly(spark, sf), BY, "ds", "y", [12])

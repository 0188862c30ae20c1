"""Intervals, statistics, outliers, modelling, baskets and evaluation on the relational tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluation, intervals, modelling, outlier, stats
from ..operators.basket import TransactionAnalyzer, TransactionEncoder
from ..sources import validate
from .base import R, T_TAILS, interval_sql, query, scratch, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(method: str, source: str = "orders", by: str = "o_orderpriority", value: str = "o_totalprice") -> str:
    return f"SELECT {by}, method, {R('lower', 'lower')}, {R('upper', 'upper')} FROM ({interval_sql(source, by, value, method)})"


def _interval(spark, sf, method, name="orders", by="o_orderpriority", value="o_totalprice"):
    return intervals.interval(table(spark, sf, name), [by], value, method)


@query(_rounded("stddev"))
def AGG1_stddev_interval(spark, sf):
    return _interval(spark, sf, "stddev")


@query(_rounded("mad"))
def AGG2_mad_interval(spark, sf):
    return _interval(spark, sf, "mad")


@query(_rounded("iqr"))
def AGG3_iqr_interval(spark, sf):
    return _interval(spark, sf, "iqr")


_RANKED = "SELECT event_type AS k, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events"


@query(f"SELECT k AS event_type, 'quantile' AS method, {R('max(value) FILTER (r = floor(0.05 * (n - 1) + 1e-9))', 'lower')}, {R('max(value) FILTER (r = ceil(0.95 * (n - 1) - 1e-9))', 'upper')} FROM ({_RANKED}) GROUP BY k")
def AGG4_quantile_interval(spark, sf):
    return _interval(spark, sf, ("quantile", 0.05, 0.95), "events", "event_type", "value")


@query(_rounded("auto", "events", "event_type", "value"))
def AGG5_auto_interval(spark, sf):
    return _interval(spark, sf, "auto", "events", "event_type", "value")


@query(f"SELECT o_orderstatus, {R('median(o_totalprice) - 2 * stddev_pop(o_totalprice)', 'lower')}, {R('median(o_totalprice) + 2 * stddev_pop(o_totalprice)', 'upper')} FROM orders GROUP BY 1")
def AGG6_expression_interval(spark, sf):
    return intervals.from_expressions(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", lambda x: F.percentile(x, F.lit(0.5)), F.stddev_pop, 2.0)


@query(f"SELECT o_orderstatus, 'custom' AS method, {R('min(o_totalprice)', 'lower')}, {R('avg(o_totalprice)', 'upper')} FROM orders GROUP BY 1")
def AGG7_custom_interval(spark, sf):
    return _interval(spark, sf, lambda x: (float(x.min()), float(x.mean())), by="o_orderstatus")


@query("SELECT DISTINCT o_orderstatus, 'bounds' AS method, 10.0::DOUBLE AS lower, NULL::DOUBLE AS upper FROM orders")
def AGG8_fixed_bounds(spark, sf):
    return _interval(spark, sf, (10.0, None), by="o_orderstatus")


@query(f"SELECT event_type, {R('mad(value)', 'mad')} FROM events GROUP BY 1")
def AGG9_mad(spark, sf):
    return intervals.mad(table(spark, sf, "events"), ["event_type"], "value")


@query(f"SELECT c_mktsegment, {R('CASE WHEN k > 1 THEN 1 - 1 / (k * k) ELSE 0 END', 'guaranteed')} FROM (SELECT c_mktsegment, least((avg(c_acctbal) + 3000) / stddev_samp(c_acctbal), (15000 - avg(c_acctbal)) / stddev_samp(c_acctbal)) AS k FROM customer GROUP BY 1)")
def AGG10_chebyshev_guarantee(spark, sf):
    return stats.chebyshev_guaranteed_percentage(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", (-3000.0, 15000.0))


@query(f"""WITH s AS (SELECT c_mktsegment AS g, feature, avg(x) AS m, var_samp(x) AS v FROM (SELECT c_mktsegment, 'c_acctbal' AS feature, c_acctbal AS x FROM customer UNION ALL SELECT c_mktsegment, 'c_nationkey', c_nationkey FROM customer) GROUP BY ALL)
SELECT a.g AS "group", a.feature, {R('abs(a.m - b.m) / sqrt((a.v + b.v) / 2)', 'cohen_d')} FROM s a JOIN s b USING (feature) WHERE b.g = 'BUILDING' AND a.g IN ('MACHINERY', 'AUTOMOBILE')""")
def AGG11_assess_comparability(spark, sf):
    return stats.assess_comparability(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment", ["MACHINERY", "AUTOMOBILE"], "BUILDING")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})', 'corr')} FROM lineitem" for a in LINE for b in LINE))
def PL1_correlation(spark, sf):
    return stats.correlation(table(spark, sf, "lineitem"), LINE)


#: Student's t at 97.5 %: an expansion in 1 / nu, then steps of Newton's method.
_T975 = "1.959963984540054 + 2.372271230298562 / nu + 2.8224986157396112 / (nu * nu) + 2.555849679507722 / power(nu, 3) + 1.5895340533938225 / power(nu, 4)"
_NEWTON = f"t + (({T_TAILS}) - 0.05) / (2 * exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0)) / sqrt(nu * pi()) * power(1 + t * t / nu, -(nu + 1) / 2.0))"


@query(f"""WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd, (count(*) - 1)::DOUBLE AS nu FROM customer GROUP BY 1),
t0 AS (SELECT *, {_T975} AS t FROM g), t1 AS (SELECT * REPLACE ({_NEWTON} AS t) FROM t0), t2 AS (SELECT * REPLACE ({_NEWTON} AS t) FROM t1)
SELECT c_mktsegment, n, {R('m', 'mean')}, {R('m - t * sd / sqrt(n)', 'lower')}, {R('m + t * sd / sqrt(n)', 'upper')} FROM t2""")
def PL6_forest_interval(spark, sf):
    return stats.mean_interval(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal")


@query(f"SELECT c_mktsegment, count(*) AS n, {R('avg(c_acctbal)', 'mean')} FROM customer GROUP BY 1")
def JN1_group_means(spark, sf):
    return stats.mean_interval(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal").select("c_mktsegment", "n", "mean")


@query(f"SELECT c_custkey, {R('(sum(c_acctbal) OVER g - c_acctbal) / (count(*) OVER g - 1)', 'jackknife')} FROM customer WINDOW g AS (PARTITION BY c_mktsegment)")
def AGG26_jackknife_mean(spark, sf):
    return stats.jackknife_mean(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal").select("c_custkey", "jackknife")


@query(f"""WITH j AS (SELECT c_mktsegment AS k, (sum(c_acctbal) OVER g - c_acctbal) / (count(*) OVER g - 1) AS j FROM customer WINDOW g AS (PARTITION BY c_mktsegment)), d AS (SELECT k, j - avg(j) OVER (PARTITION BY k) AS d FROM j)
SELECT k AS c_mktsegment, {R('sum(d * d * d) / (6 * power(sum(d * d), 1.5))', 'acceleration')} FROM d GROUP BY 1""")
def AGG24_acceleration(spark, sf):
    return stats.acceleration(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal")


@query(f"""WITH x AS (SELECT s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier)
SELECT a.s_nationkey, a.i, {R('median(b.s_acctbal)', 'jackknife')} FROM x a LEFT JOIN x b ON a.s_nationkey = b.s_nationkey AND a.i <> b.i GROUP BY ALL""")
def AGG26_jackknife_median(spark, sf):
    return stats.jackknife(table(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal", np.median)


@query()
def AGG23_bootstrap_bca(spark, sf):
    return stats.BootstrapBCA().compute_interval(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", 0.95, np.mean, 500, 42, "c_custkey")


@query(f"""WITH d AS (SELECT resample, c_acctbal AS x, ('0x' || substr(md5('42:' || resample || ':' || c_custkey), 1, 13))::BIGINT / 4503599627370496 AS u FROM customer, (SELECT unnest(range(1, 51)) AS resample)),
n AS (SELECT resample, x, len(list_filter(range(8), lambda j: u >= list_sum(list_transform(range(j + 1), lambda i: exp(-1) / gamma(i + 1))))) AS n FROM d)
SELECT resample::INTEGER AS resample, {R('sum(x * n) / sum(n)', 'mean')} FROM n GROUP BY 1""")
def AGG25_poisson_bootstrap(spark, sf):
    return stats.poisson_bootstrap(table(spark, sf, "customer"), "c_custkey", "c_acctbal", 50)


# Outliers ---------------------------------------------------------------------------------------------------------

_BINS = 10


def _features(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE, "l_returnflag")


def _edges(c: str, n: int = _BINS, lo: str | None = None, hi: str | None = None) -> str:
    lo, hi = lo or f"(SELECT min({c}) FROM lineitem)", hi or f"(SELECT max({c}) FROM lineitem)"
    return f"list_append(list_transform(range({n}), lambda k: lo + k * ((hi - lo) / {n})), hi) FROM (SELECT {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi)"


def _hbos_sql(dynamic: bool = False) -> str:
    ctes, parts = [], []
    for c in LINE:
        cuts = ", ".join(repr(float(q)) for q in np.linspace(0, 1, _BINS + 1))
        ctes.append(f"e_{c} AS (SELECT list_sort(list_distinct(quantile_cont({c}, [{cuts}]))) AS e FROM lineitem)" if dynamic else f"e_{c} AS (SELECT {_edges(c)})".replace("hi) FROM", "hi) AS e FROM", 1))
        ctes.append(f"h_{c} AS (SELECT list(coalesce(c.n, 0) / ((SELECT count(*) FROM lineitem) * (e[b + 2] - e[b + 1])) ORDER BY b) AS d FROM (SELECT e, unnest(range(len(e) - 1)) AS b FROM e_{c}) LEFT JOIN (SELECT least(len(list_filter((SELECT e FROM e_{c}), lambda x: x <= {c})) - 1, (SELECT len(e) - 2 FROM e_{c})) AS b, count(*) AS n FROM lineitem GROUP BY 1) c USING (b))")
        parts.append(f"-ln((SELECT d FROM h_{c})[1 + greatest(0, least(len(list_filter((SELECT e FROM e_{c}), lambda x: x < {c})) - 1, (SELECT len(e) - 2 FROM e_{c})))] + 1e-9)")
    ctes.append("f AS (SELECT l_returnflag, (count(*) + 1) / (SELECT count(*) + count(DISTINCT l_returnflag) FROM lineitem)::DOUBLE AS p FROM lineitem GROUP BY 1)")
    return f"{', '.join(ctes)}, scored AS (SELECT {', '.join(LINE)}, l_returnflag, {' + '.join(parts)} - ln(p + 1e-9) AS score FROM lineitem JOIN f USING (l_returnflag))"


@query(f"WITH {_hbos_sql()} SELECT {', '.join(LINE)}, l_returnflag, {R('score', 'score')} FROM scored")
def OU2_hbos_scores(spark, sf):
    rows = _features(spark, sf)
    return outlier.HBOS().fit(rows, categorical=["l_returnflag"], nbins=_BINS).decision_function(rows)


_LIMIT = "(SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS r, count(*) OVER () AS n FROM scored) WHERE r = ceil(0.99 * (n - 1) - 1e-9))"


@query(f"WITH {_hbos_sql()} SELECT round(score, 4) > round({_LIMIT}, 4) AS outlier, count(*) AS n FROM scored GROUP BY 1")
def OU9_hbos_predict(spark, sf):
    rows = _features(spark, sf)
    return outlier.HBOS().fit(rows, categorical=["l_returnflag"], nbins=_BINS).predict(rows, digits=4).groupBy("outlier").agg(F.count("*").alias("n"))


@query(f"WITH {_hbos_sql(True)} SELECT score > {_LIMIT} AS outlier, count(*) AS n FROM scored GROUP BY 1")
def OU1_hbos_dynamic(spark, sf):
    rows = _features(spark, sf)
    return outlier.HBOS(dynamic_bins=True).fit(rows, categorical=["l_returnflag"], nbins=_BINS).predict(rows).groupBy("outlier").agg(F.count("*").alias("n"))


def _spad_sql() -> str:
    ctes, parts = [], []
    for c in LINE:
        ctes.append(f"i_{c} AS ({interval_sql('(SELECT 1 AS g, * FROM lineitem)', 'g', c, 'stddev')})")
        ctes.append(f"e_{c} AS (SELECT {_edges(c, lo=f'(SELECT lower FROM i_{c})', hi=f'(SELECT upper FROM i_{c})')})".replace("hi) FROM", "hi) AS e FROM", 1))
        ctes.append(f"p_{c} AS (SELECT list((n + 1) / ((SELECT count(*) FROM lineitem) + k)::DOUBLE ORDER BY b) AS d, max(k) AS k FROM (SELECT b, n, count(*) OVER () AS k FROM (SELECT len(list_filter((SELECT e FROM e_{c}), lambda x: x < {c})) AS b, count(*) AS n FROM lineitem GROUP BY 1)))")
        parts.append(f"-ln((SELECT d FROM p_{c})[1 + greatest(0, least(len(list_filter((SELECT e FROM e_{c}), lambda x: x < {c})) - 1, (SELECT k FROM p_{c}) - 1))] + 1e-9)")
    return f"WITH {', '.join(ctes)} SELECT {', '.join(LINE)}, {R(' + '.join(parts), 'score')} FROM lineitem"


@query(_spad_sql())
def OU6_spad_scores(spark, sf):
    rows = _features(spark, sf).select(*LINE)
    return outlier.SPAD().fit(rows, nbins=_BINS, method="stddev").decision_function(rows)


@query()
def OU7_spad_plus(spark, sf):
    rows = _features(spark, sf).select(*LINE)
    return outlier.SPAD(plus=True).fit(rows, nbins=_BINS, method="stddev").predict(rows).groupBy("outlier").agg(F.count("*").alias("n"))


_XY = "SELECT l_quantity AS x, 100 * l_discount + l_quantity / 10 AS y FROM lineitem"


@query(f"""WITH m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM ({_XY})),
v AS (SELECT *, (a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b) AS l FROM m), w AS (SELECT *, b / sqrt(b * b + power(l - a, 2)) AS vx, (l - a) / sqrt(b * b + power(l - a, 2)) AS vy FROM v)
SELECT x, {R('y', 'y')}, {R('power((x - mx) * vx + (y - my) * vy, 2)', 'score')} FROM ({_XY}), w""")
def OU8_pca_reconstruction(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (100 * F.col("l_discount") + F.col("l_quantity") / 10).alias("y"))
    return outlier.PCAReconstructionError().fit(rows).decision_function(rows)


_PCA = f"""m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM ({_XY})),
v AS (SELECT *, (a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b) AS l FROM m), w AS (SELECT *, b / sqrt(b * b + power(l - a, 2)) AS vx, (l - a) / sqrt(b * b + power(l - a, 2)) AS vy FROM v),
scored AS (SELECT round(power((x - mx) * vx + (y - my) * vy, 2), 6) AS score FROM ({_XY}), w)"""


@query(f"WITH {_PCA} SELECT score > {_LIMIT} AS outlier, count(*) AS n FROM scored GROUP BY 1")
def OU9_pca_predict(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (100 * F.col("l_discount") + F.col("l_quantity") / 10).alias("y"))
    scored = outlier.PCAReconstructionError().fit(rows).predict(rows)
    limit = scored.agg(F.max(F.when(~F.col("outlier"), F.round("score", 6))).alias("limit"))  # equal scores differ in the last digits
    return scored.crossJoin(F.broadcast(limit)).groupBy((F.round("score", 6) > F.col("limit")).alias("outlier")).agg(F.count("*").alias("n"))


@query()
def OU8_pca_predict(spark, sf):
    x = [f"e{k}" for k in range(8)]
    rows = table(spark, sf, "embeddings").select("vec_id", *[F.get("embedding", k).cast("double").alias(c) for k, c in enumerate(x)])
    return outlier.PCAReconstructionError().fit(rows, x, 3).predict(rows).select("vec_id", "score", "outlier")


@query(f"WITH e AS (SELECT {_edges('l_quantity')}), ".replace("hi) FROM", "hi) AS e FROM", 1) + "b AS (SELECT least(len(list_filter((SELECT e FROM e), lambda x: x <= l_quantity)) - 1, 9)::INTEGER AS bin FROM lineitem) SELECT bin, count(*) AS n FROM b GROUP BY 1")
def AGG16_histogram(spark, sf):
    rows = table(spark, sf, "lineitem")
    r = rows.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")).first()
    edges = [r["lo"] + k * ((r["hi"] - r["lo"]) / _BINS) for k in range(_BINS)] + [r["hi"]]
    return rows.groupBy(outlier.histogram_bin(F.col("l_quantity"), edges).alias("bin")).agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM lineitem) SELECT least(len(list_filter((SELECT e FROM e), lambda x: x <= l_extendedprice)) - 1, 4)::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def AGG17_percentile_histogram(spark, sf):
    rows = table(spark, sf, "lineitem")
    edges = sorted(set(intervals.exact_quantiles(rows, "l_extendedprice", [k / 5 for k in range(6)])))
    return rows.groupBy(outlier.histogram_bin(F.col("l_extendedprice"), edges).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice > max(o_totalprice) FILTER (r = ceil(0.99 * (n - 1) - 1e-9)) OVER (PARTITION BY o_orderstatus) AS flag FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)")
def PRJ11_quantile_flag(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    limit = intervals.order_statistic(rows, ["o_orderstatus"], "o_totalprice", 0.99, "higher", "limit")
    return rows.join(limit, "o_orderstatus").select("o_orderkey", (F.col("o_totalprice") > F.col("limit")).alias("flag"))


@query("WITH s AS (SELECT count(*) AS n, max(l_extendedprice) - min(l_extendedprice) AS span, stddev_pop(l_extendedprice) AS sd, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem) SELECT r AS rule, greatest(1, ceil(span / w))::INTEGER AS bins FROM (SELECT span, unnest(['sqrt', 'sturges', 'rice', 'fd', 'scott', 'auto']) AS r, unnest([span / sqrt(n), span / (log2(n) + 1), span / (2 * power(n, 1 / 3.0::DOUBLE)), 2 * iqr * power(n, -1 / 3.0::DOUBLE), power(24 * sqrt(pi()) / n, 1 / 3.0::DOUBLE) * sd, least(2 * iqr * power(n, -1 / 3.0::DOUBLE), span / (log2(n) + 1))]) AS w FROM s)")
def AGG18_bin_rules(spark, sf):
    rows = table(spark, sf, "lineitem")
    found = [(r, outlier.bin_counts(rows, ["l_extendedprice"], r)["l_extendedprice"]) for r in ("sqrt", "sturges", "rice", "fd", "scott", "auto")]
    return spark.createDataFrame(found, "rule string, bins int")


@query("SELECT l_returnflag, (count(*) + 1) / (SELECT count(*) + count(DISTINCT l_returnflag) FROM lineitem)::DOUBLE AS p0 FROM lineitem GROUP BY 1".replace("(count(*) + 1)", "round((count(*) + 1)").replace("::DOUBLE AS p0", "::DOUBLE, 6) AS p"))
def AGG15_laplace_frequency(spark, sf):
    rows = table(spark, sf, "lineitem")
    held, rest = outlier.HBOS()._categories(rows, ["l_returnflag"])["l_returnflag"]
    return (held if rest is None else held.unionByName(rest)).select(F.col("_v").alias("l_returnflag"), F.col("_p").alias("p"))


# Modelling --------------------------------------------------------------------------------------------------------


@query(f"SELECT feature, {R('1 / (1 - r2)', 'vif')} FROM (SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature, power(corr(l_quantity, l_extendedprice), 2) AS r2 FROM lineitem)")
def MO1_vif(spark, sf):
    kept, found = modelling.filter_features_by_vif(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 100.0)
    return spark.createDataFrame([(c, found[c]) for c in kept], "feature string, vif double")


@query("SELECT 'l_extendedprice' AS feature UNION ALL SELECT 'l_discount' UNION ALL SELECT 'l_tax'")
def MO1_vif_filter(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_copy", F.col("l_extendedprice") * 2 + F.col("l_tax"))
    kept, _ = modelling.filter_features_by_vif(rows, ["l_copy", "l_extendedprice", "l_discount", "l_tax"], 5.0)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


_NET = "SELECT l_extendedprice AS p, l_extendedprice * (1 - l_discount) AS net FROM lineitem"


@query(f"WITH m AS (SELECT regr_slope(p, net) AS b, regr_intercept(p, net) AS a FROM ({_NET})) SELECT round(net, 4) AS net, round(p - a - b * net, 3) + 0.0 AS p FROM ({_NET}), m")
def MO3_residualizer(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("p"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    out = modelling.FeatureResidualizer().fit(rows, corrcoef=0.8).transform(rows)
    return out.select(F.round("net", 4).alias("net"), (F.round("p", 3) + F.lit(0.0)).alias("p"))


@query(f"SELECT o_orderkey, {R('least(greatest(o_totalprice, lo), hi)', 'clipped')} FROM orders, (SELECT median(o_totalprice) - 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS lo, median(o_totalprice) + 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS hi FROM orders)")
def PRJ12_winsorize(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    b = intervals.interval(rows, [], "o_totalprice", "iqr").first()
    return rows.select("o_orderkey", modelling.RobustGaussianScaler._clip(F.col("o_totalprice"), (b["lower"], b["upper"])).alias("clipped"))


@query(f"WITH b AS (SELECT avg(o_totalprice) - 3 * stddev_pop(o_totalprice) AS lo, avg(o_totalprice) + 3 * stddev_pop(o_totalprice) AS hi FROM orders), c AS (SELECT o_orderkey, least(greatest(o_totalprice, lo), hi) AS x FROM orders, b) SELECT o_orderkey, {R('(x - avg(x) OVER ()) / stddev_pop(x) OVER ()', 'o_totalprice')} FROM c")
def MO5_scaler_without_power(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return modelling.RobustGaussianScaler().fit(rows, ["o_totalprice"], "stddev", None).transform(rows)


def _yeo_johnson_sql() -> str:
    """Grid refinement of lambda over clipped prices, a CTE a round; then the standardised transform."""
    shaped = lambda t: f"CASE WHEN x >= 0 THEN CASE WHEN abs({t}) < 1e-12 THEN ln(1 + x) ELSE (power(x + 1, {t}) - 1) / ({t}) END ELSE CASE WHEN abs({t} - 2) < 1e-12 THEN -ln(1 - x) ELSE -(power(1 - x, 2 - ({t})) - 1) / (2 - ({t})) END END"
    ctes = ["b AS (SELECT avg(o_totalprice) - 3 * stddev_pop(o_totalprice) AS lo, avg(o_totalprice) + 3 * stddev_pop(o_totalprice) AS hi FROM orders)", "c AS (SELECT o_orderkey, least(greatest(o_totalprice, lo), hi) AS x FROM orders, b)", "l AS (SELECT sum(sign(x) * ln(1 + abs(x))) AS l, count(x) AS n FROM c)", "r0 AS (SELECT -3.0::DOUBLE AS a, 5.0::DOUBLE AS z)"]
    for k in range(5):
        ctes.append(f"t{k} AS (SELECT a + unnest(range(17)) * ((z - a) / 16) AS t, (z - a) / 16 AS step FROM r{k})")
        ctes.append(f"f{k} AS (SELECT t, step, -n / 2 * ln(v) + (t - 1) * l AS fit FROM (SELECT t, step, var_pop({shaped('t')}) AS v FROM c, t{k} GROUP BY ALL), l)")
        ctes.append(f"r{k + 1} AS (SELECT arg_max(t, fit) - max(step) AS a, arg_max(t, fit) + max(step) AS z FROM f{k})")
    ctes.append(f"y AS (SELECT o_orderkey, {shaped('((a + z) / 2)')} AS y FROM c, r5)")
    return f"WITH {', '.join(ctes)} SELECT o_orderkey, {R('(y - avg(y) OVER ()) / stddev_pop(y) OVER ()', 'o_totalprice')} FROM y"


@query(_yeo_johnson_sql())
def MO4_scaler_yeo_johnson(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return modelling.RobustGaussianScaler().fit(rows, ["o_totalprice"]).transform(rows)


# Baskets ----------------------------------------------------------------------------------------------------------

_TX = "tx AS (SELECT DISTINCT l_orderkey AS tx, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _baskets(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tx"), F.col("p_brand").alias("item"))


def _lists(spark, sf):
    brands = [r[0] for r in table(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand").collect()]  # brands, 25 at any size
    return brands[:4], brands[2:6]


_NAMES = "b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS r FROM (SELECT DISTINCT p_brand FROM part))"
_COUNTS = f"""{_TX}, {_NAMES}, n AS (SELECT count(DISTINCT tx) AS n FROM tx), i AS (SELECT item, count(*) AS c FROM tx GROUP BY 1),
g AS (SELECT x.p_brand AS a, y.p_brand AS c FROM b x, b y WHERE x.r BETWEEN 1 AND 4 AND y.r BETWEEN 3 AND 6),
q AS (SELECT g.a, g.c, ia.c AS na, ic.c AS nc, (SELECT n FROM n) AS n, coalesce(j.n, 0) AS nac FROM g JOIN i ia ON ia.item = g.a JOIN i ic ON ic.item = g.c LEFT JOIN (SELECT l.item AS a, r.item AS c, count(*) AS n FROM tx l JOIN tx r USING (tx) GROUP BY ALL) j ON j.a = g.a AND j.c = g.c),
m AS (SELECT *, na / n::DOUBLE AS sa, nc / n::DOUBLE AS sc, nac / n::DOUBLE AS s, nac / na::DOUBLE AS ca, nac / nc::DOUBLE AS cc FROM q)"""


def _choose(n: str, k: str) -> str:
    return f"(lgamma(({n}) + 1) - lgamma(({k}) + 1) - lgamma(({n}) - ({k}) + 1))"


@query(f"""WITH {_COUNTS}, hy AS (SELECT a, c, sum(exp({_choose('na', 'k')} + {_choose('n - na', 'nc - k')} - {_choose('n', 'nc')})) AS h FROM (SELECT *, unnest(range(greatest(nac, nc - (n - na)), least(na, nc) + 1)) AS k FROM q) GROUP BY ALL)
SELECT a, c, {R('s / (sa * sc)', 'lift')}, {R('ca', 'confidence')}, {R('(ca + cc) / 2', 'kulczynski')}, {R('CASE WHEN ca > 0 AND cc > 0 THEN 2 * ca * cc / (ca + cc) ELSE 0 END', 'sorensen_dice')},
{R('coalesce((s - sa * sc) / nullif(greatest(s * (1 - sa), sa * (sc - s)), 0), 0)', 'zhang')},
{R('(od - 1) / (od + 1)', 'yules_q')}, {R('least(1.0, h)', 'hypergeom')} FROM (SELECT *, nac * (n - na - nc + nac) / nullif(((na - nac) * (nc - nac))::DOUBLE, 0) AS od FROM m) JOIN hy USING (a, c)""")
def AS4_to_10_association(spark, sf):
    return TransactionAnalyzer().fit(_baskets(spark, sf)).association(*_lists(spark, sf))


@query(f"WITH {_COUNTS.replace('WHERE x.r BETWEEN 1 AND 4 AND y.r BETWEEN 3 AND 6', '')} SELECT a, c, na, nc, nac, n FROM q")
def JN8_cooccurrence(spark, sf):
    brands = [r[0] for r in table(spark, sf, "part").select("p_brand").distinct().collect()]  # brands, 25 at any size
    return TransactionAnalyzer().fit(_baskets(spark, sf)).counts(brands, brands)


@query(f"WITH {_COUNTS} SELECT a, c, {R('s / (sa * sc)', 'value')} FROM m")
def AS11_correlation_matrix(spark, sf):
    return TransactionAnalyzer().fit(_baskets(spark, sf)).correlation_matrix(*_lists(spark, sf), "lift")


@query(f"WITH {_TX} SELECT item, count(*) AS n, {R('count(*) / (SELECT count(DISTINCT tx) FROM tx)::DOUBLE', 'support')} FROM tx GROUP BY 1")
def AGG20_support(spark, sf):
    return TransactionAnalyzer().fit(_baskets(spark, sf)).transform()


@query(f"WITH {_TX} SELECT DISTINCT item FROM tx")
def AS1_items(spark, sf):
    enc = TransactionEncoder().fit(_baskets(spark, sf))
    return spark.createDataFrame([(i,) for i in enc.items], "item string")


@query(f"WITH {_TX} SELECT * FROM tx")
def AS2_encode_sparse(spark, sf):
    return TransactionEncoder().fit(_baskets(spark, sf)).transform(_baskets(spark, sf), sparse=True)




@query("WITH t AS (SELECT DISTINCT user_id AS tx, event_type AS item FROM events) SELECT tx, list_sort(list(item)) AS items FROM t GROUP BY 1")
def AS3_inverse_transform(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("tx"), F.col("event_type").alias("item"))
    enc = TransactionEncoder().fit(rows)
    return enc.inverse_transform(enc.transform(rows))


# Evaluation -------------------------------------------------------------------------------------------------------


def _scored(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    p = 1 / (1 + F.exp(-(F.col("n_chars") - 2000) / 1500))
    return rows.select("doc_id", F.col("quality").alias("y"), F.round(p, 9).alias("p")).withColumn("predicted", (F.col("p") >= 0.5).cast("int"))


_S = "s AS (SELECT doc_id, quality AS y, round(1 / (1 + exp(-(n_chars - 2000) / 1500.0::DOUBLE)), 9) AS p FROM labels JOIN documents USING (doc_id))"
_CURVE = f"{_S}, c AS (SELECT list_transform(range(1, 10), lambda k: 0) AS x), e AS (SELECT quantile_cont(p, {[round(k / 10, 1) for k in range(1, 10)]}) AS e FROM s), b AS (SELECT len(list_filter(e, lambda x: x < p))::INTEGER AS bin, y, p FROM s, e), r AS (SELECT bin, count(*) AS n, avg(y) AS prob_true, avg(p) AS prob_pred FROM b GROUP BY 1)"


@query(f"WITH {_CURVE} SELECT bin, n, {R('prob_true', 'prob_true')}, {R('prob_pred', 'prob_pred')} FROM r")
def PL7_reliability_curve(spark, sf):
    return evaluation.reliability_curve(_scored(spark, sf), "y", "p", 10)


@query(f"WITH {_CURVE} SELECT {R('(SELECT avg(power(p - y, 2)) FROM s)', 'brier')}, {R('avg(abs(prob_true - prob_pred))', 'mean_error')}, {R('max(abs(prob_true - prob_pred))', 'max_error')} FROM r")
def PL7_calibration_summary(spark, sf):
    return evaluation.calibration_summary(_scored(spark, sf), "y", "p", 10)


@query(f"WITH {_S} SELECT least(14, floor((p - lo) * 15 / (hi - lo)))::BIGINT AS bin, count(*) AS n FROM s, (SELECT min(p) AS lo, max(p) AS hi FROM s) GROUP BY 1")
def PL8_score_distribution(spark, sf):
    return evaluation.score_distribution(_scored(spark, sf), "p", 15)


@query(f"WITH {_S}, k AS (SELECT CASE WHEN y = 1 AND p < 0.5 THEN 'FN' WHEN y = 0 AND p < 0.5 THEN 'TN' WHEN y = 1 THEN 'TP' ELSE 'FP' END AS cell FROM s), c AS (SELECT z.cell, count(k.cell) AS n FROM (SELECT unnest(['FN', 'TN', 'TP', 'FP']) AS cell) z LEFT JOIN k USING (cell) GROUP BY 1) SELECT cell, n, {R("100.0 * n / nullif(sum(n) OVER (PARTITION BY cell IN ('FN', 'TP')), 0)", 'percentage')} FROM c")
def PL9_confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(_scored(spark, sf), "y", "predicted")


@query(f"WITH {_S}, z AS (SELECT a AS error_rate, (p >= a)::INTEGER + (1 - p >= a)::INTEGER AS k FROM s, (SELECT unnest({list(evaluation.ALPHAS)})::DOUBLE AS a)) SELECT error_rate, {R('avg((k = 1)::INTEGER)', 'efficiency')}, {R('avg(k)', 'validity')} FROM z GROUP BY 1")
def PL10_efficiency_curve(spark, sf):
    rows = _scored(spark, sf).withColumn("alpha", F.explode(F.lit(list(evaluation.ALPHAS))))
    return evaluation.efficiency_curve(rows.withColumn("set", F.array(F.col("p") >= F.col("alpha"), 1 - F.col("p") >= F.col("alpha"))), "alpha", "set")


@query(f"SELECT round(k / 999.0::DOUBLE, 6) AS x, {R('CASE WHEN k IN (0, 999) THEN 0 ELSE exp(lgamma(7.5) - lgamma(2.5) - lgamma(5) + 1.5 * ln(k / 999.0::DOUBLE) + 4 * ln(1 - k / 999.0::DOUBLE)) END', 'pdf')} FROM (SELECT unnest(range(1000)) AS k)")
def PL11_beta_confidence(spark, sf):
    return evaluation.beta_confidence_analysis(spark, 2.5, 5.0)


@query()
def PL12_power_curve(spark, sf):
    return evaluation.power_curve(spark, 0.5)


@query()
def PL13_power_vs_allocation(spark, sf):
    return evaluation.power_vs_allocation(spark, 0.4, 200)


# Sources ----------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS unique_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def SRC1_panel_validation(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("y"))
    validate.panel(rows, "unique_id", "ds", "y")
    return rows.groupBy("unique_id").agg(F.count("*").alias("n"), F.min("ds").alias("first"), F.max("ds").alias("last"))


@query("SELECT column_name AS feature FROM (DESCRIBE lineitem) WHERE column_name NOT IN ('l_orderkey', 'l_linenumber')")
def SRC2_feature_names(spark, sf):
    names = validate.features(table(spark, sf, "lineitem"), keys=["l_orderkey", "l_linenumber"])
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("SELECT 'l_nothing' AS missing, count(*) AS n FROM region")
def SRC3_missing_column(spark, sf):
    rows = table(spark, sf, "region")
    try:
        validate.same_columns(rows, ["r_name", "l_nothing"])
        said = ""
    except ValueError as e:
        said = str(e).rsplit(" ", 1)[1]
    return rows.agg(F.lit(said).alias("missing"), F.count("*").alias("n")).select("missing", "n")


@query("SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem")
def SRC4_keys_carried(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE, "l_returnflag")
    scored = outlier.HBOS().fit(rows, [*LINE, "l_returnflag"], ["l_returnflag"], _BINS).decision_function(rows)
    return scored.filter("score is not null").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query(f"SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS fmt, count(*) AS n, {R('sum(n_nationkey)', 'total')} FROM nation")
def SRC6_connectors(spark, sf):
    found = None
    for fmt, options in (("csv", {"header": True, "inferSchema": True}), ("json", {}), ("orc", {}), ("parquet", {})):
        at = scratch(spark, "connectors")
        table(spark, sf, "nation").write.format(fmt).options(header=True).mode("overwrite").save(at)
        rows = validate.table(spark, at, fmt, **options).agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.sum("n_nationkey").cast("double").alias("total"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query(f"WITH {_TX} SELECT item, count(*) AS n, {R('count(*) / (SELECT count(DISTINCT tx) FROM tx)::DOUBLE', 'support')} FROM tx GROUP BY 1")
def SNK1_save_and_load(spark, sf):
    at = scratch(spark, "saved")
    TransactionAnalyzer().fit(_baskets(spark, sf)).save(at)
    return TransactionAnalyzer.load(spark, at).transform()


@query("SELECT DISTINCT user_id AS tx, item FROM (SELECT user_id, unnest([event_type, event_type]) AS item FROM events)")
def SRC5_transactions(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.array("event_type", "event_type").alias("items"))
    return validate.transactions(rows, "user_id", "items")


@query("SELECT (i % 3)::INTEGER AS unique_id, TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * (i // 3) AS ds FROM (SELECT unnest(range(30)) AS i)")
def SRC7_synthetic_panel(spark, sf):
    return validate.synthetic_panel(spark, 3, 10).select("unique_id", "ds")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def JN9_equi_join(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")

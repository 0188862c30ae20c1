"""Drift detectors on events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.drift import CatDrift, ConDrift, bucket, wasserstein, weights
from .base import R, interval_sql, query, table

CUT, OLD = "2024-01-16", "1999-01-01"


def _events(spark, sf):
    return table(spark, sf, "events").select(F.pmod("user_id", F.lit(3)).alias("unique_id"), F.col("ts").alias("ds"), F.col("event_type").alias("y"))


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("unique_id"), F.col("o_orderdate").alias("ds"), F.col("o_orderpriority").alias("y"))


def _values(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("y"))


_SOURCES = {
    "events": ("SELECT user_id % 3 AS id, date_trunc('week', ts)::TIMESTAMP + INTERVAL 6 DAY AS bucket, event_type AS x, ts AS t FROM events", f"'{CUT}'"),
    "orders": ("SELECT o_orderstatus AS id, date_trunc('quarter', o_orderdate)::TIMESTAMP AS bucket, o_orderpriority AS x, o_orderdate AS t FROM orders", f"'{OLD}'"),
    "values": ("SELECT event_type AS id, date_trunc('week', ts)::TIMESTAMP + INTERVAL 6 DAY AS bucket, value AS x, ts AS t FROM events", f"'{CUT}'"),
}


def _counts(name: str, side: str, source: str) -> str:
    rows, cut = _SOURCES[source]
    keep = f"t < {cut}" if side == "old" else f"t >= {cut}"
    return f"""{name}_r AS (SELECT id, bucket, x, count(*) AS n FROM ({rows}) WHERE {keep} GROUP BY ALL),
    {name} AS (SELECT a.id, a.bucket, b.x, coalesce(r.n, 0)::BIGINT AS n FROM (SELECT DISTINCT id, bucket FROM {name}_r) a CROSS JOIN (SELECT DISTINCT x FROM {name}_r) b LEFT JOIN {name}_r r USING (id, bucket, x))"""


def _metric(func: str, p: str, q: str) -> str:
    if func == "chebyshev":
        return f"max(abs({p} - {q}))"
    if func == "psi":
        o, e = (f"least(greatest({x}, 0.0001::DOUBLE), 1.0::DOUBLE)" for x in (p, q))
        return f"sum(({o} - {e}) * ln({o} / {e}))"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * ln({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, sum({part(p)} + {part(q)}) / 2))"


def _distances(func: str, method: str, scope: str) -> str:
    own = "x" if scope == "global" else "id, x"
    other = f"coalesce(sum(n) OVER (PARTITION BY {own} ORDER BY id, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)" if method == "expanding" else f"sum(n) OVER (PARTITION BY {own}) - n"
    return f"""d0 AS (SELECT *, {other} AS o FROM old),
    d1 AS (SELECT *, n / nullif(sum(n) OVER g, 0)::DOUBLE AS p, o / nullif(sum(o) OVER g, 0)::DOUBLE AS q FROM d0 WINDOW g AS (PARTITION BY id, bucket)),
    d AS (SELECT id, bucket, coalesce({_metric(func, 'p', 'q')}, 0.0) AS metric FROM d1 GROUP BY id, bucket)"""


def _score(func: str, compat: bool) -> str:
    js = func == "jensenshannon"
    norm = lambda x: f"{x} / nullif(sum({x}) OVER g, 0)" if js else x
    return f"""ref AS (SELECT id, x, round_even(sum(n)::DOUBLE / (sum(sum(n)) OVER ({'' if compat else 'PARTITION BY id'}))::DOUBLE, 4) AS q FROM old GROUP BY id, x),
    s0 AS (SELECT id, bucket, x, n / sum(n) OVER (PARTITION BY id, bucket)::DOUBLE AS p FROM new),
    s1 AS (SELECT id, bucket, {norm('p')} AS p, {norm('q')} AS q FROM s0 JOIN ref USING (id, x) WINDOW g AS (PARTITION BY id, bucket)),
    s AS (SELECT id, bucket, {_metric(func, 'p', 'q')} AS metric FROM s1 GROUP BY id, bucket)"""


def _cat_predict(source: str, func: str, method: str, limit: str, scope: str = "global", compat: bool = True) -> str:
    return f"""WITH {_counts('old', 'old', source)}, {_counts('new', 'new', source)}, {_distances(func, method, scope)}, {_score(func, compat)},
    t AS ({interval_sql('d', 'id', 'metric', limit)})
    SELECT id AS unique_id, bucket AS ds, {R('metric', 'metric')}, coalesce(metric >= upper, false) AS drift FROM s LEFT JOIN t USING (id)"""


def _sides(spark, sf, source):
    rows = {"events": _events, "orders": _orders, "values": _values}[source](spark, sf)
    cut = F.lit(OLD if source == "orders" else CUT).cast("timestamp_ntz")
    return rows.filter(F.col("ds") < cut), rows.filter(F.col("ds") >= cut)


def _cat(spark, sf, source, func, method, limit, scope="global", compat=True):
    old, new = _sides(spark, sf, source)
    return CatDrift({"events": "W", "orders": "QS"}[source], func, limit, method, scope, compat).fit(old), new


@query(_cat_predict("events", "chebyshev", "expanding", "mad"))
def DR16_catdrift_predict(spark, sf):
    model, new = _cat(spark, sf, "events", "chebyshev", "expanding", "mad")
    return model.predict(new)


@query(_cat_predict("orders", "psi", "expanding", "auto"))
def DR5_catdrift_psi(spark, sf):
    model, new = _cat(spark, sf, "orders", "psi", "expanding", "auto")
    return model.predict(new)


@query(_cat_predict("orders", "jensenshannon", "expanding", "stddev"))
def DR4_catdrift_jensenshannon(spark, sf):
    model, new = _cat(spark, sf, "orders", "jensenshannon", "expanding", "stddev")
    return model.predict(new)


@query(_cat_predict("orders", "chebyshev", "jackknife", "iqr", "entity", False))
def DR7_catdrift_jackknife_entity(spark, sf):
    model, new = _cat(spark, sf, "orders", "chebyshev", "jackknife", "iqr", "entity", False)
    return model.predict(new)


def _distance_sql(source: str, func: str, method: str, scope: str) -> str:
    return f"WITH {_counts('old', 'old', source)}, {_distances(func, method, scope)} SELECT id, bucket, {R('metric', 'metric')} FROM d"


@query(_distance_sql("orders", "chebyshev", "expanding", "global"))
def DR6_catdrift_expanding_distance(spark, sf):
    return _cat(spark, sf, "orders", "chebyshev", "expanding", "auto")[0].distances


@query(_distance_sql("orders", "psi", "jackknife", "global"))
def DR7_catdrift_jackknife_distance(spark, sf):
    return _cat(spark, sf, "orders", "psi", "jackknife", "auto")[0].distances


@query(_distance_sql("orders", "jensenshannon", "expanding", "entity"))
def DR6_catdrift_expanding_entity(spark, sf):
    return _cat(spark, sf, "orders", "jensenshannon", "expanding", "auto", "entity")[0].distances


@query(f"WITH {_counts('old', 'old', 'orders')} SELECT id, x, round_even(sum(n)::DOUBLE / (sum(sum(n)) OVER ())::DOUBLE, 4) AS q FROM old GROUP BY id, x")
def DR2_catdrift_reference(spark, sf):
    return _cat(spark, sf, "orders", "chebyshev", "expanding", "auto")[0].reference


@query(f"WITH {_counts('old', 'old', 'orders')} SELECT id, bucket, x, n FROM old")
def AGG14_frequency(spark, sf):
    old, _ = _sides(spark, sf, "orders")
    return CatDrift("QS")._counts(old, "unique_id", "ds", "y")


@query(f"WITH {_counts('old', 'old', 'orders')}, {_distances('chebyshev', 'expanding', 'global')}, t AS ({interval_sql('d', 'id', 'metric', 'auto')}) SELECT id, {R('upper', 'threshold')} FROM t")
def DR15_thresholds(spark, sf):
    return _cat(spark, sf, "orders", "chebyshev", "expanding", "auto")[0].threshold_frame


@query(f"WITH {_counts('old', 'old', 'orders')}, {_counts('new', 'new', 'orders')}, {_score('chebyshev', False)} SELECT id AS unique_id, bucket AS ds, {R('metric', 'metric')} FROM s")
def DR8_catdrift_score(spark, sf):
    model, new = _cat(spark, sf, "orders", "chebyshev", "expanding", "auto", compat=False)
    return model.score(new)


def _con_values(name: str, side: str) -> str:
    rows, cut = _SOURCES["values"]
    return f"{name} AS (SELECT id, bucket, x FROM ({rows}) WHERE t {'<' if side == 'old' else '>='} {cut} AND x IS NOT NULL)"


def _con_distance(method: str, scope: str) -> str:
    own = "" if scope == "global" else "PARTITION BY id"
    pair = ("o.seq < p.seq" if method == "expanding" else "o.seq <> p.seq") + ("" if scope == "global" else " AND o.id = p.id")
    return f"""per AS (SELECT id, bucket, count(*) AS size, row_number() OVER ({own} ORDER BY id, bucket) AS seq FROM old GROUP BY id, bucket),
    v AS (SELECT old.*, size, seq FROM old JOIN per USING (id, bucket)),
    past AS (SELECT p.id, p.bucket, o.x, 1.0::DOUBLE / count(*) OVER (PARTITION BY p.id, p.bucket) AS w FROM per p JOIN v o ON {pair}),
    u AS (SELECT id, bucket, x, sum(w) AS w FROM (SELECT * FROM past UNION ALL SELECT id, bucket, x, -1.0::DOUBLE / size FROM v SEMI JOIN past USING (id, bucket)) GROUP BY id, bucket, x),
    f AS (SELECT id, bucket, sum(w) OVER g AS f, lead(x) OVER g - x AS gap FROM u WINDOW g AS (PARTITION BY id, bucket ORDER BY x)),
    d AS (SELECT id, bucket, coalesce(m, 0.0) AS metric FROM per LEFT JOIN (SELECT id, bucket, sum(abs(f) * gap) AS m FROM f GROUP BY ALL) USING (id, bucket))"""


_CON_SCORE = """b AS (SELECT id, bucket, x, -1.0::DOUBLE / count(*) OVER (PARTITION BY id, bucket) AS w FROM new),
    rf AS (SELECT id, x::FLOAT::DOUBLE AS x, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS w FROM old),
    su AS (SELECT id, bucket, x, sum(w) AS w FROM (SELECT * FROM b UNION ALL SELECT id, bucket, rf.x, rf.w FROM (SELECT DISTINCT id, bucket FROM b) JOIN rf USING (id)) GROUP BY ALL),
    sf AS (SELECT id, bucket, sum(w) OVER g AS f, lead(x) OVER g - x AS gap FROM su WINDOW g AS (PARTITION BY id, bucket ORDER BY x)),
    s AS (SELECT id, bucket, sum(abs(f) * gap) AS metric FROM sf GROUP BY ALL)"""


def _con(spark, sf, method, limit="auto", scope="global"):
    old, new = _sides(spark, sf, "values")
    return ConDrift("W", "ws", limit, method, scope).fit(old), new


@query(f"WITH {_con_values('old', 'old')}, {_con_values('new', 'new')}, {_con_distance('expanding', 'global')}, {_CON_SCORE}, t AS ({interval_sql('d', 'id', 'metric', 'stddev')}) SELECT id AS unique_id, bucket AS ds, {R('metric', 'metric')}, coalesce(metric >= upper, false) AS drift FROM s LEFT JOIN t USING (id)")
def DR14_condrift_predict(spark, sf):
    model, new = _con(spark, sf, "expanding", "stddev")
    return model.predict(new)


@query(f"WITH {_con_values('old', 'old')}, {_con_distance('expanding', 'global')} SELECT id, bucket, {R('metric', 'metric')} FROM d")
def DR12_condrift_expanding(spark, sf):
    return _con(spark, sf, "expanding")[0].distances


@query(f"WITH {_con_values('old', 'old')}, {_con_distance('jackknife', 'global')} SELECT id, bucket, {R('metric', 'metric')} FROM d")
def DR13_condrift_jackknife(spark, sf):
    return _con(spark, sf, "jackknife")[0].distances


@query(f"WITH {_con_values('old', 'old')}, {_con_distance('expanding', 'entity')} SELECT id, bucket, {R('metric', 'metric')} FROM d")
def DR12_condrift_expanding_entity(spark, sf):
    return _con(spark, sf, "expanding", scope="entity")[0].distances


@query("""WITH u AS (SELECT l_returnflag AS k, x, sum(w) AS w FROM (SELECT l_returnflag, l_quantity AS x, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_returnflag) AS w FROM lineitem
    UNION ALL SELECT l_returnflag, l_discount * 100, -1.0::DOUBLE / count(*) OVER (PARTITION BY l_returnflag) FROM lineitem) GROUP BY ALL),
    f AS (SELECT k, sum(w) OVER g AS f, lead(x) OVER g - x AS gap FROM u WINDOW g AS (PARTITION BY k ORDER BY x)) SELECT k, """ + R("sum(abs(f) * gap)", "ws") + " FROM f GROUP BY k")
def DR11_wasserstein(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), "l_quantity", (F.col("l_discount") * 100).alias("d"))
    both = weights(rows, ["k"], "l_quantity").unionByName(weights(rows, ["k"], "d", -1))
    return wasserstein(both, ["k"], "x", "w", "ws")


@query(f"WITH {_con_values('old', 'old')} SELECT id, {R('x', 'x')}, {R('c / sum(c) OVER (PARTITION BY id)', 'w')} FROM (SELECT id, x::FLOAT::DOUBLE AS x, count(*) AS c FROM old GROUP BY ALL)")
def DR10_condrift_reference(spark, sf):
    return _con(spark, sf, "expanding")[0].reference


_FREQS = {"D": "date_trunc('day', ts)", "W": "date_trunc('week', ts) + INTERVAL 6 DAY", "ME": "date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 DAY", "MS": "date_trunc('month', ts)", "QS": "date_trunc('quarter', ts)", "h": "date_trunc('hour', ts)", "15min": "time_bucket(INTERVAL 15 MINUTE, ts)"}


@query(" UNION ALL ".join(f"SELECT '{f}' AS freq, ({e})::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY ALL" for f, e in _FREQS.items()))
def DR18_time_buckets(spark, sf):
    rows = table(spark, sf, "events")
    out = None
    for f in _FREQS:
        one = rows.groupBy(bucket(F.col("ts"), f).alias("bucket")).agg(F.count("*").alias("n")).select(F.lit(f).alias("freq"), "bucket", "n")
        out = one if out is None else out.unionByName(one)
    return out

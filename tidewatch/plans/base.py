"""Registry of queries and SQL fragments that several oracles share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; doubles of its result are rounded to six digits."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: in spark.checkpoint.dir; on one machine, where that is unset, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}" if at else tempfile.mkdtemp(prefix=f"tidewatch-{name}-")


def R(expression: str, name: str) -> str:
    """A rounded output column; not-a-number becomes NULL."""
    return f"round(nullif({expression}, 'nan'::DOUBLE)::DOUBLE, 6) + 0.0::DOUBLE AS {name}"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_id, ds, y: events' value by type and day."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unique_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ds")).agg(F.round(F.sum("value"), 4).alias("y"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_id, ds, y: orders' total price by priority and month."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("unique_id"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ds")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


DAILY = "daily AS (SELECT event_type AS unique_id, date_trunc('day', ts)::TIMESTAMP AS ds, round(sum(value), 4) AS y FROM events GROUP BY ALL)"
MONTHLY = "monthly AS (SELECT o_orderpriority AS unique_id, date_trunc('month', o_orderdate)::TIMESTAMP AS ds, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY ALL)"
#: Numbered daily and monthly series: unique_id, i, y, n.
NUMBERED = "s AS (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM {})"
DAYS = f"{DAILY}, {NUMBERED.format('daily')}"
MONTHS = f"{MONTHLY}, {NUMBERED.format('monthly')}"


def interval_sql(source: str, by: str, value: str, method: str) -> str:
    """SELECT by, method, lower, upper of a named interval."""
    skew = "(avg(power(z.x - m, 3)) / nullif(power(max(sd), 3), 0))"
    kurt = "(avg(power(z.x - m, 4)) / nullif(power(max(sd), 4), 0) - 3)"
    cv = "CASE WHEN m = 0 THEN 'inf'::DOUBLE ELSE sd / abs(m) END"
    auto = f"CASE WHEN coalesce(abs(sk) <= 0.5 AND abs(ku) <= 1, false) THEN CASE WHEN {cv} < 0.15 THEN 'stddev' WHEN {cv} < 0.3 THEN 'iqr' ELSE 'mad' END WHEN {cv} > 1.5 OR coalesce(sk > 0.5, false) THEN 'mad' ELSE 'iqr' END"
    kind = auto if method == "auto" else f"'{method}'"
    return f"""SELECT {by}, method, CASE method WHEN 'stddev' THEN m - 3 * sd WHEN 'mad' THEN md - 3 * mad ELSE md - 1.5 * (q3 - q1) END AS lower,
        CASE method WHEN 'stddev' THEN m + 3 * sd WHEN 'mad' THEN md + 3 * mad ELSE md + 1.5 * (q3 - q1) END AS upper
    FROM (SELECT *, {kind} AS method FROM (
        SELECT {by}, m, max(sd) AS sd, max(md) AS md, max(q1) AS q1, max(q3) AS q3, median(abs(z.x - md)) AS mad, {skew} AS sk, {kurt} AS ku FROM
        (SELECT {by}, {value}::DOUBLE AS x, avg({value}::DOUBLE) OVER g AS m, stddev_pop({value}) OVER g AS sd, median({value}::DOUBLE) OVER g AS md, quantile_cont({value}::DOUBLE, 0.25) OVER g AS q1, quantile_cont({value}::DOUBLE, 0.75) OVER g AS q3
         FROM {source} WHERE {value} IS NOT NULL WINDOW g AS (PARTITION BY {by})) z GROUP BY {by}, m))"""


#: Two-sided tail of Student's t at columns t (not negative) and nu: Simpson's rule over the angle atan(t / sqrt(nu)).
_ANGLE = "atan(t / sqrt(nu))"
T_TAILS = f"""2 * exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0)) / sqrt(pi()) * (pi() / 2 - {_ANGLE}) / 6000
    * list_sum(list_transform(range(2001), lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * power(greatest(0.0, cos({_ANGLE} + (pi() / 2 - {_ANGLE}) * k / 2000)), nu - 1)))"""

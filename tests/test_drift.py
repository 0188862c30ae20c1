from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.operators.drift import CatDrift, ConDrift, bucket, wasserstein, weights
from tidewatch.plans.catalogue import QUERIES

DAY = dt.datetime(2024, 1, 1)


def panel(spark, rows):
    return spark.createDataFrame([(i, DAY + dt.timedelta(days=d), x) for i, d, x in rows], "unique_id string, ds timestamp_ntz, y string")


def test_validation(spark):
    df = panel(spark, [("a", 0, "x")])
    with pytest.raises(ValueError):
        CatDrift()
    with pytest.raises(ValueError):
        CatDrift("D", "nope")
    with pytest.raises(ValueError):
        CatDrift("D").fit(df, target_col="missing")
    with pytest.raises(ValueError):
        CatDrift("D").fit(df, time_col="unique_id")
    with pytest.raises(ValueError):
        CatDrift("D").score(df)
    with pytest.raises(ValueError):
        ConDrift("D", "other")


def test_week_label_closes_on_sunday(spark):
    days = spark.createDataFrame([(DAY + dt.timedelta(days=k),) for k in range(8)], "t timestamp_ntz")
    got = [r[0].day for r in days.select(bucket(F.col("t"), "W")).collect()]
    assert got == [7] * 7 + [14]


def test_expanding_by_hand(spark):
    rows = [("a", 0, "x"), ("a", 0, "y"), ("a", 1, "x"), ("a", 2, "y"), ("b", 0, "x"), ("b", 0, None)]
    got = {(r.id, r.bucket.day): r.metric for r in CatDrift("D", drift_limit="stddev").fit(panel(spark, rows)).distances.collect()}
    assert got == pytest.approx({("a", 1): 0.0, ("a", 2): 0.5, ("a", 3): 2 / 3, ("b", 1): 0.5})
    own = {(r.id, r.bucket.day): r.metric for r in CatDrift("D", drift_limit="stddev", scope="entity").fit(panel(spark, rows)).distances.collect()}
    assert own[("b", 1)] == 0.0


def test_unseen_entity_and_category(spark):
    model = CatDrift("D", drift_limit=(0.0, 0.9), compat=False).fit(panel(spark, [("a", 0, "x"), ("a", 1, "x"), ("a", 1, "y")]))
    got = model.predict(panel(spark, [("a", 5, "x"), ("a", 5, "new"), ("zz", 5, "x")])).collect()
    assert [(r.unique_id, round(r.metric, 6), r.drift) for r in got] == [("a", 0.1667, False)]
    assert model.thresholds == {"a": 0.9}


def test_empty_input(spark):
    model = CatDrift("D", drift_limit="mad").fit(panel(spark, []))
    assert model.predict(panel(spark, [])).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=12), st.lists(st.integers(-5, 5), min_size=1, max_size=12))
def test_wasserstein_against_quantiles(spark, a, b):
    rows = [(1, float(x), 1 / len(a)) for x in a] + [(1, float(x), -1 / len(b)) for x in b]
    got = wasserstein(spark.createDataFrame(rows, "k int, x double, w double"), ["k"], "x", "w", "d").first()["d"]
    n = len(a) * len(b)
    want = np.abs(np.repeat(np.sort(a), len(b)) - np.repeat(np.sort(b), len(a))).sum() / n
    assert got == pytest.approx(want, abs=1e-9)


def test_weights_are_of_distinct_values_without_a_window_of_rows(spark, tmp_path):
    rows = [("a", 1.0, 4.0)] * 3 + [("a", 2.0, None), (None, 5.0, 7.0), (None, None, 8.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {(r.k, r.x): r.w for r in weights(df, ["k"], "x", -1).collect()}
    assert got == pytest.approx({("a", 1.0): -0.75, ("a", 2.0): -0.25, (None, 5.0): -0.5, (None, None): -0.5})
    both = weights(df, ["k"], "x").unionByName(weights(df, ["k"], "y", -1))
    assert {r.k: r.d for r in wasserstein(both, ["k"], "x", "w", "d").collect()} == pytest.approx({"a": 2.75, None: 1.0})
    spark.createDataFrame([("A", 1.0, 0.0), ("A", 2.0, 0.01)], "l_returnflag string, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = QUERIES["DR11_wasserstein"](spark, str(tmp_path))
    assert plan.first()["ws"] == 1.0
    assert "count(1) windowspecdefinition" not in plan._jdf.queryExecution().toString()


def test_condrift_jackknife_by_hand(spark):
    rows = spark.createDataFrame([("a", DAY, 0.0), ("a", DAY + dt.timedelta(days=1), 2.0), ("a", DAY + dt.timedelta(days=2), 4.0)], "unique_id string, ds timestamp_ntz, y double")
    got = [r.metric for r in ConDrift("D", method="jackknife", drift_limit="iqr").fit(rows).distances.orderBy("bucket").collect()]
    assert got == pytest.approx([3.0, 2.0, 3.0])


def test_streaming_counts_match_batch(spark, tmp_path):
    from tidewatch.streaming import monitor

    rows = panel(spark, [("a", d, x) for d in range(4) for x in "xxy"])
    model = CatDrift("D", drift_limit="stddev", compat=False).fit(rows)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = []
    q = monitor.start(stream, model, lambda df, e: out.extend(df.collect()), "unique_id", "ds", "y", str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    assert {r.bucket.day for r in out} >= {1, 2}
    assert all(abs(r.metric) < 1e-3 for r in out)

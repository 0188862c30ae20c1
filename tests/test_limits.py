"""Values that are not finite, categories before numbers, bounds of many columns at once, long series."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import intervals, series
from tidewatch.operators.modelling import FeatureResidualizer, RobustGaussianScaler
from tidewatch.operators.outlier import HBOS, SPAD, PCAReconstructionError, bin_counts, histogram_bin
from tidewatch.operators.stats import poisson_bootstrap


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), float("-inf")])
def test_values_that_are_not_finite_raise(spark, odd):
    df = spark.createDataFrame([(1.0, 0.0), (odd, 1.0), (3.0, 2.0), (2.0, 5.0)], "x double, y double")
    for run in (lambda: intervals.select_ranks(df, "x", [1]), lambda: HBOS().fit(df), lambda: SPAD().fit(df), lambda: PCAReconstructionError().fit(df), lambda: FeatureResidualizer().fit(df), lambda: RobustGaussianScaler().fit(df)):
        with pytest.raises(ValueError, match="not finite"):
            run()


def test_ranks_over_the_whole_range_of_doubles(spark):
    x = [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0, np.nextafter(1.0, 2), 1.0, None]
    df = spark.createDataFrame([(v if v is None else float(v),) for v in x], "x double")
    want = sorted(v for v in x if v is not None)
    assert intervals.select_ranks(df, "x", list(range(8))) == dict(enumerate(want))
    assert intervals.select_ranks(df.limit(0), "x", []) == {}


@pytest.mark.parametrize("compiled", [64, 3])
def test_places_between_edges(spark, compiled, monkeypatch):
    monkeypatch.setattr(intervals, "COMPILED", compiled)
    edges = [-2.5, -1.0, 0.0, 0.1, 0.2, 1.0, 7.0]
    x = [-9.0, -2.5, -2.0, -1.0, -0.0, 0.1, np.nextafter(0.1, 1), 0.15, 0.2, 7.0, 8.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    plan = df.select("x", intervals.count_below(F.col("x"), edges).alias("a"), intervals.count_below(F.col("x"), edges, True).alias("b"), histogram_bin(F.col("x"), edges).alias("c"))
    assert ("lambda" in plan._jdf.queryExecution().toString()) == (compiled < len(edges))
    rows = plan.collect()
    assert (rows[-1]["a"], rows[-1]["b"], rows[-1]["c"]) == (0, 0, -1)
    for v, r in zip(x, rows):
        assert (r["a"], r["b"]) == (np.searchsorted(edges, v, "left"), np.searchsorted(edges, v, "right"))
        assert r["c"] == min(r["b"] - 1, len(edges) - 2)


def test_no_row_is_multiplied_for_ranks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = [np.concatenate([rng.normal(size=900), [-1e308, 1e308]]), rng.integers(0, 9, 902).astype(float)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*values)], "x double, y double")
    ranks = list(range(0, 902, 9))
    want = HBOS(dynamic_bins=True, compat=False).fit(df, nbins=6).fitted["bins"]
    monkeypatch.setattr(intervals, "SMALL", 100)
    monkeypatch.setattr("tidewatch.operators.outlier.COMBINATIONS", 0)
    many = HBOS(dynamic_bins=True, compat=False).fit(df, nbins=6).fitted["bins"]
    monkeypatch.setattr("tidewatch.operators.outlier.COMBINATIONS", 100_000)
    exploded = []
    monkeypatch.setattr(F, "explode", lambda c, own=F.explode: exploded.append(c) or own(c))
    assert intervals.select_ranks(df, "x", ranks, 16) == dict(zip(ranks, np.sort(values[0])[ranks]))
    assert not exploded
    few = HBOS(dynamic_bins=True, compat=False).fit(df, nbins=6).fitted["bins"]
    for got in (many, few):
        for c in "xy":
            assert got[c][0] == pytest.approx(want[c][0]) and got[c][1] == pytest.approx(want[c][1])


def test_bins_follow_the_first_feature_of_any_kind(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 12, 400), rng.normal(size=400))]
    df = spark.createDataFrame(rows, "c int, x double")
    first = bin_counts(df, ["c"], "sturges")["c"]
    for model in (HBOS, SPAD):
        assert len(model().fit(df, ["c", "x"], ["c"], "sturges").fitted["bins"]["x"][1]) == first + 1
        own = bin_counts(df, ["x"], "sturges")["x"]
        assert len(model(compat=False).fit(df, ["c", "x"], ["c"], "sturges").fitted["bins"]["x"][1]) == own + 1
        text = df.selectExpr("cast(c AS string) AS c", "x")
        assert len(model().fit(text, ["c", "x"], ["c"], "sturges").fitted["bins"]["x"][1]) == own + 1


def test_residualizer_of_positive_correlations(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=300)
    x = np.stack([z, z + 0.1 * rng.normal(size=300), -z + 0.1 * rng.normal(size=300), rng.normal(size=300)], axis=1)
    names = list("abcd")
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names))
    corr = np.clip(np.corrcoef(x, rowvar=False), 0, None)
    order = np.argsort(-corr.sum(axis=1))
    np.fill_diagonal(corr, 0)
    want, done = {}, []
    for i in order:
        by = [j for j in range(4) if corr[i, j] >= 0.8 and j not in done]
        if by:
            want[names[i]] = {names[j] for j in by}
            done.append(i)
    got = FeatureResidualizer().fit(df, corr_type="pos")
    assert {c: set(b) for c, (_, b) in got.models.items()} == want and "c" not in want
    with pytest.raises(ValueError):
        FeatureResidualizer().fit(df, corr_type="all")


@pytest.mark.parametrize("method", ["auto", "stddev", "mad", "iqr", ("quantile", 0.1, None), (0.0, 1.0)])
def test_bounds_of_many_columns(spark, method, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), None if k % 7 == 0 else float(c), None) for k, (a, b, c) in enumerate(zip(rng.normal(10, 1, 500), rng.exponential(1, 500), rng.uniform(0, 1, 500)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for small in (intervals.SMALL, 100):
        monkeypatch.setattr(intervals, "SMALL", small)
        got = intervals.whole_bounds(df, list("abcd"), method)
        for c in "abc":
            b = intervals.interval(df, [], c, method).first()
            assert got[c] == pytest.approx((b["lower"], b["upper"]))
        assert method == (0.0, 1.0) or got["d"] == (None, None)


def test_stone_bins_are_numpys(spark):
    x = np.random.default_rng(4).normal(size=700)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    assert bin_counts(df, ["x"], "stone")["x"] == len(np.histogram_bin_edges(x, "stone")) - 1


def test_folds_are_linear_in_a_series(spark):
    n = 60_000
    df = spark.range(n).selectExpr("1 AS g", "id AS t", "cast(id % 97 AS double) AS y").repartition(4)
    began = time.time()
    last = series.hfi(df, ["g"], "t", "y", 0.4).orderBy("t").collect()
    assert len(last) == n and last[1]["hfi"] == pytest.approx(0.6)
    assert series.rsi(df, ["g"], "t", "y", 14).count() == n and time.time() - began < 60
    short = spark.createDataFrame([(1, 0, 5.0), (2, 0, 1.0), (2, 1, None)], "g int, t int, y double")
    assert sorted((r.g, r.t) for r in series.hfi(short, ["g"], "t", "y", 0.4).collect()) == [(1, 0), (2, 0), (2, 1)]
    assert series.rsi(short.limit(0), ["g"], "t", "y").count() == 0


def test_bootstrap_does_not_depend_on_partitioning(spark):
    df = spark.range(500).selectExpr("id", "cast(id * 7 % 31 AS double) AS x")
    first, second = (sorted(map(tuple, poisson_bootstrap(d, "id", "x", 20).collect())) for d in (df.repartition(1), df.repartition(5)))
    assert [r for r, _ in first] == [r for r, _ in second] and [m for _, m in first] == pytest.approx([m for _, m in second])

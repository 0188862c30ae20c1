from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import special
from tidewatch.operators import diagnostics, intervals, series, stats


@pytest.fixture(scope="module")
def y():
    return np.random.default_rng(5).normal(10, 3, 60).round(3)


@pytest.fixture(scope="module")
def df(spark, y):
    return spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(y)], "g string, t int, y double")


def column(frame, name, order="t"):
    return [r[name] for r in frame.orderBy(order).collect()]


def test_special_functions():
    assert special.t_sf(2.0, 10) == pytest.approx(0.036694, abs=1e-6)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.chi2_sf(3.84, 1) == pytest.approx(0.050044, abs=1e-6)
    assert special.hypergeom_sf(0, 10, 5, 3) == pytest.approx(1 - 10 / 120)
    assert special.t_test_power(0.5, 64, 64, 0.05) == pytest.approx(0.8015, abs=1e-3)
    assert special.t_test_size(0.5, 0.8, 0.05) == pytest.approx(63.77, abs=0.02)


def test_interval_methods(df, y):
    lo, hi = (intervals.interval(df, ["g"], "y", ("quantile", 0.1, 0.9)).first()[k] for k in ("lower", "upper"))
    assert (lo, hi) == (np.quantile(y, 0.1, method="lower"), np.quantile(y, 0.9, method="higher"))
    mad = intervals.interval(df, [], "y", "mad").first()
    m = np.median(y)
    assert mad["upper"] == pytest.approx(m + 3 * np.median(abs(y - m)))
    with pytest.raises(ValueError):
        intervals.interval(df, ["g"], "y", "stdev")


def test_constant_and_single(spark):
    one = spark.createDataFrame([("a", 0, 4.0), ("b", 0, 1.0), ("b", 1, 1.0)], "g string, t int, y double")
    got = {r["g"]: (r["method"], r["lower"], r["upper"]) for r in intervals.interval(one, ["g"], "y", "auto").collect()}
    assert got == {"a": ("iqr", 4.0, 4.0), "b": ("iqr", 1.0, 1.0)}
    assert stats.correlation(one.withColumn("z", F.lit(1.0)), ["y", "z"]).filter("a = 'z'").first()["corr"] is None


def test_folds(df, y):
    want = [y[0]]
    for v in y[1:]:
        want.append(0.4 * want[-1] + 0.6 * v)
    assert column(series.hfi(df, ["g"], "t", "y", 0.4), "hfi") == pytest.approx(want)
    w, d = 14, np.diff(y)
    up, down = d[: w + 1].clip(0).sum() / w, -d[: w + 1].clip(None, 0).sum() / w
    out = [100 - 100 / (1 + up / down)] * w
    for i in range(w, len(y)):
        up, down = (up * (w - 1) + max(d[i - 1], 0)) / w, (down * (w - 1) + max(-d[i - 1], 0)) / w
        out.append(100 - 100 / (1 + up / down))
    assert column(series.rsi(df, ["g"], "t", "y", w), "rsi") == pytest.approx(out)


def test_sample_entropy(df, y):
    tol, n = 0.2 * y.std(), len(y)
    a = b = 0
    for i in range(n):
        for j in range(i + 1, n):
            if j < n - 2 and max(abs(y[i] - y[j]), abs(y[i + 1] - y[j + 1])) < tol:
                b += 1
                a += j < n - 3 and abs(y[i + 2] - y[j + 2]) < tol
    got = series.sample_entropy(df, ["g"], "t", "y", m=2).first()
    assert got["sampen"] == (pytest.approx(-math.log(a / b)) if a and b else None)
    with pytest.raises(ValueError):
        series.sample_entropy(df, ["g"], "t", "y", tolerance=0.0)


def test_windows_and_errors(df, y):
    got = column(series.rolling_window(df, ["g"], "t", "y", 5, F.avg), "rolling")
    want = [y[max(0, k - 4) : k + 1].mean() if k >= 4 else y[:5].mean() for k in range(len(y))]
    assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        series.rolling_window(df, ["g"], "t", "y", 1, F.avg)
    with pytest.raises(ValueError):
        series.fourier_seasonality(df, "t", ["hourly"])
    with pytest.raises(ValueError):
        series.hpi(df, ["g"], "t", "y", 1.5)


def test_stability_edges(spark):
    pairs = spark.createDataFrame([("one", 0, 1.0, 2.0), ("flat", 0, 1.0, 1.0), ("flat", 1, 1.0, 1.0), ("inf", 0, 1.0, 1.0), ("inf", 1, 2.0, 1.0)], "g string, h int, a double, b double")
    train = spark.createDataFrame([(g, t, 5.0) for g in ("one", "flat", "inf") for t in range(4)], "g string, t int, y double")
    got = {r["g"]: r for r in series.stability(pairs, train, ["g"], "h", "a", "b", "t", "y").collect()}
    assert got["one"]["masch"] is None and got["flat"]["masch"] == 0.0 and got["inf"]["masch"] == math.inf


def test_decomposition_and_unit_root(spark):
    t = np.arange(120)
    x = 0.1 * t + 5 * np.sin(2 * np.pi * t / 12)
    trend, seasons, resid = diagnostics.mstl(x, [12])
    assert np.abs(trend + sum(seasons) + resid - x).max() < 1e-9
    assert np.abs(resid[12:-12]).max() < 0.5
    noise = np.random.default_rng(1).normal(size=200)
    assert diagnostics.adf(noise)[1] < 0.01 < 0.3 < diagnostics.adf(noise.cumsum() + 0.3 * np.arange(200))[1] + 0.3
    assert diagnostics.pacf(noise, 5)[0] == 1.0


def test_bootstrap_repeats(spark):
    rows = spark.createDataFrame([("a", k, float(k % 7)) for k in range(40)], "g string, t int, y double")
    one, two = (stats.BootstrapBCA().compute_interval(rows, ["g"], "y", n_resamples=200, order="t").first() for _ in range(2))
    assert one == two and one["lower"] < 2.9 < one["upper"]


def test_ranks_without_sorting(spark, monkeypatch):
    x = np.round(np.random.default_rng(8).normal(size=3000), 2)
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    want = np.sort(x)
    assert intervals.select_ranks(rows, "x", [0, 17, 1500, 2999], bins=8) == {k: want[k] for k in (0, 17, 1500, 2999)}
    monkeypatch.setattr(intervals, "SMALL", 10)
    assert intervals.exact_quantiles(rows, "x", [0.25, 0.5, 0.999]) == pytest.approx(np.quantile(x, [0.25, 0.5, 0.999]).tolist())
    got = intervals.interval(rows, [], "x", "mad").first()
    assert got["upper"] == pytest.approx(np.median(x) + 3 * np.median(abs(x - np.median(x))))
    assert intervals.interval(rows.limit(0), [], "x", "auto").count() == 0

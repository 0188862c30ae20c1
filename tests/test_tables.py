from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluation, modelling, outlier
from tidewatch.operators.basket import TransactionAnalyzer, TransactionEncoder


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).round(4)
    x[:, 2] = (x[:, 0] * 2 + 0.1 * x[:, 2]).round(4)
    return x


@pytest.fixture(scope="module")
def df(spark, matrix):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(matrix)], "id int, a double, b double, c double")


def test_known_densities(spark):
    model = outlier.HBOS()
    model.fitted = {"features": ["x"], "bins": {"x": ([6.25, 0, 6.25, 0, 12.5], [0.1, 0.14, 0.18, 0.22, 0.26, 0.3])}, "categories": {}}
    rows = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.3,)], "x double")
    got = [r["score"] for r in model.decision_function(rows).collect()]
    assert got == pytest.approx([-math.log(d + 1e-9) for d in (6.25, 6.25, 12.5, 12.5)])


@pytest.mark.parametrize("rule", outlier.STRATEGIES)
def test_bin_rules_match_numpy(df, matrix, rule):
    assert outlier.bin_counts(df, ["a"], rule)["a"] == len(np.histogram_bin_edges(matrix[:, 0], rule)) - 1


def test_hbos_against_numpy(df, matrix):
    got = np.array([r["score"] for r in outlier.HBOS().fit(df, ["a", "b"], nbins=7).decision_function(df).orderBy("id").collect()])
    want = np.zeros(len(matrix))
    for i in (0, 1):
        d, e = np.histogram(matrix[:, i], bins=7, density=True)
        want += -np.log(d[np.clip(np.digitize(matrix[:, i], e, right=True) - 1, 0, 6)] + 1e-9)
    assert np.abs(got - want).max() < 1e-9


def test_spad_against_numpy(df, matrix):
    got = np.array([r["score"] for r in outlier.SPAD().fit(df, ["a"], nbins=6, method="stddev").decision_function(df).orderBy("id").collect()])
    x = matrix[:, 0]
    e = np.linspace(x.mean() - 3 * x.std(), x.mean() + 3 * x.std(), 7)
    at = np.digitize(x, e, right=True)
    _, n = np.unique(at, return_counts=True)
    p = (n + 1) / (n.sum() + len(n))
    assert np.abs(got + np.log(p[np.clip(at - 1, 0, len(p) - 1)] + 1e-9)).max() < 1e-9


def test_unfitted_and_plus(df):
    for model in (outlier.HBOS(), outlier.SPAD(), outlier.PCAReconstructionError()):
        with pytest.raises(ValueError):
            model.predict(df)
    plus = outlier.SPAD(plus=True).fit(df, ["a", "b", "c"], nbins=5)
    assert len(plus.fitted["features"]) == 6
    assert plus.predict(df).filter("outlier").count() <= 3


def test_pca_error_against_numpy(df, matrix):
    got = np.array([r["score"] for r in outlier.PCAReconstructionError().fit(df, ["a", "b", "c"], 1).decision_function(df).orderBy("id").collect()])
    z = matrix - matrix.mean(0)
    v = np.linalg.svd(z)[2][:1]
    assert np.abs(got - ((z - z @ v.T @ v) ** 2).sum(1)).max() < 1e-8


def test_vif_and_residuals(df, matrix):
    kept, _ = modelling.filter_features_by_vif(df, ["a", "b", "c"], 5.0)
    assert len(kept) == 2 and "b" in kept
    out = modelling.FeatureResidualizer().fit(df, ["a", "b", "c"]).transform(df)
    cols = [c for c in "abc" if out.agg(F.abs(F.avg(c))).first()[0] < 1e-9]
    assert len(cols) == 1
    with pytest.raises(ValueError):
        modelling.filter_features_by_vif(df, ["a"], 5.0)


@pytest.mark.parametrize("held", [10_000, 2, 1])
def test_rows_of_a_frequent_category_are_not_shuffled_to_one_task(spark, held, monkeypatch):
    monkeypatch.setattr(outlier, "HELD", held)
    day = [dt.datetime(2024, 3, 31, k) for k in range(4)]
    rows = [(k, "a", day[0]) for k in range(90)] + [(90, "b", day[1]), (91, "b", day[2]), (92, "c", day[3]), (93, None, None)]
    df = spark.createDataFrame(rows, "id int, c string, t timestamp").repartition(4)
    new = df.unionByName(spark.createDataFrame([(94, "zz", None)], df.schema))
    model = outlier.HBOS().fit(df, ["c", "t"], ["c", "t"])
    counted, rest = model.fitted["categories"]["c"]
    assert (rest is None) == (held >= 3) and counted.count() + (rest.count() if rest else 0) == 3
    scored = model.decision_function(new)
    assert scored.columns == ["id", "c", "t", "score"]
    p = lambda n, k: -math.log((n + 1) / (93 + k) + 1e-9)
    none = -math.log(2e-9)
    want = {k: p(90, 3) + p(90, 4) for k in range(90)} | {90: p(2, 3) + p(1, 4), 91: p(2, 3) + p(1, 4), 92: p(1, 3) + p(1, 4), 93: 2 * none, 94: 2 * none}
    assert {r.id: r.score for r in scored.collect()} == pytest.approx(want)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = model.decision_function(new)
        sizes = plan.select(F.spark_partition_id().alias("p"), "c").filter("c = 'a'").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 60


def test_scores_equal_in_the_digits_asked_for_are_no_outliers(spark):
    rows = spark.createDataFrame([(0.0,)] * 20000 + [(1.0,)] * 20001 + [(2.0,)] * 20002, "x double")
    model = outlier.HBOS().fit(rows, nbins=3)
    assert model.predict(rows, 0.5).filter("outlier").count() == 20000  # scores differ by 5e-5
    assert model.predict(rows, 0.5, digits=3).filter("outlier").count() == 0
    assert model.predict(rows.limit(0), 0.5, digits=3).count() == 0


@pytest.mark.parametrize("power", ["yeo-johnson", "box-cox", None])
def test_scaler(spark, power):
    rows = spark.createDataFrame([(float(np.exp(v)),) for v in np.random.default_rng(0).normal(size=400)], "x double")
    out = modelling.RobustGaussianScaler().fit(rows, ["x"], "mad", power).transform(rows)
    m = out.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.skewness("x").alias("g")).first()
    assert abs(m["m"]) < 1e-6 and m["s"] == pytest.approx(1.0)
    assert power is None or abs(m["g"]) < 0.3


BASKETS = [["milk", "bread", "butter"], ["beer", "diapers", "bread"], ["milk", "beer", "diapers"], ["bread", "butter", "butter"]]


def test_baskets(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(BASKETS)), "tx int, items array<string>")
    model = TransactionAnalyzer().fit(df, "tx", "items")
    assert model.lift("beer", "diapers") == 2.0 and model.confidence("bread", "butter") == pytest.approx(2 / 3)
    assert model.yules_q("beer", "diapers") is None  # nothing off the diagonal
    assert model.hypergeom("beer", "diapers") == pytest.approx(1 / 6)
    with pytest.raises(KeyError):
        model.lift("beer", "caviar")
    with pytest.raises(ValueError):
        model.correlation_matrix(["beer"], ["milk"], "phi")
    with pytest.raises(ValueError):
        TransactionAnalyzer().transform()
    model.save(str(tmp_path / "m"))
    assert TransactionAnalyzer.load(spark, str(tmp_path / "m")).lift("beer", "diapers") == 2.0
    wide = model.correlation_matrix(["milk", "beer"], ["milk", "bread"], wide=True)
    assert wide.columns == ["a", "bread", "milk"] and [r["a"] for r in wide.collect()] == ["beer", "milk"]
    enc = TransactionEncoder()
    dense = enc.fit_transform(df, tx_col="tx", items_col="items")
    assert {r["tx"]: r["items"] for r in enc.inverse_transform(dense).collect()} == {k: sorted(set(b)) for k, b in enumerate(BASKETS)}
    with pytest.raises(KeyError):
        enc.transform(spark.createDataFrame([(9, ["caviar"])], "tx int, items array<string>"), "tx", "items")


def test_evaluation(spark):
    rows = spark.createDataFrame([(k % 2, k / 20, int(k > 10)) for k in range(20)], "y int, p double, q int")
    cells = {r["cell"]: (r["n"], r["percentage"]) for r in evaluation.confusion_matrix(rows, "y", "q").collect()}
    assert cells == {"FN": (5, 50.0), "TN": (6, 60.0), "TP": (5, 50.0), "FP": (4, 40.0)}
    assert evaluation.reliability_curve(rows, "y", "p", 4).agg(F.sum("n")).first()[0] == 20
    assert evaluation.power_curve(spark, 0.8).first()["n_required"] == 26
    with pytest.raises(ValueError):
        evaluation.beta_confidence_analysis(spark, 0, 1)
    with pytest.raises(ValueError):
        evaluation.power_curve(spark, -1)

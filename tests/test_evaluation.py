import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantgauge.functions import vectors
from plantgauge.functions.columns import wilson
from plantgauge.operators import evaluation


def wilson_of(spark, count, n):
    df = spark.createDataFrame([(count, n)], "c long, n long")
    w = wilson(F.col("c"), F.col("n"))
    return tuple(df.select(w["rate"], w["low"], w["high"]).first())


def test_wilson(spark):
    assert wilson_of(spark, 0, 0) == (0.0, 0.0, 0.0)
    rate, low, high = wilson_of(spark, 0, 100)
    assert rate == low == 0.0 and 0 < high < 0.05
    rate, low, high = wilson_of(spark, 100, 100)
    assert rate == high == 1.0 and 0.95 < low < 1
    _, low, high = wilson_of(spark, 50, 100)
    assert low == pytest.approx(1 - high) and low < 0.5 < high


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.RandomState(2)
    y = (rng.rand(400) < 0.4).astype(int)
    p = np.round(np.clip(0.3 * y + 0.7 * rng.rand(400), 0, 1), 2)  # many ties
    p[:5] = 1.0
    pdf = pd.DataFrame({"actual": y, "p": p})
    return spark.createDataFrame(pdf), pdf


def test_areas(scores):
    df, pdf = scores
    row = evaluation.areas(evaluation.score_steps(df, score="p")).first()
    pos, neg = pdf[pdf.actual == 1].p.values, pdf[pdf.actual == 0].p.values
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert row["roc_auc"] == pytest.approx(auc)
    recall, precision = [0.0], [1.0]
    for t in sorted(set(pdf.p), reverse=True):
        called = pdf[pdf.p >= t]
        recall.append(called.actual.sum() / len(pos))
        precision.append(called.actual.mean())
    assert row["pr_auc"] == pytest.approx(np.trapezoid(precision, recall))


def test_strided_curve(scores):
    df, _ = scores
    curve = evaluation.roc_curve(evaluation.score_steps(df, score="p"), score="p")
    few = evaluation.strided(curve, 10).orderBy("step").collect()
    assert few[0]["step"] == 1 and few[1]["step"] == 1 + few[0]["steps"] // 10


@pytest.mark.parametrize("n, low, high", [(200, 0.01, 0.99), (50, 0.5, 0.99), (11, 0.0, 1.0)])
def test_thresholds_passed_is_exact(spark, n, low, high):
    grid = np.linspace(low, high, n)
    step = (high - low) / (n - 1)
    ours = [high if i == n - 1 else low + i * step for i in range(n)]
    values = sorted({v for g in ours for v in (g, np.nextafter(g, 0), np.nextafter(g, 2))} | {-1.0, 0.0, 0.3, 2.0})
    assert np.allclose(grid, ours)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r[0] for r in df.select(evaluation.thresholds_passed(F.col("v"), low, high, n)).collect()]
    assert got == [sum(t <= v for t in ours) for v in values]


def test_cost_curve_and_best(scores):
    df, pdf = scores
    curve = evaluation.cost_curve(df, 41.72, 208.6).toPandas().sort_values("threshold")
    assert len(curve) == 200
    for _, r in curve.iloc[::23].iterrows():
        frr = ((pdf.actual == 0) & (pdf.p >= r.threshold)).sum() / (pdf.actual == 0).sum()
        far = ((pdf.actual == 1) & (pdf.p < r.threshold)).sum() / (pdf.actual == 1).sum()
        assert r.frr == pytest.approx(frr) and r.far == pytest.approx(far)
        assert r.cost_per_1000 == pytest.approx(1000 * (41.72 * 0.9 * frr + 208.6 * 0.1 * far))
    best = evaluation.best_threshold(evaluation.cost_curve(df, 41.72, 208.6)).first()
    assert best["expected_cost_per_1000"] == pytest.approx(curve.cost_per_1000.min()) and 0.01 <= best["optimal_threshold"] <= 0.99


def test_groups_do_not_mix(spark, scores):
    df, _ = scores
    two = df.withColumn("m", F.lit("a")).unionByName(df.withColumns({"m": F.lit("b"), "p": 1 - F.col("p")}))
    got = {r["m"]: r["roc_auc"] for r in evaluation.areas(evaluation.score_steps(two, ["m"], "p"), ["m"]).collect()}
    alone = evaluation.areas(evaluation.score_steps(df, score="p")).first()["roc_auc"]
    assert got["a"] == pytest.approx(alone) and got["b"] == pytest.approx(1 - alone)
    curve = evaluation.cost_curve(two, 1.0, 5.0, by=["m"])
    assert curve.groupBy("m").count().collect()[0]["count"] == 200
    assert evaluation.best_threshold(curve, ["m"]).count() == 2


def test_ece(spark):
    sure = spark.createDataFrame([(0.9, 1), (0.95, 1), (0.8, 1), (1.0, 1), (0.99, 1)], "confidence double, correct int")
    bins = evaluation.ece_bins(sure).orderBy("bin").collect()
    assert len(bins) == 10 and bins[9]["count"] == 4 and bins[0]["confidence"] == pytest.approx(0.05)
    assert 0 <= evaluation.ece(evaluation.ece_bins(sure)).first()["ece"] <= 1
    open_end = evaluation.ece_bins(sure, last_closed=False).orderBy("bin").collect()
    assert open_end[9]["count"] == 3 and open_end[9]["fraction"] == pytest.approx(3 / 5)


def test_bin_edges_follow_the_grid(spark):
    edges = [float(v) for v in np.linspace(0, 1, 11)]
    df = spark.createDataFrame([(v,) for v in edges + [0.3]], "c double")
    got = [r[0] for r in df.select(evaluation._bin(F.col("c"), 10)).collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 2]


def test_coverage_does_not_increase(spark):
    df = spark.createDataFrame([(0.55, 1), (0.7, 0), (0.9, 1), (0.98, 1), (0.6, 0)], "confidence double, correct int")
    rows = evaluation.coverage_curve(df).orderBy("threshold").collect()
    cover = [r["coverage"] for r in rows]
    assert len(rows) == 50 and cover == sorted(cover, reverse=True) and cover[0] == 1.0 and rows[-1]["accuracy"] == 1.0
    s = evaluation.selective_metrics(df).first()
    assert (s["uncertain_count"], s["confident_count"]) == (2, 3) and s["confident_accuracy"] == pytest.approx(2 / 3)


def test_more_are_uncertain_at_a_higher_threshold(scores):
    df, _ = scores
    rows = df.select(F.greatest("p", 1 - F.col("p")).alias("confidence"), F.lit(1).alias("correct"))
    counts = [evaluation.selective_metrics(rows, t).first()["uncertain_count"] for t in (0.55, 0.7, 0.9)]
    assert counts == sorted(counts)


def test_temperature(spark):
    rng = np.random.RandomState(0)
    logits = rng.normal(size=(600, 3))
    probs = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    y = [int(rng.choice(3, p=p)) for p in probs]
    rows = [([float(v) * 3.0 for v in z], t) for z, t in zip(logits, y)]
    df = spark.createDataFrame(rows, "logits array<double>, target int")
    assert evaluation.fit_temperature(df) == pytest.approx(3.0, rel=0.25)
    p = df.select(vectors.softmax(F.col("logits"), 3.0).alias("p")).toPandas()["p"]
    assert np.allclose([sum(v) for v in p], 1.0) and np.allclose(np.array(p.tolist()), probs)
    assert evaluation.fit_temperature(df.limit(0)) == 1.0


def test_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (1, 1)], "actual int, predicted int")
    r = evaluation.binary_rates(evaluation.confusion_counts(df)).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (1, 1, 1, 2) and r["precision"] == pytest.approx(2 / 3)
    none = evaluation.binary_rates(evaluation.confusion_counts(df.where("actual = 0 AND predicted = 0"))).first()
    assert none["precision"] == none["recall"] == none["f1"] == none["far"] == 0.0 and none["accuracy"] == 1.0


def test_multiclass(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "actual string, predicted string")
    rows = {r["class"]: r for r in evaluation.per_class_metrics(evaluation.confusion_matrix(df)).collect()}
    assert rows["b"]["precision"] == pytest.approx(1 / 3) and rows["c"]["f1"] == 0.0 and rows["a"]["recall"] == 0.5
    m = evaluation.macro_metrics(evaluation.per_class_metrics(evaluation.confusion_matrix(df))).first()
    assert m["accuracy"] == 0.5 and m["n"] == 4


def test_before_after(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "condition string, accuracy double, f1_macro double, frr double, far double, mean_confidence double")

    before = frame([("a", 0.90, 0.90, 0.1, 0.1, 0.8), ("b", 0.9, 0.9, 0.1, 0.1, 0.8), ("c", 0.9, 0.9, 0.1, 0.1, 0.8)])
    after = frame([("a", 0.95, 0.80, 0.1, 0.1, 0.8), ("b", 0.8, 0.9, 0.1, 0.1, 0.8), ("c", 0.901, 0.9, 0.1, 0.1, 0.8)])
    got = {r["condition"]: r["status"] for r in evaluation.before_after(before, after).collect()}
    assert got == {"a": "Improved", "b": "Degraded", "c": "Unchanged"}

"""Leave-one-batch-out fits against refits, attributions against all subsets."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

from plantgauge.operators import attribution, margin_model

NAMES = ["a", "b", "c"]


def data(seed, batches=6):
    rng = random.Random(seed)
    out = []
    for k in range(batches):
        for _ in range(rng.randint(3, 30)):
            a, b = rng.gauss(k, 2), rng.gauss(1000, 1)
            out.append((f"B{k}", a, b, 5.0, 3 * a - 2 * b + rng.gauss(0, 1) + 1e5))
    return out


def refit(rows, ridge):
    x = np.array([r[1:4] for r in rows])
    y = np.array([r[4] for r in rows])
    mean, spread = x.mean(axis=0), x.std(axis=0)
    used = spread > 1e-9
    z = (x[:, used] - mean[used]) / spread[used]
    w = np.zeros(3)
    w[used] = np.linalg.solve(z.T @ z / len(y) + ridge * np.eye(used.sum()), z.T @ (y - y.mean()) / len(y)) / spread[used]
    return w, y.mean() - w @ mean


@pytest.mark.parametrize("ridge", [0.1, 1.0])
def test_folds_equal_refits(spark, ridge):
    rows = data(1)
    df = spark.createDataFrame(rows + [("B0", None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)], "batch_id string, a double, b double, c double, y double")
    out = {r["batch_id"]: r for r in margin_model.leave_one_out(df, "batch_id", NAMES, "y", ridge).collect()}
    assert len(out) == 6
    for key, r in out.items():
        w, c = refit([x for x in rows if x[0] != key], ridge)
        own = [x for x in rows if x[0] == key]
        errors = np.array([x[4] - c - w @ np.array(x[1:4]) for x in own])
        assert r["n"] == len(own)
        assert r["weights"] == pytest.approx(w, rel=1e-6, abs=1e-9)
        assert r["rmse"] == pytest.approx(math.sqrt((errors**2).mean()), rel=1e-6)
        assert r["actual"] - r["predicted"] == pytest.approx(errors.mean(), rel=1e-6, abs=1e-6)
    summary = margin_model.fold_summary(spark.createDataFrame(list(out.values()))).first()
    y = np.array([x[4] for x in rows])
    sse = sum(r["sse"] for r in out.values())
    assert summary["r_squared"] == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum())


def test_single_key_and_empty(spark):
    df = spark.createDataFrame([("B0", 1.0, 2.0, 3.0, 4.0), ("B0", 2.0, 2.0, 1.0, 5.0)], "batch_id string, a double, b double, c double, y double")
    r = margin_model.leave_one_out(df, "batch_id", NAMES, "y").first()
    assert r["predicted"] is None and r["rmse"] is None and r["weights"] is None and r["actual"] == 4.5
    assert margin_model.fold_summary(margin_model.leave_one_out(df, "batch_id", NAMES, "y")).collect() == []
    assert margin_model.leave_one_out(df.where("false"), "batch_id", NAMES, "y").collect() == []


def tree_value(leaves, x, known):
    """The model's output with the features of ``known`` given."""
    out = 0.0
    for leaf in leaves:
        p = leaf.value
        for f, (a, b, share) in leaf.sides.items():
            p *= (a < x[f] <= b) if f in known else share
        out += p
    return out


def brute(leaves, x, n):
    out = []
    for f in range(n):
        others = [g for g in range(n) if g != f]
        total = 0.0
        for k in range(n):
            for s in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
                total += w * (tree_value(leaves, x, {*s, f}) - tree_value(leaves, x, set(s)))
        out.append(total)
    return out


@pytest.mark.parametrize("make", [
    lambda: GBTRegressor(labelCol="y", maxDepth=4, maxIter=5, seed=1), lambda: RandomForestRegressor(labelCol="y", maxDepth=5, numTrees=4, seed=1),
    lambda: DecisionTreeRegressor(labelCol="y", maxDepth=5, seed=1),
])
def test_attributions(spark, make):
    rng = random.Random(2)
    rows = [(*(rng.gauss(0, 1) for _ in range(4)),) for _ in range(300)]
    rows = [(*x, 3 * (x[0] > 0) * (x[1] > 0) + x[2] + 0.1 * rng.gauss(0, 1)) for x in rows]
    names = ["f0", "f1", "f2", "f3"]
    df = VectorAssembler(inputCols=names, outputCol="features").transform(spark.createDataFrame(rows, [*names, "y"]))
    model = make().fit(df)
    leaves = attribution.model_leaves(spark, model)
    out = attribution.attributed(model.transform(df), names, model).collect()
    for r in out:
        assert r["base"] + sum(r["attributions"]) == pytest.approx(r["prediction"])
    for r in out[:25]:
        assert r["attributions"] == pytest.approx(brute(leaves, [r[n] for n in names], 4), abs=1e-9)


def test_attributions_of_a_constant_and_of_nulls(spark):
    names = ["f0", "f1"]
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 3.0, 5.0)], [*names, "y"])
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    model = DecisionTreeRegressor(labelCol="y").fit(assembled)
    more = spark.createDataFrame([(1.0, None), (1.0, 1.0)], "f0 double, f1 double")
    out = attribution.attributed(more, names, model).collect()
    assert out[0]["attributions"] is None and out[1]["attributions"] == [0.0, 0.0] and out[1]["base"] == 5.0
    assert attribution.attributed(more.where("false"), names, model).collect() == []

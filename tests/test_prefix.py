import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantgauge.operators import prefix


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows, one value most of that key."""
    rng = random.Random(1)
    rows = [("hot", 0.0) for _ in range(900)] + [("hot", rng.random()) for _ in range(600)]
    rows += [(f"k{i % 7}", rng.choice([0.25, 0.5, rng.random()])) for i in range(300)] + [("null", None)]
    pdf = pd.DataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], columns=["i", "k", "v"])
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "i int, k string, v double"), pdf


@pytest.mark.parametrize("small_group", [20_000, 10])
def test_percentiles_match_numpy(hot, monkeypatch, small_group):
    df, pdf = hot
    monkeypatch.setattr(prefix, "SMALL_GROUP", small_group)
    levels = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = prefix.percentiles(df, ["k"], "v", levels).toPandas().set_index("k")
    for k, g in pdf.dropna().groupby("k"):
        # a bracket is only used for groups far larger than these, so compare the hot one
        if small_group == 20_000 or k == "hot":
            for name, p in levels.items():
                assert got.loc[k, name] == pytest.approx(np.percentile(g["v"], p * 100), abs=1e-12)


def test_medians_by_bracket(spark, monkeypatch):
    rng = np.random.RandomState(3)
    pdf = pd.DataFrame({"a": rng.normal(size=5000), "b": np.where(rng.rand(5000) < 0.4, 7.0, rng.rand(5000))})
    df = spark.createDataFrame(pdf).withColumn("c", F.lit(None).cast("double"))
    monkeypatch.setattr(prefix, "SMALL_GROUP", 100)
    got = prefix.medians(df, ["a", "b", "c"])
    assert got["a"] == pytest.approx(pdf["a"].median()) and got["b"] == pytest.approx(pdf["b"].median())
    assert got["c"] is None


@pytest.mark.parametrize("bounded", [True, False])
def test_mid_ranks_match_pandas(hot, bounded):
    df, pdf = hot
    got = prefix.mid_ranks(df, ["k"], "v", bounded=bounded).toPandas()
    want = pdf.dropna().assign(rank=lambda d: d.groupby("k")["v"].rank())[["k", "v", "rank"]].drop_duplicates()
    both = got.merge(want, on=["k", "v"], suffixes=("", "_w"))
    assert len(both) == len(got) == len(want) and (both["rank"] == both["rank_w"]).all()


def test_running_sums_and_totals(hot):
    df, pdf = hot
    got = prefix.running(df, ["k"], ["i"], {"n": F.lit(1)}).toPandas().sort_values("i")
    want = pdf.groupby("k").cumcount()
    assert (got["before_n"].values == want.values).all()
    assert (got["total_n"].values == pdf.groupby("k")["i"].transform("count").values).all()


def test_numbering_without_keys(hot):
    df, pdf = hot
    got = prefix.numbered(df, [], ["i"]).toPandas().sort_values("i")
    assert list(got["row_index"]) == list(range(len(pdf))) and set(got["total_rows"]) == {len(pdf)}


def test_null_keys_survive(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, i int")
    got = prefix.running(df, ["k"], ["i"], {"s": "i"}).orderBy("i").collect()
    assert [(r["before_s"], r["total_s"]) for r in got] == [(0, 3), (1, 3), (0, 3)]


@pytest.mark.parametrize("gaps", [lambda i: i < 30, lambda i: i % 3 > 0, lambda i: i > 20, lambda i: True, lambda i: False])
def test_fill_matches_pandas(spark, gaps):
    s = pd.Series([None if gaps(i) else f"t{i:03d}" for i in range(100)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(s)], "i int, t string")
    got = prefix.filled(df, ["i"], "t", "end").toPandas().sort_values("i")["t"]
    want = s.ffill().bfill().fillna("end")
    assert list(got) == list(want)

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantgauge.functions.tails import t_two_sided, u_two_sided
from plantgauge.operators import association, batch

BATCHES = 20


def toy(spark, n=BATCHES):
    """x follows the defect rate, flat is constant, gappy has holes, noise is unrelated."""
    rng = np.random.RandomState(5)
    rows = []
    for i in range(n):
        rate = (i % 10) / 20.0 + i / 1000.0
        rows.append((f"B{i:03d}", rate, 2.0 * rate + 1.0, 5.0, None if i % 4 == 0 else float(-i), float(rng.rand()), rate / 2, 0.0))
    return spark.createDataFrame(
        rows, "batch_id string, defect_rate double, x double, flat double, gappy double, noise double, `rate_crack` double, `rate_none` double"
    )


def test_bh_example(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.20)], "t string, p double")
    q = {r["t"]: r["q"] for r in association.benjamini_hochberg(df, "p", [], ["t"]).collect()}
    assert [round(q[k], 4) for k in "abcd"] == [0.04, 0.0533, 0.0533, 0.20]
    one = association.benjamini_hochberg(df.limit(1), "p", [], ["t"]).first()
    assert one["q"] == one["p"]
    assert association.benjamini_hochberg(df.limit(0), "p", [], ["t"]).count() == 0


def test_t_tail(spark):
    n, rho = 20, 0.623
    t = rho * ((n - 2) / (1 - rho * rho)) ** 0.5
    df = spark.createDataFrame([(2.086, 20), (t, 18), (0.0, 5), (float("inf"), 5)], "t double, d int")
    p = [r[0] for r in df.select(t_two_sided(F.col("t"), F.col("d"))).collect()]
    assert p[0] == pytest.approx(0.05, abs=2e-5) and round(p[1], 4) == 0.0033 and p[2:] == [1.0, 0.0]


def test_u_tail_exact_and_normal(spark):
    df = spark.createDataFrame(
        [(9.0, 3, 3, 0.0), (4.5, 3, 3, 0.0), (62.0, 10, 10, 0.0), (5.0, 1, 9, 0.0), (50.0, 10, 10, 19.0 * 20 * 21)],
        "u double, a int, b int, ties double",
    )
    p = [r[0] for r in df.select(u_two_sided(*[F.col(c) for c in ("u", "a", "b", "ties")])).collect()]
    assert p[0] == pytest.approx(2 / 20) and p[1] == 1.0 and p[2] == pytest.approx(0.38467, abs=1e-5)
    assert p[3] == 1.0 and p[4] == 1.0


def by_parameter(df):
    return {r["parameter"]: r for r in df.collect()}


def test_factor_report(spark):
    rows = by_parameter(association.analyze_factors(toy(spark), n_boot=50))
    assert set(rows) == {"x", "gappy", "noise"}  # a constant parameter has no row
    x = rows["x"]
    assert x["spearman_rho"] == 1.0 and x["spearman_p_value"] == 0.0 and x["is_significant"] and x["evidence_label"] == "Strong"
    assert x["rank"] == 1 and x["ci_low"] == x["ci_high"] == 1.0 and x["sample_warning"] is None
    assert rows["noise"]["evidence_label"] == "not significant"


def test_statistics_against_pandas(spark):
    table = toy(spark)
    pdf = table.toPandas()
    rows = by_parameter(association.factor_statistics(association.overall_pairs(table)))
    for name in ("gappy", "noise"):
        d = pdf[[name, "defect_rate"]].dropna()
        assert rows[name]["n"] == len(d)
        rho = d[name].rank().corr(d["defect_rate"].rank())
        assert rows[name]["rho"] == pytest.approx(rho)
        high, low = d[d[name] > d[name].median()]["defect_rate"], d[d[name] <= d[name].median()]["defect_rate"]
        assert rows[name]["delta"] == pytest.approx(high.mean() - low.mean())
        u = sum((h > low).sum() + 0.5 * (h == low).sum() for h in high)
        assert rows[name]["u"] == pytest.approx(u)


@pytest.mark.parametrize("family", [False, True])
def test_distributed_way_equals_the_windowed_way(spark, family):
    make = association.family_pairs if family else association.overall_pairs
    p = make(toy(spark))
    far = association.Pairs(p.df, p.keys, p.n_batches, bounded=False)

    def table(f):
        return f.toPandas().sort_values(p.keys).reset_index(drop=True)

    pd.testing.assert_frame_equal(
        table(association.factor_statistics(p)), table(association.factor_statistics(far)), check_dtype=False, rtol=1e-9
    )
    pd.testing.assert_frame_equal(
        table(association.bootstrap_rho(p, 20)), table(association.bootstrap_rho(far, 20)), check_dtype=False
    )


def test_few_batches(spark):
    assert association.analyze_factors(toy(spark, 2), n_boot=10).count() == 0
    two = association.bootstrap_rho(association.overall_pairs(toy(spark, 2), ["x"]), 10).first()
    assert (two["ci_low"], two["ci_high"]) == (-1.0, 1.0)
    four = by_parameter(association.analyze_factors(toy(spark, 4), n_boot=10))
    assert "Very small sample" in four["x"]["sample_warning"]


def test_families(spark):
    rows = association.analyze_families(toy(spark), n_boot=20).collect()
    assert {r["family"] for r in rows} == {"crack"}  # a family without variation is left out
    top = [r for r in rows if r["position"] == 1]
    assert top[0]["parameter"] == "x" and top[0]["evidence_label"] == "Strong" and top[0]["adj_p"] == 0.0


def test_batch_table_and_outliers(spark):
    insp = spark.createDataFrame(
        [("u1", "B1", "Beta", "fail", " crack "), ("u2", "B1", "Alpha", "pass", "None"), ("u3", "B2", "Alpha", "ng", "hole"),
         ("u4", "B2", None, "ok", None), (None, "B2", "Beta", "ok", "good")],
        "unit_id string, batch_id string, variant string, label string, defect_category string",
    )
    proc = spark.createDataFrame([("B1", 1.0), ("B1", 3.0), ("B9", 9.0)], "batch_id string, temperature double")
    rows = {r["batch_id"]: r for r in batch.batch_table(insp, proc).collect()}
    assert rows["B1"]["rate_crack"] == 0.5 and rows["B2"]["count_hole"] == 1 and rows["B2"]["rate_crack"] == 0.0
    assert rows["B1"]["dominant_variant"] == "Alpha" and rows["B1"]["temperature"] == 2.0 and rows["B2"]["temperature"] is None
    assert rows["B2"]["total_inspected"] == 3
    assert {r["batch_id"]: r["total_units"] for r in batch.batch_quality(insp).collect()} == {"B1": 2, "B2": 2}
    table = spark.createDataFrame([(f"B{i}", 0.1, 100.0 if i == 9 else 1.0) for i in range(10)], "batch_id string, defect_rate double, heat double")
    assert [r["batch_id"] for r in batch.outlier_batches(table).collect()] == ["B9"]
    assert batch.parameter_columns(table) == ["heat"]


def test_bootstrap_ways_agree(spark, monkeypatch):
    """Sent pairs and joined draws give the same ranges, with ties, gaps and constant keys."""
    rng = np.random.default_rng(3)
    rows = [(f"B{i:03d}", k, float(rng.integers(0, 9)), float(rng.integers(0, 4)) if k != "flat" else 1.0) for i in range(40) for k in ("a", "b", "flat")]
    rows = [r for i, r in enumerate(rows) if i % 7] + [("B1", "few", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "batch_id string, parameter string, x double, y double")
    p = association.Pairs(df, ["parameter"], 40, True)
    one = {r["parameter"]: (r["n"], r["ci_low"], r["ci_high"]) for r in association.bootstrap_rho(p, 60).collect()}
    monkeypatch.setattr(association, "BROADCAST_ROWS", 0)
    two = {r["parameter"]: (r["n"], r["ci_low"], r["ci_high"]) for r in association.bootstrap_rho(p, 60).collect()}
    assert one == two and one["few"] == (1, -1.0, 1.0) and one["a"][1] < one["a"][2]


def test_many_pairs_are_not_joined_per_draw(spark, monkeypatch):
    """However many pairs there are, a bounded key is resampled in arrays, in several chunks."""
    monkeypatch.setattr(association, "TASK_PAIRS", 30)
    monkeypatch.setattr(association, "_resampled_by_joins", None)
    monkeypatch.setattr(association, "BROADCAST_ROWS", 4)  # there are 4 keys and 80 pairs
    rng = np.random.default_rng(4)
    rows = [(f"B{i:03d}", k, float(rng.integers(0, 9)), float(rng.integers(0, 4))) for i in range(20) for k in "abcd"]
    df = spark.createDataFrame(rows, "batch_id string, parameter string, x double, y double")
    found = {r["parameter"]: r for r in association.bootstrap_rho(association.Pairs(df, ["parameter"], 20, True), 50).collect()}
    assert set(found) == set("abcd") and all(r["ci_low"] < r["ci_high"] for r in found.values())

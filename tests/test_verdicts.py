import pytest
from pyspark.sql import functions as F

from plantgauge import fixed_values as fv
from plantgauge.operators import insights, routing
from plantgauge.plans.plant_report import PlantReport

SCORED = "unit_id string, confidence double, anomaly_z double, raw_prediction int, family string"


def test_priority_of_routes(spark):
    df = spark.createDataFrame(
        [("n", 0.5, 3.0, 1, "crack"), ("u", 0.6, 1.0, 1, "crack"), ("r", 0.9, 2.8, 1, "crack"), ("a", 0.7, 0.0, 0, "None")], SCORED
    )
    rows = {r["unit_id"]: r for r in routing.route(df).collect()}
    assert [rows[k]["predicted_status"] for k in "nura"] == ["NOVEL", "UNCERTAIN", "REJECT", "ACCEPT"]
    assert rows["r"]["prediction"] == "Defective (crack)" and "crack Rework/Scrap" in rows["r"]["triage_recommendation"]
    assert rows["a"]["prediction"] == "Good" and rows["n"]["is_uncertain"]


def test_triage_queues(spark):
    df = routing.route(
        spark.createDataFrame([("u", 0.6, 1.0, 1, "x"), ("r", 0.9, 1.0, 1, "x"), ("a", 0.9, 0.0, 0, "x")], SCORED)
    ).withColumn("actual_label", F.when(F.col("unit_id") == "a", 1).otherwise(0))
    assert [r["unit_id"] for r in routing.triage_queue(df).collect()] == ["u"]
    assert sorted(r["unit_id"] for r in routing.triage_queue(df, "defective").collect()) == ["a", "r"]
    assert routing.triage_queue(df, "all").count() == 3
    with pytest.raises(ValueError):
        routing.triage_queue(df, "some")
    shares = {r["predicted_status"]: r["share"] for r in routing.status_counts(df).collect()}
    assert sum(shares.values()) == pytest.approx(1.0)


def why(spark, **changes):
    base = {
        "probs": [0.1, 0.0, 0.9], "confidence": 0.9, "predicted_class": "rust", "novelty_score": 0.05,
        "novelty_threshold": 0.12, "anomaly_score": 2.5, "anomaly_threshold": 2.06,
    }
    base.update(changes)
    types = "probs array<double>, confidence double, predicted_class string, novelty_score double, novelty_threshold double, anomaly_score double, anomaly_threshold double"
    df = spark.createDataFrame([tuple(base[k.split()[0]] for k in types.split(", "))], types)
    return routing.evidence_records(df, ["crack", "normal", "rust"]).first()["evidence"]


def test_rationale_texts(spark):
    bad = why(spark)
    assert bad["status"] == "DEFECTIVE" and bad["why"].startswith("DEFECTIVE (RUST): Calibrated confidence 0.90")
    assert "patch-anomaly score 2.50 exceeds normal limit 2.06" in bad["why"] and "rust 90.0%, crack 10.0%" in bad["why"]
    good = why(spark, probs=[0.05, 0.9, 0.05], predicted_class="normal", anomaly_score=1.0)
    assert good["status"] == "GOOD" and "is within normal threshold 2.06" in good["why"]
    unsure = why(spark, probs=[0.45, 0.0, 0.55], confidence=0.55)
    assert unsure["status"] == "UNCERTAIN" and "is below threshold 0.70" in unsure["why"]
    novel = why(spark, novelty_score=0.2)
    assert novel["status"] == "NOVEL" and "Novelty score 0.200 exceeds threshold 0.120" in novel["why"]
    assert why(spark) == bad


def test_audit(spark):
    df = spark.createDataFrame(
        [("normal", "normal"), ("crack", "crack"), ("crack", "rust"), ("crack", "normal")], "actual_class string, predicted_class string"
    )
    assert [r["audit"] for r in routing.audit(df).collect()] == ["correct", "correct", "category mismatch", "wrong"]


def toy_tables(spark, n=20):
    insp, proc, prod = [], [], []
    for b in range(n):
        bid = f"B{b:03d}"
        bad = 1 + b % 7
        insp += [(f"{bid}-{i}", bid, "Alpha", f"2026-01-{b + 1:02d} 00:00:00", "fail" if i < bad else "pass", "crack" if i < bad else "None") for i in range(30)]
        proc.append((bid, 100.0 + 2.0 * bad, 5.0))
        prod += [("Station 1", bid, 24.0, 12, 0.1, 30, 29, 1, 1), ("Station 2", bid, 40.0, 42, 0.3, 30, 28, bad, 1)]
    return (
        spark.createDataFrame(insp, "unit_id string, batch_id string, variant string, timestamp string, label string, defect_category string"),
        spark.createDataFrame(proc, "batch_id string, temperature double, speed double"),
        spark.createDataFrame(prod, "station string, batch_id string, cycle_time double, wip int, downtime_hours double, units_in int, units_out int, rework_units int, scrap_units int"),
    )


def test_report_end_to_end(spark):
    insp, proc, prod = toy_tables(spark)
    report = PlantReport(insp, proc, prod, hours_per_batch=8.0)
    chain = report.impact_chain().orderBy("stage").collect()
    assert [r["title"] for r in chain] == fv.STAGES and all(r["is_available"] for r in chain)
    assert chain[0]["name"] == "crack" and chain[0]["metric"] == "100.0% of defects"
    assert chain[1]["name"] == "temperature" and chain[2]["name"] == "Station 2"
    found = report.insights().collect()
    assert [r["category"] for r in found] == ["Bottleneck & Flow", "Root-Cause Attribution", "Plant Economics"]
    assert found[1]["confidence"] == "Strong" and "temperature" in found[1]["statement"]
    told = report.narrative().first()
    assert told["all_available"] and "<b>Station 2</b>" in told["narrative"]
    assert report.advisories().count() == 3 and report.kpis().first()["units"] == 600
    rng = report.what_if_range((20.0, 10.0, 15.0), 50).first()
    assert rng["p10_margin_pct"] <= rng["median_margin_pct"] <= rng["p90_margin_pct"]


def test_missing_parts_say_so(spark):
    facts = insights.gather(spark)
    chain = insights.impact_chain(facts).collect()
    assert len(chain) == 6 and not any(r["is_available"] for r in chain) and {r["name"] for r in chain} == {fv.INSUFFICIENT}
    found = insights.computed_insights(facts).collect()
    assert [r["confidence"] for r in found] == ["Low"] and "insufficient telemetry" in found[0]["statement"]
    told = insights.impact_narrative(facts).first()
    assert told["narrative"].startswith("Insufficient data") and not told["all_available"]
    assert insights.advisories(facts).count() == 0


def test_findings_per_group(spark):
    insp, _, _ = toy_tables(spark, 3)
    by = ["batch_id"]
    facts = insights.gather(spark, by, quality_family=insights.top_defect_family(insp, by))
    rows = insights.impact_chain(facts, by).where("is_available").collect()
    assert sorted(r["batch_id"] for r in rows) == ["B000", "B001", "B002"] and {r["stage"] for r in rows} == {1}

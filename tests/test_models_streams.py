import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantgauge.operators import models, routing, splits
from plantgauge.plans.classifier_report import ClassifierReport
from plantgauge.sources import sinks
from plantgauge.sources.driver_views import Tables
from plantgauge.streaming import live_scoring, running_totals


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.RandomState(0)
    names = ["crack", "normal", "rust"]
    m = np.vstack([np.eye(8)[i] + 0.15 * rng.normal(size=(60, 8)) for i in range(3)])
    pdf = pd.DataFrame({"vec_id": range(180), "embedding": [list(map(float, v)) for v in m], "category": [n for n in names for _ in range(60)]})
    return splits.stratified_split(spark.createDataFrame(pdf), "vec_id", "category").cache()


def test_classifier_report(vectors):
    report = ClassifierReport(vectors)
    macro = report.macro().first()
    assert macro["accuracy"] > 0.95 and macro["n"] == 36
    assert report.areas().first()["roc_auc"] > 0.95
    point = report.operating_point().first()
    assert 0.01 <= point["optimal_threshold"] <= 0.99 and 0 <= point["frr"] <= 1
    ece = {r["calibration"]: r["ece"] for r in report.calibration().collect()}
    assert ece["after"] <= ece["before"] + 0.02
    assert set(report.predictions().select("predicted_status").distinct().toPandas()["predicted_status"]) <= {"ACCEPT", "REJECT", "UNCERTAIN"}


def test_held_out_class(vectors):
    rows = {r["group"]: r for r in models.held_out_class(vectors, "rust").collect()}
    assert set(rows) == {"held out", "known", "crack", "normal"} and rows["held out"]["novel_rate"] > 0.9
    assert rows["known"]["n"] == 24 and rows["known"]["novel_rate"] < 0.4


def test_held_out_classes_search_the_bank_once(vectors, monkeypatch):
    calls = []
    search = models.neighbors.class_distances
    monkeypatch.setattr(models.neighbors, "class_distances", lambda *a, **k: calls.append(1) or search(*a, **k))
    both = models.held_out_classes(vectors).toPandas()
    assert len(calls) == 1 and set(both["held_out_class"]) == {"crack", "rust"}
    one = models.held_out_class(vectors, "rust").toPandas().set_index("group")
    pd.testing.assert_frame_equal(both[both["held_out_class"] == "rust"].set_index("group").loc[one.index], one)


def test_robust_retrain_covers_every_condition(vectors):
    rows = models.robust_retrain(vectors).collect()
    assert len(rows) == 12 and {r["status"] for r in rows} <= {"Improved", "Degraded", "Unchanged"}


def test_model_store(vectors, tmp_path):
    model = models.train_embedding_model(vectors.where("split = 'train'"), vectors.where("split = 'val'"))
    path = str(tmp_path / "m")
    calls = []

    def train():
        calls.append(1)
        return model.pipeline

    for width in (8, 8, 9):
        sinks.trained_or_loaded(path, train, features=width)
    assert len(calls) == 2  # trained once, loaded once, trained again for another width
    assert sinks.load_model(str(tmp_path / "none")) is None


def test_two_stage(spark):
    rng = np.random.RandomState(1)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((f"U{i}", f"B{i % 15}", "Alpha" if i % 2 else "Beta", "fail" if bad else "pass",
                     ("crack" if i % 8 else "rust") if bad else "None", float(rng.normal() + 4 * bad), float(rng.normal() + 3 * (i % 8 == 0))))
    insp = spark.createDataFrame(rows, "unit_id string, batch_id string, variant string, label string, defect_category string, roughness_ra double, optical_score double")
    proc = spark.createDataFrame([(f"B{i}", float(i)) for i in range(14)], "batch_id string, temperature double")
    prepared, names = models.prepare(insp, proc)
    assert names == ["temperature", "default_speed", "default_pressure", "default_vibration", "variant_is_alpha", "variant_is_beta",
                     "variant_is_gamma", "roughness_ra", "optical_score", "unit_seq_norm"]
    parts = splits.group_split(prepared, "batch_id", "unit_id")
    model = models.train_two_stage(parts.where("split = 'train'"), names)
    scored = models.score_two_stage(model, parts.where("split = 'test'"))
    metrics = models.two_stage_metrics(scored).first()
    assert metrics["accuracy"] > 0.85 and metrics["category_accuracy"] > 0.6 and 0 <= metrics["ece"] <= 1
    table = routing.predictions(routing.route(scored))
    assert table.where("p_good + p_defective > 1.002 OR p_good + p_defective < 0.998").count() == 0
    assert table.where("predicted_status = 'REJECT' AND prediction = 'Defective (None)'").count() == 0


def test_single_category_has_no_second_stage(spark):
    rows = [(f"U{i}", f"B{i % 4}", "fail" if i % 3 == 0 else "pass", "crack" if i % 3 == 0 else "None", float(i % 3)) for i in range(60)]
    insp = spark.createDataFrame(rows, "unit_id string, batch_id string, label string, defect_category string, roughness_ra double")
    prepared, names = models.prepare(insp, None)
    model = models.train_two_stage(prepared, names)
    assert model.category is None and set(names) >= {"default_temperature", "variant_unknown"}
    assert {r[0] for r in models.score_two_stage(model, prepared).select("family").distinct().collect()} == {"None"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    assert spark.read.option("header", True).csv(sinks.write_csv(df, str(tmp_path / "c"))).count() == 2
    assert spark.read.json(sinks.write_json(df, str(tmp_path / "j"))).count() == 2
    sinks.write_features(df, str(tmp_path / "f"))
    assert (tmp_path / "f" / "split=train").exists()
    calls = []

    def compute():
        calls.append(1)
        return df

    for force in (False, False, True):
        assert sinks.stored_or_computed(spark, str(tmp_path / "s"), compute, force).count() == 2
    assert len(calls) == 2


UNITS = "unit_id string, batch_id string, timestamp timestamp, label string"


def arrive(spark, folder, rows, name):
    df = spark.createDataFrame([(u, b, pd.Timestamp(t).to_pydatetime(), l) for u, b, t, l in rows], UNITS)
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_equals_batch(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    first = [("u1", "B1", "2026-01-01 01:00", "fail"), ("u2", "B1", "2026-01-01 02:00", "pass"), ("u3", "B2", "2026-01-01 23:00", "ng")]
    second = [("u4", "B1", "2026-01-02 05:00", "fail"), ("u5", "B1", "2026-01-03 12:00", "pass")]
    arrive(spark, src, first, "a")

    def go():
        stream = spark.readStream.schema(UNITS).parquet(str(src))
        running_totals.run_to_table(running_totals.defect_windows(stream), out, mark)

    go()
    arrive(spark, src, second, "b")
    arrive(spark, src, [("close", "B9", "2026-01-09 00:00", "pass")], "c")
    go()
    arrive(spark, src, [("late", "B1", "2026-01-01 03:00", "fail")], "d")
    go()
    got = spark.read.parquet(out)
    rows = spark.createDataFrame([(u, b, pd.Timestamp(t).to_pydatetime(), l) for u, b, t, l in first + second], UNITS)
    want = running_totals.defect_windows(rows)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0  # the late unit changes nothing
    last = running_totals.cumulative(got).orderBy(F.desc("window_start")).first()
    assert (last["cumulative_units"], last["cumulative_defects"]) == (5, 3)


def test_scoring_stream_counts_each_unit_once(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "counts"), str(tmp_path / "mark")
    score = lambda b: b.withColumn("predicted_status", F.when(F.col("label") == "fail", "REJECT").otherwise("ACCEPT"))
    for rows in ([("u1", "B1", "2026-01-01", "fail"), ("u2", "B1", "2026-01-01", "pass")], [("u3", "B1", "2026-01-02", "fail")]):
        arrive(spark, src, rows, "x")
        live_scoring.score_arrivals(spark.readStream.schema(UNITS).parquet(str(src)), score, out, mark)
    assert {r["predicted_status"]: r["n"] for r in live_scoring.status_totals(spark, out).collect()} == {"REJECT": 2, "ACCEPT": 1}


@pytest.mark.parametrize("files", [1, 3])
def test_table_arrives_from_a_file_or_a_folder(spark, tmp_path, files):
    path = tmp_path / "events.parquet"
    pdf = pd.DataFrame({"event_id": range(30)})
    if files == 1:
        pdf.to_parquet(path)
    else:
        path.mkdir()
        for i in range(files):
            pdf[i::files].to_parquet(path / f"part-{i}.parquet")
    pdf.to_parquet(tmp_path / "events.parquets")  # not this table
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    running_totals.run_to_table(Tables(spark, str(tmp_path)).arriving("events"), out, mark)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(30))


def test_text_sinks_are_compressed_and_complete(spark, tmp_path, monkeypatch):
    from plantgauge.catalog import QUERIES, models as catalog
    from plantgauge.catalog.routing import routed
    from plantgauge.sources.driver_views import Tables

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalog, "fresh_folder", lambda _, name: str(tmp_path / name))
    got = {r["sink"]: r["n"] for r in QUERIES["csv_json_sinks"](spark, folder).collect()}
    want = routed(Tables(spark, folder))
    for name, kind in (("queue", "csv"), ("predictions", "json")):
        files = [f.name for f in (tmp_path / name).iterdir() if f.name.startswith("part-")]
        assert files and all(f.endswith(f".{kind}.gz") for f in files)
    stored = spark.read.schema(want.schema).json(str(tmp_path / "predictions"))
    assert stored.exceptAll(want).count() == 0 and want.exceptAll(stored).count() == 0
    queue = spark.read.option("header", True).schema(want.schema).csv(str(tmp_path / "queue"))
    wanted = want.where("is_uncertain")
    assert queue.exceptAll(wanted).count() == 0 and wanted.exceptAll(queue).count() == 0
    assert (got["csv"], got["json"]) == (wanted.count(), want.count())


def test_training_rows_are_dealt_evenly_and_scored_once(spark, monkeypatch):
    """F7, F8: a scan of one split trains on all cores; the metrics score a row once."""
    rows = spark.range(0, 400, 1, 1).selectExpr(
        "cast(id as double) AS x", "cast(id % 2 as int) AS actual", "'None' AS actual_category"
    )
    parts, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: (parts.append(df), fit(self, df))[1])
    monkeypatch.setattr(models, "TASK_ROWS", 30)
    model = models.train_two_stage(rows, ["x"])
    sizes = parts[0].groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) == max(14, spark.sparkContext.defaultParallelism) and sizes.max() <= 60

    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        met.add(1)
        return x

    scored = models.score_two_stage(model, rows).withColumn("confidence", counted("confidence"))
    assert models.two_stage_metrics(scored).first()["n"] == 400 and met.value == 400


def test_rows_alike_stand_together_in_both_forests(spark, monkeypatch):
    """F2, F3 of round 4: both forests train on all rows, in even parts, sorted from the coarsest feature to the finest."""
    rows = spark.range(0, 600, 1, 1).selectExpr(
        "cast(hash(id) as double) AS fine", "cast(id % 3 as double) AS coarse", "cast(id % 2 as int) AS actual",
        "if(id % 4 = 1, 'rust', 'crack') AS actual_category",
    )
    parts, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: (parts.append(df), fit(self, df))[1])
    model = models.train_two_stage(rows, ["fine", "coarse"])
    assert model.category is not None and len(parts) == 2
    for df, n in zip(parts, (600, 300)):
        held = df.select("coarse", "fine").rdd.map(tuple).glom().collect()
        even = n / len(held)
        assert len(held) == spark.sparkContext.defaultParallelism and all(0.5 * even < len(p) < 1.5 * even for p in held)
        assert all(p == sorted(p) for p in held)
        want = rows.where("actual = 1") if n == 300 else rows
        assert sorted(r for p in held for r in p) == sorted(tuple(r) for r in want.select("coarse", "fine").collect())

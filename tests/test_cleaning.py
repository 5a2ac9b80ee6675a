import pytest
from pyspark.sql import functions as F, types as T

from plantgauge import fixed_values as fv
from plantgauge.functions.columns import annotation, is_defective, sequence_number
from plantgauge.operators import clean
from plantgauge.sources import tables


@pytest.mark.parametrize(
    "text, expected",
    [("good", False), ("defective", True), ("normal", False), ("crack", False), ("0", False), ("1", True),
     ("True", True), ("False", False), (" NG ", True), ("1.0", True), (None, False), ("", False)],
)
def test_is_defective(spark, text, expected):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(is_defective("c")).first()[0] is expected


def test_is_defective_of_numbers_and_booleans(spark):
    df = spark.createDataFrame([(1, 1.0, True), (0, 2.0, False)], "i int, d double, b boolean")
    rows = df.select(is_defective("i"), is_defective("d"), is_defective("b")).collect()
    assert [tuple(r) for r in rows] == [(True, True, True), (False, False, False)]


def test_alias_remap(spark):
    df = spark.createDataFrame([("p1", "L1", "Alpha", 1, "crack")], [" Part ID", "lot_id", "model", "defective", "category"])
    assert clean.remap_columns(df, "inspection").columns == ["unit_id", "batch_id", "variant", "label", "defect_category"]


def test_own_alias_wins_and_two_sources_coalesce(spark):
    df = spark.createDataFrame([(None, 2.0, 3.0), (1.0, 9.0, 4.0)], "temp_zone_1 double, temp_zone_2 double, rework double")
    production = clean.remap_columns(df, "production")
    assert production.columns == ["temperature", "rework_units"]
    assert clean.remap_columns(df, "economic").columns == ["temperature", "rework_cost"]
    assert [r[0] for r in production.orderBy("rework_units").collect()] == [2.0, 1.0]


def test_minutes_become_hours(spark):
    df = spark.createDataFrame([("S", 90.0)], "station string, downtime_min double")
    assert clean.remap_columns(df, "production").first()["downtime_hours"] == 1.5


def test_validation_rows(spark):
    df = spark.createDataFrame([("a", "b")], ["unit_id", "batch_id"])
    row = clean.validation_row(df, "inspection").first()
    assert not row["is_valid"] and row["missing_columns"] == ["variant", "timestamp", "label", "defect_category"]
    assert row["initial_rows"] == 1 and "Missing 4 required column(s)" in row["validation_message"]


def test_clean_dirty_inspection(spark):
    schema = "k int, unit_id string, batch_id string, variant string, timestamp string, label string, defect_category string"
    df = spark.createDataFrame(
        [(0, None, "B1", None, None, "pass", "crack"), (1, "U7", "B1", "Alpha", "2026-01-01 00:00:00", "defect", None),
         (2, None, "B1", "Beta", None, "ng", "hole")], schema,
    )
    rows = clean.clean_inspection(df, ["k"]).orderBy("k").collect()
    assert [r["unit_id"] for r in rows] == ["U1000", "U7", "U1002"]
    assert [r["label"] for r in rows] == [0, 1, 1]
    assert [r["defect_category"] for r in rows] == ["None", "None", "hole"]
    assert [r["variant"] for r in rows] == ["Standard-Variant", "Alpha", "Beta"]
    assert {r["timestamp"] for r in rows} == {"2026-01-01 00:00:00"}


def test_all_null_timestamps_get_the_constant(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, timestamp string")
    assert {r["timestamp"] for r in clean.fill_timestamps(df, ["k"]).collect()} == {fv.DEFAULT_TIMESTAMP}


def test_median_imputation(spark):
    df = spark.createDataFrame(
        [("1", None), ("x", None), ("4", None), ("NaN", None)], "temperature string, speed string"
    )
    rows = clean.impute_medians(df, ["temperature", "speed"]).collect()
    assert sorted(r["temperature"] for r in rows) == [1.0, 2.5, 2.5, 4.0]
    assert {r["speed"] for r in rows} == {0.0}


def test_csv_load_keeps_file_order(spark, tmp_path):
    path = tmp_path / "inspection.csv"
    path.write_text(
        "part_id,lot_id,model,time,pass_fail,failure_mode\n"
        "z9,B1,Alpha,,fail,crack\n,B1,Beta,2026-02-01 00:00:00,pass,\nc3,B2,,,bad,rust\n"
    )
    table, report = tables.load_csv(spark, str(path), "inspection")
    rows = {r["unit_id"]: r for r in table.collect()}
    assert set(rows) == {"z9", "U1001", "c3"}
    assert rows["c3"]["timestamp"] == rows["z9"]["timestamp"] == "2026-02-01 00:00:00"
    assert report.first()["is_valid"]


def test_missing_csv_gives_an_empty_table(spark, tmp_path):
    table, report = tables.load_csv(spark, str(tmp_path / "none.csv"), "process")
    assert table.count() == 0 and set(fv.EXPECTED["process"]) <= set(table.columns)
    assert report.first()["cleaned_rows"] == 0


def test_load_all_modes(spark, tmp_path):
    (tmp_path / "process.csv").write_text("batch_id,timestamp,temp,rpm,press,vib\nB1,2026-01-01,1,2,3,4\n")
    (tmp_path / "normal").mkdir()
    (tmp_path / "crack").mkdir()
    (tmp_path / "other").mkdir()
    for name in ("normal/a.png", "normal/b.JPG", "crack/c.png", "other/d.png", "crack/note.txt"):
        (tmp_path / name).write_bytes(b"x")
    out = tables.load_all(spark, "Organizer", {"process": str(tmp_path / "process.csv")}, str(tmp_path))
    assert {(r["label"], r["defect_category"]) for r in out["inspection"].collect()} == {
        ("good", "normal"), ("defective", "crack")
    }
    assert out["process"].first()["vibration"] == 4.0
    assert {r["dataset"]: r["record_count"] for r in out["provenance"].collect()}["process"] == 1
    demo = tables.load_all(spark, "Demo", {"process": str(tmp_path / "process.csv")})
    assert demo["provenance"].first()["is_synthetic"] is True
    with pytest.raises(ValueError):
        tables.load_all(spark, "Elsewhere", {})


def test_image_listing_first_n(spark, tmp_path):
    for c in ("normal", "rust"):
        (tmp_path / c).mkdir()
        for i in range(4):
            (tmp_path / c / f"{i}.png").write_bytes(b"x")
    rows = tables.image_listing(spark, str(tmp_path), per_class=2).collect()
    assert sorted(r["image_path"][-10:].split("/")[-1] for r in rows) == ["0.png", "0.png", "1.png", "1.png"]


def test_companions_and_annotation(spark):
    df = spark.createDataFrame([("S1", 0.5, "[1,2,3,4]"), ("S2", 1.0, "[]"), ("S3", 0.0, None)], "station string, downtime_hours double, bbox string")
    out = clean.add_companions(df, "production")
    assert [r["downtime_min"] for r in out.orderBy("station").collect()] == [30.0, 60.0, 0.0]
    marks = [r[0] for r in df.orderBy("station").select(annotation("bbox")).collect()]
    assert marks == [fv.BBOX_PRESENT, fv.BBOX_ABSENT, fv.BBOX_ABSENT]


def test_sequence_number(spark):
    df = spark.createDataFrame([("U0123-9",), ("none",)], "u string")
    assert [r[0] for r in df.select(sequence_number("u")).collect()] == [123.0, None]


def test_timestamps_of_an_absent_column_need_no_order(spark, monkeypatch):
    """Nothing to fill from: the constant, without sorting the rows."""
    monkeypatch.setattr(clean, "filled", None)
    df = spark.createDataFrame([(1, None), (2, None)], "k int, timestamp string")
    assert {r["timestamp"] for r in clean.fill_timestamps(df, ["k"]).collect()} == {clean.fv.DEFAULT_TIMESTAMP}


def test_means_of_few_batches_are_sent_to_the_units(spark):
    """However wide their estimated size, units are not shuffled by batch."""
    from plantgauge.operators import features

    units = spark.createDataFrame([("U1", "B1", 1.0), ("U2", "B2", None), ("U3", None, 3.0)], "unit_id string, batch_id string, m double")
    readings = spark.createDataFrame([("B1", 4.0), ("B1", 6.0)], "batch_id string, temperature double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = features.tabular(units, readings)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r["unit_id"]: (r["temperature"], r["m"]) for r in rows.collect()} == {"U1": (5.0, 1.0), "U2": (5.0, 2.0), "U3": (5.0, 3.0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

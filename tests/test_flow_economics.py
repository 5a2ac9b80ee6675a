import pytest
from pyspark.sql import functions as F

from plantgauge.operators import economics, flow

STATION = "station string, cycle_time double, downtime_fraction double, units_in long, units_out long, rework_units long, scrap_units long, wip long"


def metrics(spark, rows, hours=8.0):
    return flow.station_metrics(spark.createDataFrame(rows, STATION), hours=hours)


def test_station_by_hand(spark):
    row = metrics(spark, [("S", 0.5, 0.10, 800, 780, 78, 0, 15)]).first()
    assert (row["effective_capacity"], row["rework_rate"], row["effective_load"], row["utilization"]) == (108.0, 0.1, 880.0, 1.0185)


def test_seconds_and_hours(spark):
    df = spark.createDataFrame([("S", 24.0, 2.0, 100, 0, 5, 0, 1)], STATION.replace("downtime_fraction", "downtime_hours"))
    row = flow.station_metrics(df).first()
    assert (row["cycle_time"], row["downtime_fraction"], row["effective_capacity"], row["rework_rate"]) == (0.4, 0.25, 112.5, 0.0)


def test_downtime_over_a_shift_means_no_capacity(spark):
    df = spark.createDataFrame([("S", 24.0, 19.0, 100, 90, 5, 0, 1)], STATION.replace("downtime_fraction", "downtime_hours"))
    row = flow.station_metrics(df).first()
    assert (row["effective_capacity"], row["utilization"]) == (0.0, 0.0)


LINE = [
    ("Station 1", 0.4, 0.05, 800, 780, 16, 4, 12),
    ("Station 2", 0.6, 0.20, 750, 700, 105, 20, 42),
    ("Station 3", 0.3, 0.02, 700, 690, 7, 3, 8),
]


def test_line_of_three(spark):
    row = flow.line_summary(metrics(spark, LINE)).first()
    assert row["bottleneck_station"] == "Station 2" and row["utilization"] == 1.3477
    assert row["line_throughput"] == 80.0 and "rework adds 15% extra load" in row["bottleneck_evidence"]
    assert row["throughput_lost_due_to_rework"] == 10.43
    assert (row["total_wip"], row["total_scrap"], row["total_rework"]) == (62, 27, 128)


def test_smoke_evidence(spark):
    row = flow.line_summary(metrics(spark, [("Stn_C", 1.2, 0.0, 320, 320, 32, 0, 55)])).first()
    assert row["bottleneck_evidence"] == "Stn_C: utilization 88%, WIP 55, rework adds 10% extra load"


def test_ties(spark):
    same = ("x", 0.5, 0.0, 100, 100, 0, 0)
    rows = [("StA", *same[1:], 20), ("StB", *same[1:], 45)]
    assert flow.bottleneck(metrics(spark, rows)).first()["station"] == "StB"
    rows = [("StC", 0.4, 0.0, 150, 150, 0, 0, 20), ("StD", 0.6, 0.0, 100, 100, 0, 0, 20)]
    assert flow.bottleneck(metrics(spark, rows)).first()["station"] == "StD"


def test_empty_line(spark):
    row = flow.line_summary(metrics(spark, [])).first()
    assert row["bottleneck_station"] is None and row["line_throughput"] == 0.0 and row["total_wip"] == 0
    assert row["bottleneck_evidence"] == "No station data available"


def test_many_lines_equal_single_lines(spark):
    both = spark.createDataFrame([("A", *r) for r in LINE] + [("B", *LINE[0])], "line string, " + STATION)
    got = {r["line"]: r for r in flow.line_summary(flow.station_metrics(both, ["line"]), ["line"]).collect()}
    alone = flow.line_summary(metrics(spark, LINE)).first()
    assert got["A"]["utilization"] == alone["utilization"] and got["B"]["bottleneck_station"] == "Station 1"


def test_kpis_flag_the_bottleneck_once(spark):
    rows = flow.station_kpis(metrics(spark, LINE)).collect()
    assert [r["station"] for r in rows if r["is_bottleneck"]] == ["Station 2"]
    law = flow.littles_law(flow.line_summary(metrics(spark, LINE))).first()
    assert law["total_line_cycle_time_sec"] == 78.0 and law["littles_law_expected_wip"] == 1.7


BASE = "good_units long, unit_price double, material_cost double, labor_cost double, overhead_cost double, scrap_cost double, rework_cost double, downtime_cost double, line_throughput double"


def pnl(spark):
    df = spark.createDataFrame([(600, 100.0, 20000.0, 12000.0, 8000.0, 3000.0, 2500.0, 1500.0, 75.0)], BASE)
    return economics.calculate_economics(df, ["line_throughput"])


def test_pnl_by_hand(spark):
    row = pnl(spark).first()
    assert (row["revenue"], row["cost"], row["profit"]) == (60000.0, 47000.0, 13000.0)
    assert (row["margin"], row["cost_per_good_unit"], row["cost_of_poor_quality"]) == (0.2167, 78.33, 7000.0)


def test_pnl_without_good_units(spark):
    df = spark.createDataFrame([(0, 100.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0)], BASE)
    row = economics.calculate_economics(df).first()
    assert (row["margin"], row["cost_per_good_unit"]) == (0.0, 0.0)


def test_rollup_to_pnl(spark):
    totals = spark.createDataFrame([(1000, 40, 50, 90.0)], "total_units long, scrap_units long, rework_units long, downtime_minutes double")
    row = economics.calculate_pnl(totals, None).first()
    assert row["good_units"] == 960 and row["labor_cost"] == 3600.0 and row["overhead_cost"] == 240.0
    assert row["scrap_cost"] == 1680.0 and row["rework_cost"] == 925.0 and row["downtime_cost"] == 225.0


def test_parameters_use_the_first_row_and_defaults(spark):
    totals = spark.createDataFrame([(10, 0, 0, 0.0)], "total_units long, scrap_units long, rework_units long, downtime_minutes double")
    econ = spark.createDataFrame([(99.0, None)], "unit_price double, material_cost double")
    row = economics.calculate_pnl(totals, econ).first()
    assert row["unit_price"] == 99.0 and row["material_cost"] == 320.0
    assert economics.calculate_pnl(totals, econ.limit(0)).first()["unit_price"] == 85.0


def test_what_if_improves(spark):
    row = economics.what_if(pnl(spark), [(20.0, 10.0, 15.0)]).first()
    assert row["throughput_delta"] > 0 and row["good_units_delta"] > 0 and row["profit_delta"] > 0 and row["margin_delta"] > 0
    assert row["copq_delta"] < 0
    for name in ("revenue", "cost", "profit"):
        assert row[f"{name}_delta"] == pytest.approx(row[f"sim_{name}"] - row[name], abs=0.011)
    same = economics.what_if(pnl(spark), [(0.0, 0.0, 0.0)]).first()
    assert same["profit_delta"] == 0.0 and same["sim_good_units"] == 600


def test_margin_recovery(spark):
    row = economics.margin_recovery(pnl(spark), [(20.0, 10.0)]).first()
    assert row["profit_gain"] > 0 and row["margin_gain_points"] > 0


BATCH = "batch_id string, total_inspected long, defect_count long, conforming_count long, scrap_units long, rework_units long, downtime_hours double"


def test_bootstrap_range(spark):
    rows = [(f"B{i}", 50, i % 5, 50 - i % 5, i % 3, i % 4, 0.1 * (i % 6)) for i in range(20)]
    table = spark.createDataFrame(rows, BATCH)
    a, b = (economics.bootstrap_what_if_margin(table, pnl(spark), (20.0, 10.0, 15.0), 100).first() for _ in range(2))
    assert a == b and a["p10_margin_pct"] <= a["median_margin_pct"] <= a["p90_margin_pct"]
    other = economics.bootstrap_what_if_margin(table, pnl(spark), (20.0, 10.0, 15.0), 100, seed=7).first()
    assert other != a


def test_bootstrap_without_batches(spark):
    table = spark.createDataFrame([], BATCH)
    base = pnl(spark).withColumn("margin", F.lit(0.52))
    row = economics.bootstrap_what_if_margin(table, base, (20.0, 10.0, 15.0), 20).first()
    assert (row["median_margin_pct"], row["p10_margin_pct"], row["p90_margin_pct"]) == (52.0, 52.0, 52.0)


def test_resampling_keeps_the_sample_size(spark):
    table = spark.createDataFrame([(f"B{i}", 1.0) for i in range(30)], "batch_id string, one double")
    rows = economics.resampled_sums(table, ["one"], ["batch_id"], 40, 42).collect()
    assert len(rows) == 40 and {r["one"] for r in rows} == {30.0}


def test_copq_shares(spark):
    rows = economics.copq_breakdown(pnl(spark)).collect()
    assert sum(r["cost"] for r in rows) == 7000.0 and sum(r["share"] for r in rows) == pytest.approx(1.0)
    steps = {r["step"]: r["amount"] for r in economics.waterfall(pnl(spark)).collect()}
    assert sum(v for k, v in steps.items() if k != "Operating Profit") == steps["Operating Profit"]


PRODUCTION = "station string, batch_id string, cycle_time double, wip long, downtime_hours double, units_in long, units_out long, rework_units long, scrap_units long"


def test_line_downtime_is_the_sum_in_production(spark):
    """Two stations, three shifts: downtime, labor and overhead belong to 24 hours."""
    rows = [(f"S{s}", f"B{b}", 30.0, 4, 0.6 * s, 100, 95, 5, 2) for s in (1, 2) for b in (1, 2, 3)]
    stations = flow.station_metrics(flow.station_rollup(spark.createDataFrame(rows, PRODUCTION), hours_per_batch=8.0))
    line = flow.line_summary(stations)
    row = line.first()
    assert row["hours"] == 24.0 and row["downtime_hours"] == pytest.approx(3 * (0.6 + 1.2), abs=1e-9)
    units = spark.createDataFrame([(600,)], "total_units long")
    got = economics.plant_pnl(line, units, spark.createDataFrame([(10.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "unit_price double, material_cost double, labor_cost double, overhead_cost double, scrap_cost double, rework_cost double, downtime_cost_per_hour double")).first()
    assert got["good_units"] == 600 - 12 and got["revenue"] == 5880.0 and got["material_cost"] == 600.0
    assert (got["labor_cost"], got["overhead_cost"]) == (24.0 * 4 * 2.0, 24.0 * 3.0)
    assert (got["scrap_cost"], got["rework_cost"], got["downtime_cost"]) == (48.0, 150.0, 32.4)
    # one shift against the sums of three: the single-shift formula
    one = flow.line_summary(flow.station_metrics(flow.station_rollup(spark.createDataFrame(rows, PRODUCTION)))).first()
    assert one["hours"] == 8.0 and one["downtime_hours"] == pytest.approx(5.4, abs=1e-9)


def test_bootstrap_draws_are_cut_into_even_tasks(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(economics, "TASK_DRAWS", 50)
    drawn = economics.numbered_draws(spark, 300, 20, 42)  # however the 300 rows are partitioned
    sizes = drawn.rdd.glom().map(len).collect()
    assert sum(sizes) == 6000 and max(sizes) <= 50
    got = sorted(tuple(r) for r in drawn.where("rep in (0, 19)").collect())
    want = sorted((b, int(hashlib.md5(f"42|{b}|{j}".encode()).hexdigest()[:8], 16) % 300) for b in (0, 19) for j in range(300))
    assert got == want
    assert economics.numbered_draws(spark, 0, 20, 42).count() == 0

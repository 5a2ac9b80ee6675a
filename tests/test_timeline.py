"""Joins and windows over time, sketches and episodes against brute force."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantgauge.operators import sketches, spans
from plantgauge.session import fresh_folder
from plantgauge.streaming import episodes

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else BASE + dt.timedelta(seconds=seconds)


# --- as-of ---------------------------------------------------------------------------


def test_as_of(spark):
    rng = random.Random(1)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = [(i, key(), at(rng.choice([None, *range(0, 400)]))) for i in range(300)]
    right = [(key(), at(rng.choice([None, *range(0, 400, 3)])), rng.randint(0, 5), rng.choice([None, 1.5, 2.5])) for _ in range(300)]
    right += [("late", at(500), 1, 1.0)]
    left += [(900, "late", at(499)), (901, "late", at(500)), (902, "never", at(3))]
    ldf = spark.createDataFrame(left, "id long, k string, t timestamp")
    rdf = spark.createDataFrame(right, "k string, at timestamp, seq int, v double")
    out = {r["id"]: r for r in spans.as_of(ldf, rdf, ["k"], "t", "at", ["v", "seq"], tie=["seq"]).collect()}
    assert len(out) == len(left)
    for i, k, t in left:
        met = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        best = max(met, key=lambda r: (r[1], r[2], r[3] is None, r[3] or 0), default=None)
        assert out[i]["k"] == k and out[i]["t"] == t
        assert (out[i]["at"], out[i]["seq"]) == ((best[1], best[2]) if best else (None, None)), (i, k, t)


def test_as_of_carries_over_empty_slices(spark):
    left = spark.createDataFrame([(i, "k", at(i)) for i in range(100, 4000)], "id long, k string, t timestamp")
    right = spark.createDataFrame([("k", at(5), 7.0)], "k string, at timestamp, v double")
    assert spans.as_of(left, right, ["k"], "t", "at", ["v"]).where("v is null or v <> 7").count() == 0


def test_as_of_empty_sides(spark):
    left = spark.createDataFrame([(1, "k", at(5))], "id long, k string, t timestamp")
    right = spark.createDataFrame([("k", at(5), 7.0)], "k string, at timestamp, v double")
    assert [r["v"] for r in spans.as_of(left, right.where("false"), ["k"], "t", "at", ["v"]).collect()] == [None]
    assert spans.as_of(left.where("false"), right, ["k"], "t", "at", ["v"]).collect() == []
    assert spans.as_of(left, right, ["k"], "t", "at", ["v"]).columns == ["id", "k", "t", "at", "v"]


# --- spans ---------------------------------------------------------------------------


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_points_in_spans(spark, keys):
    rng = random.Random(2)
    points = [(i, rng.choice("ab"), at(rng.choice([None, *range(-100, 90_000, 7)]))) for i in range(400)]
    runs = []
    for i in range(120):
        start = rng.randrange(-50, 80_000)
        runs.append((i, rng.choice("ab"), at(start), at(start + rng.choice([-5, 0, 1, 30, 600, 2400, 9_000, 80_000, 3_000_000]))))
    runs += [(500, "a", None, at(3)), (501, "a", at(3), None)]
    pdf = spark.createDataFrame(points, "p long, k string, t timestamp")
    sdf = spark.createDataFrame(runs, f"s long, {'k' if keys else 'sk'} string, a timestamp, b timestamp")
    got = sorted((r["p"], r["s"]) for r in spans.points_in_spans(pdf, sdf, "t", "a", "b", keys, width=60).collect())
    want = sorted(
        (p[0], s[0]) for p in points for s in runs
        if p[2] and s[2] and s[3] and s[2] <= p[2] < s[3] and (not keys or p[1] == s[1])
    )
    assert got == want


def test_span_bounds_to_the_microsecond(spark):
    tick = dt.timedelta(microseconds=1)
    moments = [at(600) - tick, at(600), at(600) + tick, at(1200) - tick, at(1200)]
    pdf = spark.createDataFrame(list(enumerate(moments)), "p long, t timestamp")
    sdf = spark.createDataFrame([(0, at(600), at(1200)), (1, at(600), at(600) + tick), (2, at(1200) - tick, at(1200))], "s long, a timestamp, b timestamp")
    got = sorted((r["s"], r["p"]) for r in spans.points_in_spans(pdf, sdf, "t", "a", "b").collect())
    assert got == [(0, 1), (0, 2), (0, 3), (1, 1), (2, 3)]
    assert spans.points_in_spans(pdf, sdf.where("false"), "t", "a", "b").collect() == []
    assert spans.points_in_spans(pdf.where("false"), sdf, "t", "a", "b").collect() == []


def test_spans_join_without_nested_loop(spark):
    pdf = spark.createDataFrame([(0, at(5))], "p long, t timestamp")
    sdf = spark.createDataFrame([(0, at(0), at(1000))], "s long, a timestamp, b timestamp")
    plan = spans.points_in_spans(pdf, sdf, "t", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rolling_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), at(rng.choice([None, *range(0, 5000, 13)])), rng.randint(0, 3)) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, t timestamp, d long")
    out = spans.rolling_sums(df, ["k"], "t", "300 SECONDS", {"n": F.lit(1).cast("long"), "d": "d"}).collect()
    keep = [r for r in rows if r[0] is not None and r[1] is not None]
    assert len(out) == len({(r[0], r[1]) for r in keep})
    for r in out:
        met = [x for x in keep if x[0] == r["k"] and r["t"] - dt.timedelta(seconds=300) < x[1] <= r["t"]]
        assert (r["n"], r["d"]) == (len(met), sum(x[2] for x in met))
    assert spans.rolling_sums(df.where("false"), ["k"], "t", "1 HOUR", {"d": "d"}).collect() == []


# --- sketches ------------------------------------------------------------------------


def test_sketches_at_several_merge_orders(spark):
    n = 60_000
    df = spark.range(n).select(
        (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("day"), (F.hash("id") % 20_000).alias("who"),
        ((F.col("id") * 7919) % n).cast("double").alias("v"),
    )
    days = sketches.sketch_table(df, ["g", "day"], "v", "who")
    path = fresh_folder(spark, "sketches")
    days.where("day < 3").write.parquet(path)
    days.where("day >= 3").write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 21
    exact = df.agg(F.count_distinct("who")).first()[0]
    orders = [[["g"], []], [["day"], []], [[]], [["g", "day"], ["day"], []]]
    for order in orders:
        table = stored
        for keys in order:
            table = sketches.merged_sketches(table, keys)
        r = sketches.estimates(table, [], {"p10": 0.1, "p50": 0.5, "p99": 0.99}).first()
        assert r["n"] == n and abs(r["distinct"] - exact) <= 0.035 * exact
        assert all(abs(r[k] / n - p) <= 0.015 for k, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)))


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 2.0, "x"), ("b", float("nan"), "x")], "g string, v double, who string")
    out = {r["g"]: r for r in sketches.estimates(sketches.sketch_table(df, ["g"], "v", "who"), ["g"], {"p50": 0.5}).collect()}
    assert (out["a"]["n"], out["a"]["distinct"], out["a"]["p50"]) == (0, 0, None)
    assert (out["b"]["n"], out["b"]["distinct"], out["b"]["p50"]) == (1, 1, 2.0)


# --- episodes ------------------------------------------------------------------------


def brute_episodes(rows, pause, late):
    mark = max(t for _, t, _ in rows) - late
    out = []
    for key, own in itertools.groupby(sorted((r for r in rows if r[1] <= mark), key=lambda r: (r[0], r[1], not r[2])), key=lambda r: r[0]):
        run = []
        for _, t, active in own:
            if run and (not active or t - run[-1] > pause):
                out.append((key, run[0], run[-1], len(run)))
                run = []
            if active:
                run.append(t)
        if run and run[-1] + pause < mark:
            out.append((key, run[0], run[-1], len(run)))
    return sorted(out)


def settled(df):
    return sorted((r["key"], int((r["started"] - BASE).total_seconds()), int((r["ended"] - BASE).total_seconds()), r["rows"]) for r in df.collect())


def signal_rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "a", "b"]), rng.randrange(0, 40_000), rng.random() < 0.7) for _ in range(n)]


def write(spark, folder, rows):
    df = spark.createDataFrame([(k, at(t), a) for k, t, a in rows], "key string, timestamp timestamp, active boolean")
    df.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema("key string, timestamp timestamp, active boolean").option("maxFilesPerTrigger", 1).parquet(folder)


def test_episodes_of_one_arrival(spark):
    rows = signal_rows(1)
    folder = fresh_folder(spark, "signals")
    write(spark, folder, rows)
    assert settled(episodes.finished_episodes(spark, stream(spark, folder), 300, "1 hour")) == brute_episodes(rows, 300, 3600)


def test_episodes_continue_from_the_checkpoint(spark):
    rows = sorted(signal_rows(2), key=lambda r: r[1])
    folder, path, mark = (fresh_folder(spark, n) for n in ("signals", "episodes", "progress"))
    rng = random.Random(3)
    parts = [rows[i : i + 100] for i in range(0, 400, 100)]
    for i, part in enumerate(parts):  # up to an hour out of order, across restarts
        held = [r for r in parts[i + 1] if r[1] < part[-1][1] + 1000] if i + 1 < len(parts) else []
        rng.shuffle(part)
        write(spark, folder, part + held)
        if held:
            parts[i + 1] = [r for r in parts[i + 1] if r not in held]
        episodes.run_to_table(episodes.episodes(stream(spark, folder), 300, "1 hour"), path, mark)
    assert settled(spark.read.parquet(path)) == brute_episodes(rows, 300, 3600)


def test_episodes_of_many_keys_share_states(spark, monkeypatch):
    """Keys of a group keep their own rows, open episodes and timers over several arrivals."""
    monkeypatch.setattr(episodes, "GROUPS", 3)
    rng = random.Random(4)
    rows = sorted(((f"k{rng.randrange(40)}", rng.randrange(0, 40_000), rng.random() < 0.7) for _ in range(1200)), key=lambda r: r[1])
    folder, path, mark = (fresh_folder(spark, n) for n in ("signals", "episodes", "progress"))
    for i in range(0, 1200, 400):
        write(spark, folder, rows[i : i + 400])
    found = episodes.episodes(stream(spark, folder), 300, "1 hour")
    query = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    assert settled(spark.read.parquet(path)) == brute_episodes(rows, 300, 3600)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3


def test_late_rows_and_nulls(spark):
    folder, path, mark = (fresh_folder(spark, n) for n in ("signals", "episodes", "progress"))
    write(spark, folder, [("a", 0, True), ("a", 100, True), ("a", 9000, False), ("a", 20_000, True)])
    run = lambda: episodes.run_to_table(episodes.episodes(stream(spark, folder), 300, "1 hour"), path, mark)
    run()
    spark.createDataFrame([("a", at(150), True), (None, at(30_000), True), ("b", None, True), ("b", at(30_000), None)], "key string, timestamp timestamp, active boolean").coalesce(1).write.mode("append").parquet(folder)
    run()
    assert settled(spark.read.parquet(path)) == [("a", 0, 100, 2), ("a", 20_000, 20_000, 1)]


def test_span_totals_list_no_pairs(spark, monkeypatch):
    """Long spans over common items, repeated spans, null items, values and times: totals as by pairs,
    without a join on bins."""
    monkeypatch.setattr(spans, "NODE_FACTOR", 2)
    monkeypatch.setattr(spans, "points_in_spans", None)
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 200)), [None, "a", "b", "c"][int(rng.integers(0, 4))], None if i % 9 == 0 else i / 4) for i in range(150)]
    runs = [(f"r{i}", int(a), int(a + rng.integers(-2, 120))) for i, a in enumerate(rng.integers(-20, 220, size=40))]
    runs += [runs[3], runs[3], ("all", -50, 400), ("none", 500, 600)]
    points = spark.createDataFrame(rows + [(None, "a", 1.0)], "s int, item string, value double").withColumn("ts", F.timestamp_seconds("s"))
    table = spark.createDataFrame(runs, "run string, a int, b int").select("run", F.timestamp_seconds("a").alias("began"), F.timestamp_seconds("b").alias("ended"))
    got = {r["run"]: (r["n"], r["items"], r["total"]) for r in spans.span_totals(points, table, "ts", "began", "ended", "item", "value").collect()}
    want = {}
    for run, a, b in set(runs):
        inside = [r for r in rows if a <= r[0] < b]
        k, known = runs.count((run, a, b)), [r[2] for r in inside if r[2] is not None]
        if inside:
            want[run] = (k * len(inside), len({r[1] for r in inside} - {None}), k * sum(known) if known else None)
    assert got == want

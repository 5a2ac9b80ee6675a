"""Joins and windows over time, sketches and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge.catalog.base import CTES, query
from plantgauge.catalog.cleaning import sql_defective
from plantgauge.functions.columns import is_defective
from plantgauge.operators import sketches, spans
from plantgauge.session import fresh_folder

from plantgauge.streaming import episodes

# the test tables have inspections and readings in different years; these views put
# inspections and runs into the month of the readings
EXTRA = {
    "visits": """
SELECT l_orderkey AS order_id, l_linenumber AS line, concat('B', lpad(CAST(l_suppkey AS STRING), 5, '0')) AS batch_id,
       CASE WHEN l_linenumber = 3 AND l_tax = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-01 00:00:00' + ((l_orderkey * 37 + l_linenumber * 1013) % 43200) * INTERVAL '1' MINUTE END AS inspected_at,
       CASE WHEN l_returnflag = 'R' AND l_discount >= 0.05 THEN 'FAIL' ELSE 'pass' END AS label
FROM {lineitem}""",
    "readings": """
SELECT event_id, concat('B', lpad(CAST(user_id AS STRING), 5, '0')) AS batch_id, event_type, value, ts FROM {events}""",
    "runs": """
SELECT concat('Station ', CAST(l_linenumber AS STRING)) AS station, concat('B', lpad(CAST(l_suppkey AS STRING), 5, '0')) AS run_batch,
       TIMESTAMP '2024-01-01 00:00:00' + ((l_suppkey * 971 + l_linenumber * 3313) % 40000) * INTERVAL '1' MINUTE AS started,
       TIMESTAMP '2024-01-01 00:00:00' + ((l_suppkey * 971 + l_linenumber * 3313) % 40000 + CASE WHEN l_suppkey % 25 = 0 THEN 21600
           ELSE CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) % 600 END) * INTERVAL '1' MINUTE AS ended
FROM {lineitem} GROUP BY l_linenumber, l_suppkey""",
}
EXTRA_SOURCES = {"visits": "lineitem", "readings": "events", "runs": "lineitem"}
for name, text in EXTRA.items():
    CTES[name] = text.replace("{", "").replace("}", "")


def view(t, name: str):
    source = EXTRA_SOURCES[name]
    return t.spark.sql(EXTRA[name], **{source: t.base(source)})


def moment(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def sql_moment(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


@query(
    oracle=f"""SELECT order_id, line, v.batch_id, {sql_moment('inspected_at', 'inspected_at')}, {sql_moment('r.ts', 'ts')}, event_type, value
               FROM visits v ASOF LEFT JOIN (SELECT batch_id, ts, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
                                             FROM readings GROUP BY ALL) r ON v.batch_id = r.batch_id AND v.inspected_at >= r.ts""",
    doubles="value",
)
def telemetry_as_of(t):
    """The last reading of its batch before every inspection."""
    left = view(t, "visits").select("order_id", "line", "batch_id", "inspected_at")
    out = spans.as_of(left, view(t, "readings"), ["batch_id"], "inspected_at", "ts", ["event_type", "value"], tie=["event_id"])
    return out.select("order_id", "line", "batch_id", moment("inspected_at"), moment("ts"), "event_type", "value")


@query(
    oracle=f"""SELECT station, run_batch, {sql_moment('started', 'started')}, {sql_moment('ended', 'ended')}, count(*) AS n_events,
                      count(DISTINCT batch_id) AS n_batches, sum(value) AS total_value
               FROM runs JOIN readings ON ts >= started AND ts < ended GROUP BY ALL""",
    doubles="total_value",
)
def events_in_runs(t):
    """Readings of any batch while a station ran a batch."""
    out = spans.span_totals(view(t, "readings"), view(t, "runs"), "ts", "started", "ended", "batch_id", "value")
    out = out.withColumnsRenamed({"n": "n_events", "items": "n_batches", "total": "total_value"})
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("started", "ended")})


@query(
    oracle=f"""SELECT batch_id, {sql_moment('inspected_at', 'inspected_at')}, units::BIGINT AS units, defects::BIGINT AS defects, defects / units::DOUBLE AS rate
               FROM (SELECT DISTINCT batch_id, inspected_at, count(*) OVER w AS units, sum({sql_defective('label')}::INTEGER) OVER w AS defects
                     FROM visits WHERE inspected_at IS NOT NULL
                     WINDOW w AS (PARTITION BY batch_id ORDER BY inspected_at
                                  RANGE BETWEEN INTERVAL 6 HOURS - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW))""",
    doubles="rate",
)
def rolling_defect_rate(t):
    """Defect rate of a batch over the last six hours, at every moment it is inspected."""
    flag = is_defective("label").cast("long")
    out = spans.rolling_sums(view(t, "visits"), ["batch_id"], "inspected_at", "6 HOURS", {"units": F.lit(1).cast("long"), "defects": flag})
    return out.select("batch_id", moment("inspected_at"), "units", "defects", (F.col("defects") / F.col("units")).alias("rate"))


@query(
    oracle="""SELECT event_type, count(DISTINCT ts::DATE) AS days, count(*) AS n, true AS distinct_ok, true AS p50_ok, true AS p95_ok
              FROM readings GROUP BY event_type"""
)
def sketch_rollup(t):
    """A month from stored sketches of its days, and whether each estimate keeps its error."""
    rows = view(t, "readings").withColumn("day", F.to_date("ts"))
    path = fresh_folder(t.spark, "sketches")
    for part in (F.dayofmonth("day") <= 15, F.dayofmonth("day") > 15):  # days are added later
        sketches.sketch_table(rows.where(part), ["event_type", "batch_id", "day"], "value", "value").write.mode("append").parquet(path)
    stored = t.spark.read.parquet(path)
    probs = {"p50": 0.5, "p95": 0.95}
    known = sketches.estimates(sketches.merged_sketches(stored, ["event_type"]), ["event_type"], probs).drop("n")
    met = rows.select("event_type", "day", "value").join(F.broadcast(known), "event_type")  # one row per type
    exact = met.groupBy("event_type").agg(
        F.count_distinct("day").alias("days"), F.count("value").alias("n"), F.count_distinct("value").alias("exact"),
        F.first("distinct").alias("distinct"),
        *[F.avg((F.col("value") < F.col(p)).cast("int")).alias(f"{p}_below") for p in probs],
        *[F.avg((F.col("value") <= F.col(p)).cast("int")).alias(f"{p}_upto") for p in probs],
    )
    ok = [
        ((F.col(f"{n}_below") <= p + 0.015) & (F.col(f"{n}_upto") >= p - 0.015)).alias(f"{n}_ok") for n, p in probs.items()
    ]
    near = F.abs(F.col("distinct") - F.col("exact")) <= 0.035 * F.col("exact")
    return exact.select("event_type", "days", "n", near.alias("distinct_ok"), *ok)


PAUSE = 6 * 3600
CTES["signals"] = "SELECT batch_id AS key, ts, event_type IN ('error', 'click', 'view') AS active FROM readings"
CTES["signal_mark"] = "SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM readings"
CTES["signal_steps"] = f"""
SELECT key, ts, active, CASE WHEN active AND coalesce(lag(active) OVER w, false)
                              AND epoch_us(ts) - epoch_us(lag(ts) OVER w) <= {PAUSE * 1_000_000} THEN 0 ELSE 1 END AS fresh
FROM signals, signal_mark WHERE ts <= mark WINDOW w AS (PARTITION BY key ORDER BY ts, active DESC)"""
CTES["signal_runs"] = """
SELECT key, run, bool_and(active) AS active, min(ts) AS started, max(ts) AS ended, count(*) AS rows,
       lead(min(ts)) OVER (PARTITION BY key ORDER BY run) AS next
FROM (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts, active DESC ROWS UNBOUNDED PRECEDING) AS run FROM signal_steps)
GROUP BY key, run"""


@query(
    oracle=f"""SELECT key, {sql_moment('started', 'started')}, {sql_moment('ended', 'ended')}, rows FROM signal_runs, signal_mark
               WHERE active AND (next IS NOT NULL OR epoch_us(ended) + {PAUSE * 1_000_000} < epoch_us(mark))"""
)
def stream_episodes(t):
    """Episodes of activity per batch from a stream of readings, with late rows and timers."""
    rows = t.spark.sql(EXTRA["readings"], events=t.arriving("events"))
    signals = rows.select(
        F.col("batch_id").alias("key"), F.col("ts").alias("timestamp"), F.col("event_type").isin("error", "click", "view").alias("active")
    )
    out = episodes.finished_episodes(t.spark, signals, PAUSE, "1 hour")
    return out.select("key", moment("started"), moment("ended"), "rows")

"""Batch quality, joins, trends, drift and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge import fixed_values as fv
from plantgauge.catalog.base import CTES, query
from plantgauge.catalog.cleaning import sql_category, sql_defective
from plantgauge.operators import batch
from plantgauge.sources.driver_views import Tables

DEF = f"CAST({sql_defective('label')} AS INTEGER)"
TEL = fv.TELEMETRY

CTES["batch_quality"] = f"""
SELECT batch_id, count(unit_id) AS total_units, CAST(sum({DEF}) AS BIGINT) AS defect_count,
       sum({DEF}) / greatest(1, count(unit_id))::DOUBLE AS defect_rate FROM inspection GROUP BY batch_id"""
CTES["telemetry_means"] = (
    "SELECT batch_id, " + ", ".join(f"avg({c}) AS {c}" for c in TEL) + " FROM process GROUP BY batch_id"
)
CTES["production_sums"] = """
SELECT batch_id, CAST(sum(wip) AS BIGINT) AS wip, sum(downtime_hours) AS downtime_hours,
       CAST(sum(rework_units) AS BIGINT) AS rework_units, CAST(sum(scrap_units) AS BIGINT) AS scrap_units
FROM production GROUP BY batch_id"""
CTES["category_rates"] = f"""
SELECT c.batch_id, category, count, count / greatest(1, total_units)::DOUBLE AS rate
FROM (SELECT batch_id, trim(defect_category) AS category, count(*) AS count FROM inspection
      WHERE {sql_category('defect_category')} GROUP BY ALL) c JOIN batch_quality q ON c.batch_id = q.batch_id"""
CTES["dominant_variants"] = """
SELECT batch_id, coalesce(variant, 'Unknown') AS dominant_variant FROM (
  SELECT batch_id, variant, row_number() OVER (PARTITION BY batch_id ORDER BY variant IS NULL, n DESC, variant) AS k
  FROM (SELECT batch_id, variant, count(*) AS n FROM inspection GROUP BY ALL)) WHERE k = 1"""
CTES["batch_table"] = """
SELECT q.batch_id, total_units AS total_inspected, defect_count, defect_rate,
       greatest(0, total_units - defect_count) AS conforming_count, dominant_variant, first_ts,
       temperature, speed, pressure, vibration, wip, downtime_hours, rework_units, scrap_units
FROM batch_quality q
LEFT JOIN dominant_variants USING (batch_id)
LEFT JOIN (SELECT batch_id, min(timestamp) AS first_ts FROM inspection GROUP BY batch_id) USING (batch_id)
LEFT JOIN telemetry_means USING (batch_id) LEFT JOIN production_sums USING (batch_id)"""
CTES["batches_in_time"] = """
SELECT batch_id, first_ts, total_inspected AS units, defect_count AS defects, defect_rate FROM batch_table"""
CTES["drift"] = """
SELECT parameter, batch_id, x, avg(x) OVER p AS mean, stddev_pop(x) OVER p AS std, defect_rate
FROM (UNPIVOT (SELECT batch_id, defect_rate, temperature, speed, pressure, vibration FROM batch_table)
      ON temperature, speed, pressure, vibration INTO NAME parameter VALUE x)
WINDOW p AS (PARTITION BY parameter)"""

# the categories of the view
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def table(t: Tables, categories=()):
    return batch.batch_table(t.inspection, t.process, t.production, categories)


@query(oracle="SELECT * FROM batch_quality", doubles="defect_rate")
def batch_quality(t):
    return batch.batch_quality(t.inspection)


@query(
    oracle="""SELECT p.batch_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ts, temperature, speed, pressure,
                     vibration, total_units, defect_count, defect_rate, wip AS total_wip,
                     downtime_hours AS total_downtime, rework_units AS batch_rework, scrap_units AS batch_scrap
              FROM process p JOIN batch_quality q ON p.batch_id = q.batch_id
              LEFT JOIN production_sums s ON p.batch_id = s.batch_id""",
    doubles="temperature speed pressure vibration defect_rate total_downtime",
)
def batch_joined(t):
    out = batch.batch_joined(t.inspection, t.process, t.production)
    return out.withColumn("ts", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).drop("timestamp")


@query(oracle="SELECT * FROM category_rates", doubles="rate")
def batch_category_rates(t):
    return batch.category_counts_by_batch(t.inspection)


@query(
    oracle=f"""SELECT b.* EXCLUDE (first_ts), strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_seen, c.* EXCLUDE (batch_id)
               FROM batch_table b JOIN (
                 SELECT b.batch_id, {', '.join(
                   f"coalesce(max(r.count) FILTER (category = '{n}'), 0) AS \"count_{n}\", "
                   f"floor(coalesce(max(r.rate) FILTER (category = '{n}'), 0.0) * 1e6 + 0.5001) / 1e6 AS \"rate_{n}\"" for n in BRANDS)}
                 FROM batch_table b LEFT JOIN category_rates r ON b.batch_id = r.batch_id GROUP BY b.batch_id) c
               ON b.batch_id = c.batch_id""",
    doubles="defect_rate temperature speed pressure vibration downtime_hours",
)
def batch_table(t):
    return table(t, None).withColumn("first_seen", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss")).drop("first_ts")


@query(
    oracle="""SELECT 'inspection' AS source, count(*) AS n FROM inspection WHERE batch_id BETWEEN 'B00002' AND 'B00007'
              UNION ALL SELECT 'process', count(*) FROM process WHERE batch_id BETWEEN 'B00002' AND 'B00007'
              UNION ALL SELECT 'production', count(*) FROM production WHERE batch_id BETWEEN 'B00002' AND 'B00007'"""
)
def batch_range_filter(t):
    parts = [
        batch.batch_range(df, "B00002", "B00007").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("source"), "n")
        for n, df in (("inspection", t.inspection), ("process", t.process), ("production", t.production))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    oracle="""SELECT batch_id, count(*) AS n FROM process WHERE batch_id IN (
                SELECT batch_id FROM inspection GROUP BY batch_id
                HAVING min(timestamp) BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-01-31') GROUP BY ALL"""
)
def batch_time_filter(t):
    out = batch.batch_time_range(
        t.process, t.inspection, F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-01-31").cast("timestamp_ntz")
    )
    return out.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    oracle=f"""SELECT batch_id, step, steps, steps - step AS remaining, units, defects, defect_rate, cumulative_units,
                      cumulative_defects, cumulative_defects / cumulative_units::DOUBLE AS cumulative_rate,
                      defect_rate > cumulative_defects / cumulative_units::DOUBLE * {fv.ALERT_RATIO}::DOUBLE AS is_alert
               FROM (SELECT *, row_number() OVER w AS step, count(*) OVER () AS steps,
                            CAST(sum(units) OVER w AS BIGINT) AS cumulative_units,
                            CAST(sum(defects) OVER w AS BIGINT) AS cumulative_defects
                     FROM batches_in_time WINDOW w AS (ORDER BY first_ts, batch_id ROWS UNBOUNDED PRECEDING))""",
    doubles="defect_rate cumulative_rate",
)
def batch_replay(t):
    return batch.batch_replay(t.inspection)


@query(
    oracle=f"""SELECT batch_id, units, defects, defect_rate, avg(defect_rate) OVER () AS mean_rate,
                      defect_rate > avg(defect_rate) OVER () * {fv.ALERT_RATIO}::DOUBLE AS is_alert FROM batches_in_time""",
    doubles="defect_rate mean_rate",
)
def batch_trend_flags(t):
    return batch.batch_trend_flags(t.inspection).drop("first_ts")


@query(
    oracle="""SELECT parameter, batch_id, x, mean, std, mean + 2 * std AS upper, mean - 2 * std AS lower,
                     abs(x - mean) > 2 * std AS is_outlier, defect_rate FROM drift""",
    doubles="x mean std upper lower defect_rate",
)
def drift_profile(t):
    return batch.drift_profile(table(t), TEL).drop("first_ts")


@query(
    oracle="""SELECT parameter, batch_id, x, mean - 2 * std AS lower, mean + 2 * std AS upper, defect_rate
              FROM drift WHERE abs(x - mean) > 2 * std""",
    doubles="x lower upper defect_rate",
)
def outlier_batches(t):
    return batch.outlier_batches(table(t), TEL)


@query(
    oracle="""SELECT parameter, max(mean) AS mean, max(std) AS std, max(mean) - 2 * max(std) AS lower,
                     max(mean) + 2 * max(std) AS upper,
                     count(*) FILTER (WHERE abs(x - mean) > 2 * std) AS affected_batches_count,
                     coalesce(avg(defect_rate) FILTER (WHERE abs(x - mean) > 2 * std), 0.0) AS affected_defect_rate
              FROM drift GROUP BY parameter""",
    doubles="mean std lower upper affected_defect_rate",
)
def affected_rates(t):
    return batch.affected_rates(table(t), TEL)


@query(
    oracle=f"""SELECT 'total' AS section, 'total_units' AS name, count(*) AS count FROM inspection
               UNION ALL SELECT 'total', 'defective_units', CAST(sum({DEF}) AS BIGINT) FROM inspection
               UNION ALL SELECT 'total', 'unique_batches', count(DISTINCT batch_id) FROM inspection
               UNION ALL SELECT 'variant', variant, count(*) FROM inspection WHERE variant IS NOT NULL GROUP BY ALL
               UNION ALL SELECT 'category', defect_category, count(*) FROM inspection
                         WHERE {DEF} = 1 AND defect_category IS NOT NULL GROUP BY ALL"""
)
def source_stats_inspection(t):
    return batch.inspection_stats(t.inspection)


@query(
    oracle="""SELECT parameter, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, median(x) AS median
              FROM (UNPIVOT (SELECT temperature, speed, pressure, vibration FROM process)
                    ON temperature, speed, pressure, vibration INTO NAME parameter VALUE x) GROUP BY parameter""",
    doubles="mean std min max median",
)
def source_stats_process(t):
    return batch.process_stats(t.process)


@query(
    oracle="""SELECT coalesce(station, 'ALL') AS station, CAST(grouping(station) AS TINYINT) AS is_total,
                     CAST(sum(units_in) AS BIGINT) AS total_units_in, CAST(sum(units_out) AS BIGINT) AS total_units_out,
                     CAST(sum(scrap_units) AS BIGINT) AS total_scrap, CAST(sum(rework_units) AS BIGINT) AS total_rework,
                     sum(downtime_hours) AS total_downtime_hours,
                     sum(units_out) / greatest(1, sum(units_in))::DOUBLE * 100.0 AS yield_pct,
                     avg(capacity) AS mean_capacity, avg(wip) AS mean_wip
              FROM production GROUP BY ROLLUP (station)""",
    doubles="total_downtime_hours yield_pct mean_capacity mean_wip",
)
def source_stats_production(t):
    return batch.production_stats(t.production)


@query(
    oracle=f"""SELECT count(DISTINCT batch_id) AS batches,
                      count(DISTINCT CASE WHEN {sql_category('defect_category')} THEN trim(defect_category) END) AS categories,
                      count(DISTINCT variant) AS variants FROM inspection"""
)
def distinct_keys(t):
    return batch.distinct_keys(t.inspection)

"""Remapping, cleaning and validation of the raw views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge import fixed_values as fv
from plantgauge.catalog.base import CTES, query
from plantgauge.functions.columns import annotation, has_category, is_defective
from plantgauge.operators import clean
from plantgauge.operators.prefix import medians

WORDS = ", ".join(f"'{w}'" for w in fv.DEFECTIVE_WORDS)
EMPTY = ", ".join(f"'{w}'" for w in fv.NO_CATEGORY_WORDS)


def sql_defective(c: str) -> str:
    return f"coalesce(lower(trim(CAST({c} AS VARCHAR))) IN ({WORDS}), false)"


def sql_category(c: str) -> str:
    return f"coalesce(lower(trim({c})) NOT IN ({EMPTY}), false)"


CTES["filled_times"] = f"""
SELECT unit_id, coalesce(
         last_value(timestamp IGNORE NULLS) OVER (ORDER BY unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         first_value(timestamp IGNORE NULLS) OVER (ORDER BY unit_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         TIMESTAMP '{fv.DEFAULT_TIMESTAMP}') AS timestamp
FROM inspection"""
CTES["clean_inspection"] = f"""
SELECT i.unit_id, batch_id, coalesce(variant, '{fv.DEFAULT_VARIANT}') AS variant, f.timestamp,
       CAST({sql_defective('label')} AS INTEGER) AS label,
       CASE WHEN NOT {sql_defective('label')} THEN 'None' ELSE coalesce(defect_category, 'None') END AS defect_category,
       roughness_ra, dimension_delta_mm, optical_score
FROM inspection i JOIN filled_times f ON i.unit_id = f.unit_id"""
CTES["telemetry_medians"] = """
SELECT coalesce(median(temperature), 0.0) AS mt, coalesce(median(speed), 0.0) AS ms,
       coalesce(median(pressure), 0.0) AS mp, coalesce(median(vibration), 0.0) AS mv FROM process"""
CTES["clean_process"] = """
SELECT batch_id, timestamp, coalesce(temperature, mt) AS temperature, coalesce(speed, ms) AS speed,
       coalesce(pressure, mp) AS pressure, coalesce(vibration, mv) AS vibration
FROM process, telemetry_medians"""

# organizer-style names over the inspection view, to be mapped back
RENAMED = {
    "unit_id": " Part ID",
    "batch_id": "Lot_ID",
    "variant": "Model",
    "timestamp": "inspection time",
    "label": "Pass_Fail",
    "defect_category": "Failure Mode",
}


@query(
    oracle="""SELECT unit_id, batch_id, variant, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts, label,
                     defect_category, roughness_ra, dimension_delta_mm, optical_score FROM clean_inspection""",
    doubles="roughness_ra dimension_delta_mm optical_score",
)
def schema_remap_clean(t):
    raw = t.inspection.withColumnsRenamed(RENAMED)
    out = clean.clean_inspection(clean.add_missing(clean.remap_columns(raw, "inspection"), "inspection"), ["unit_id"])
    return out.select(
        "unit_id", "batch_id", "variant", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), "label",
        "defect_category", *fv.MEASUREMENTS,
    )


@query(
    oracle=f"""SELECT label AS raw_label, CAST({sql_defective('label')} AS INTEGER) AS label, count(*) AS n
               FROM inspection GROUP BY ALL"""
)
def label_standardise(t):
    rows = t.inspection.select(F.col("label").alias("raw_label"), is_defective("label").cast("int").alias("label"))
    return rows.groupBy("raw_label", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    oracle="""SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ts, batch_id, temperature, speed, pressure, vibration
              FROM clean_process""",
    doubles="temperature speed pressure vibration",
)
def impute_median(t):
    out = clean.impute_medians(t.process, fv.TELEMETRY)
    return out.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "batch_id", *fv.TELEMETRY)


@query(
    oracle="SELECT median(temperature) AS temperature, median(speed) AS speed, median(pressure) AS pressure,"
    " median(vibration) AS vibration FROM process",
    doubles="temperature speed pressure vibration",
)
def telemetry_medians(t):
    middle = medians(t.process, fv.TELEMETRY)
    return t.spark.range(1).select(*[F.lit(v).cast("double").alias(c) for c, v in middle.items()])


@query(oracle="SELECT unit_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts FROM filled_times")
def ts_fill(t):
    out = clean.fill_timestamps(t.inspection.select("unit_id", "timestamp"), ["unit_id"])
    return out.select("unit_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(
    oracle="""SELECT station, station AS station_id, station AS station_name, batch_id,
                     capacity AS nominal_capacity_uph, cycle_time AS cycle_time_sec, wip AS wip_count,
                     downtime_hours * 60.0 AS downtime_min, rework_units AS rework_count, scrap_units AS scrap_count
              FROM production""",
    doubles="nominal_capacity_uph cycle_time_sec downtime_min",
)
def alias_columns(t):
    out = clean.add_companions(t.production, "production")
    return out.select(
        "station", "station_id", "station_name", "batch_id", "nominal_capacity_uph", "cycle_time_sec", "wip_count",
        "downtime_min", "rework_count", "scrap_count",
    )


@query(
    oracle=f"""SELECT CASE WHEN embedding_text <> '[]' THEN '{fv.BBOX_PRESENT}' ELSE '{fv.BBOX_ABSENT}' END AS annotation,
                      count(*) AS n
               FROM (SELECT CASE WHEN l_returnflag = 'R' THEN
                              '[' || l_linenumber || ',' || l_linenumber || ',' || CAST(l_quantity AS BIGINT) || ',' ||
                              CAST(l_quantity AS BIGINT) || ']' ELSE '[]' END AS embedding_text FROM lineitem)
               GROUP BY ALL"""
)
def bbox_provenance(t):
    side = F.col("l_quantity").cast("long").cast("string")
    corner = F.col("l_linenumber").cast("string")
    box = F.concat(F.lit("["), F.concat_ws(",", corner, corner, side, side), F.lit("]"))
    rows = t.base("lineitem").select(F.when(F.col("l_returnflag") == "R", box).otherwise("[]").alias("bbox"))
    return rows.groupBy(annotation("bbox").alias("annotation")).agg(F.count(F.lit(1)).alias("n"))


@query(
    oracle=f"""SELECT trim(defect_category) AS category, count(*) AS n FROM inspection
               WHERE {sql_category('defect_category')} GROUP BY ALL"""
)
def category_clean(t):
    rows = t.inspection.where(has_category("defect_category"))
    return rows.groupBy(F.trim("defect_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    oracle="""SELECT event_id, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.0 END AS score
              FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)""",
    doubles="score",
)
def score_minmax(t):
    from plantgauge.operators.neighbors import min_max

    return min_max(t.base("events").select("event_id", "value"), "value", "score").select("event_id", "score")


@query(
    oracle="""SELECT 'inspection' AS dataset, true AS is_valid, 0 AS missing, (SELECT count(*) FROM inspection) AS initial_rows
              UNION ALL SELECT 'process', true, 0, (SELECT count(*) FROM process)
              UNION ALL SELECT 'production', false, 1, (SELECT count(*) FROM production)
              UNION ALL SELECT 'economic', true, 0, 1"""
)
def validation_report(t):
    parts = [
        clean.validation_row(t.inspection.withColumnsRenamed(RENAMED), "inspection"),
        clean.validation_row(t.process, "process"),
        clean.validation_row(t.production.drop("capacity"), "production"),
        clean.validation_row(t.economic, "economic"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("dataset", "is_valid", F.size("missing_columns").alias("missing"), "initial_rows")

"""Cleaning of raw tables as they come: several sources of one column, absent columns, numbers
as text, null unit ids and named variants, made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge import fixed_values as fv
from plantgauge.catalog.base import CTES, query
from plantgauge.operators import clean, features

MESSY = {
    # half of the lot names stand in another column, one unit id in nine is missing
    "messy_units": """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
                 CAST(l_extendedprice AS STRING)) AS row_id,
       CASE WHEN l_tax = 0.03 THEN NULL ELSE concat('P', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS part_id,
       CASE WHEN l_linenumber % 2 = 0 THEN concat('L', CAST(l_suppkey AS STRING)) END AS batch,
       CASE WHEN l_linenumber % 2 = 1 THEN concat('L', CAST(l_suppkey AS STRING)) END AS lot_id,
       CASE l_linenumber WHEN 1 THEN 'Alpha-2' WHEN 2 THEN 'model BETA' WHEN 3 THEN 'gamma' WHEN 4 THEN NULL ELSE 'Delta' END AS model,
       CASE WHEN l_returnflag = 'R' THEN 'Fail' WHEN l_returnflag = 'A' THEN ' 0 ' ELSE NULL END AS pass_fail,
       l_quantity AS roughness_ra
FROM {lineitem}""",
    # numbers as text with faults, no speed at all, two pressure sources
    "messy_readings": """
SELECT event_id, concat('L', CAST(user_id AS STRING)) AS lot_id, ts AS datetime,
       CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'NaN' ELSE CAST(value AS STRING) END AS temp,
       CASE WHEN event_type = 'view' THEN value END AS press, CASE WHEN event_type = 'click' THEN value * 2 END AS pressure_bar,
       CASE WHEN event_type = 'error' THEN value END AS vib
FROM {events}""",
}
for name, text in MESSY.items():
    CTES[name] = text.replace("{", "").replace("}", "")
_NUMBER = "CASE WHEN NOT isnan(TRY_CAST(temp AS DOUBLE)) THEN TRY_CAST(temp AS DOUBLE) END"
CTES["messy_numbers"] = f"""
SELECT event_id, lot_id AS batch_id, datetime AS timestamp, {_NUMBER} AS temperature, NULL::DOUBLE AS speed,
       coalesce(press, pressure_bar) AS pressure, vib AS vibration FROM messy_readings"""
CTES["messy_ids"] = f"""
SELECT row_id, coalesce(part_id, 'U' || ({fv.FIRST_FALLBACK_UNIT} + row_number() OVER (ORDER BY row_id) - 1)) AS unit_id, coalesce(batch, lot_id) AS batch_id,
       coalesce(model, '{fv.DEFAULT_VARIANT}') AS variant, CAST(coalesce(pass_fail = 'Fail', false) AS INTEGER) AS label, roughness_ra FROM messy_units"""


def messy_units(t):
    return t.spark.sql(MESSY["messy_units"], lineitem=t.base("lineitem"))


def messy_readings(t):
    return t.spark.sql(MESSY["messy_readings"], events=t.base("events"))


@query(
    oracle=f"""SELECT row_id, unit_id, batch_id, variant, label, 'None' AS defect_category, strftime(TIMESTAMP '{fv.DEFAULT_TIMESTAMP}', '%Y-%m-%d %H:%M:%S') AS ts
               FROM messy_ids"""
)
def messy_inspection(t):
    """Two lot columns made one, missing columns added, null unit ids numbered in order."""
    out = clean.canonical(messy_units(t), "inspection", ["row_id"])
    return out.select(
        "row_id", "unit_id", "batch_id", "variant", "label", "defect_category",
        F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts"),
    )


@query(
    oracle="""SELECT event_id, batch_id, coalesce(temperature, (SELECT median(temperature) FROM messy_numbers), 0.0) AS temperature, 0.0::DOUBLE AS speed,
                     coalesce(pressure, (SELECT median(pressure) FROM messy_numbers), 0.0) AS pressure,
                     coalesce(vibration, (SELECT median(vibration) FROM messy_numbers), 0.0) AS vibration FROM messy_numbers""",
    doubles="temperature speed pressure vibration",
)
def messy_telemetry(t):
    """Text coerced to numbers, faults and gaps filled with the median, an absent column with 0."""
    return clean.canonical(messy_readings(t), "process", ["event_id"]).select("event_id", "batch_id", *fv.TELEMETRY)


@query(
    oracle="""SELECT variant, count(*) AS n, sum(CAST(lower(variant) LIKE '%alpha%' AS INTEGER))::BIGINT AS alpha,
                     sum(CAST(lower(variant) LIKE '%beta%' AS INTEGER))::BIGINT AS beta,
                     sum(CAST(lower(variant) LIKE '%gamma%' AS INTEGER))::BIGINT AS gamma FROM messy_ids GROUP BY variant"""
)
def variant_flags(t):
    """Flags of the named variants."""
    rows, _ = features.tabular(clean.canonical(messy_units(t), "inspection", ["row_id"]))
    flags = [F.sum(f"variant_is_{v}").cast("long").alias(v) for v in ("alpha", "beta", "gamma")]
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), *flags)

"""The four manufacturing tables and the feature table as views over the test tables.

The text is plain SQL that Spark and a checking engine read alike; the named
tables in braces are filled in by whoever runs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "inspection": """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                 CAST(l_suppkey AS STRING), CAST(l_extendedprice AS STRING)) AS unit_id,
       concat('B', lpad(CAST(l_suppkey AS STRING), 5, '0')) AS batch_id,
       CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN NULL ELSE p_type END AS variant,
       CASE WHEN l_linenumber = 3 AND l_tax = 0 THEN NULL ELSE l_shipdate END AS timestamp,
       CASE WHEN l_returnflag = 'R' AND l_discount >= 0.05 THEN 'FAIL'
            WHEN l_returnflag = 'A' AND l_discount >= 0.09 THEN ' ng '
            WHEN l_returnflag = 'N' AND l_tax = 0 THEN NULL
            ELSE 'pass' END AS label,
       CASE WHEN l_tax = 0.08 THEN NULL ELSE p_brand END AS defect_category,
       l_quantity AS roughness_ra, l_discount AS dimension_delta_mm, l_tax AS optical_score
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "process": """
SELECT concat('B', lpad(CAST(user_id AS STRING), 5, '0')) AS batch_id, ts AS timestamp,
       CASE WHEN event_type = 'view'     THEN value END AS temperature,
       CASE WHEN event_type = 'click'    THEN value END AS speed,
       CASE WHEN event_type = 'purchase' THEN value END AS pressure,
       CASE WHEN event_type = 'signup'   THEN value END AS vibration
FROM {events}""",
    "production": """
SELECT concat('Station ', CAST(l_linenumber AS STRING)) AS station,
       concat('B', lpad(CAST(l_suppkey AS STRING), 5, '0')) AS batch_id,
       CAST(18 + 4 * MAX(l_linenumber) AS DOUBLE) AS cycle_time,
       CAST(3600 AS DOUBLE) / CAST(18 + 4 * MAX(l_linenumber) AS DOUBLE) AS capacity,
       CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS wip,
       CAST(SUM(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) / CAST(100 AS DOUBLE) AS downtime_hours,
       CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units_in,
       CAST(SUM(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS BIGINT) AS units_out,
       CAST(SUM(CASE WHEN l_returnflag = 'R' AND l_discount < 0.03 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS rework_units,
       CAST(SUM(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS scrap_units
FROM {lineitem} GROUP BY l_linenumber, l_suppkey""",
    "economic": """
SELECT CAST(85 AS DOUBLE) AS unit_price, CAST(32 AS DOUBLE) AS material_cost, CAST(45 AS DOUBLE) AS labor_cost,
       CAST(30 AS DOUBLE) AS overhead_cost, CAST(42 AS DOUBLE) AS scrap_cost, CAST(18.5 AS DOUBLE) AS rework_cost,
       CAST(150 AS DOUBLE) AS downtime_cost_per_hour""",
    "features": """
SELECT vec_id, embedding, label,
       CASE WHEN label = 0 THEN 'normal' ELSE concat('defect_', CAST(label AS STRING)) END AS category
FROM {embeddings}""",
}
SOURCES = {
    "inspection": ["lineitem", "part"],
    "process": ["events"],
    "production": ["lineitem"],
    "economic": [],
    "features": ["embeddings"],
}


class Tables:
    """Lazy access to the test tables of one folder and to the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def arriving(self, name: str, **options) -> DataFrame:
        """A table read as a stream. The pattern matches its one name: a stream takes a table
        that is a single file only by a pattern, and a folder of files as well."""
        reader = self.spark.readStream.schema(self.base(name).schema).options(**options)
        return reader.parquet(f"{self.folder}/{name}.parque[t]")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.spark.sql(VIEWS[name], **{s: self.base(s) for s in SOURCES[name]})

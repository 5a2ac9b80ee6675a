"""Batch-level quality, joins, trends and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plantgauge import fixed_values as fv
from plantgauge.functions.columns import has_category, is_defective, per_unit
from plantgauge.operators.bounds import column_values
from plantgauge.operators.prefix import percentiles, running

NOT_PARAMETERS = {
    "batch_id", "timestamp", "unit_id", "total_inspected", "defect_count", "defect_rate", "conforming_count",
    "dominant_variant", "variant", "variant_id", "wip", "downtime_hours", "rework_units", "scrap_units", "first_ts",
}


def defect_flag(df: DataFrame) -> Column:
    return is_defective("label" if "label" in df.columns else "is_defective").cast("int")


def category_column(df: DataFrame) -> str | None:
    return next((c for c in ("defect_category", "defect_family") if c in df.columns), None)


def batch_quality(inspection: DataFrame) -> DataFrame:
    """batch_id, total_units (non-null ids), defect_count, defect_rate."""
    unit = "unit_id" if "unit_id" in inspection.columns else "batch_id"
    return (
        inspection.where(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(F.count(unit).alias("total_units"), F.sum(defect_flag(inspection)).alias("defect_count"))
        .withColumn("defect_rate", per_unit(F.col("defect_count"), F.col("total_units")))
    )


def telemetry_columns(process: DataFrame) -> list[str]:
    return [
        f.name
        for f in process.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in ("batch_id", "timestamp")
    ]


def telemetry_means(process: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns or telemetry_columns(process))
    return process.groupBy("batch_id").agg(*[F.avg(c).alias(c) for c in cols])


def production_sums(production: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    cols = names or {c: c for c in ("wip", "downtime_hours", "rework_units", "scrap_units") if c in production.columns}
    return production.groupBy("batch_id").agg(*[F.sum(c).alias(a) for c, a in cols.items()])


def batch_joined(inspection: DataFrame, process: DataFrame, production: DataFrame | None = None) -> DataFrame:
    """Batch quality with each process row of the batch, and the production sums.

    Process rows stay as they are, so a hot batch is a skewed join side; the
    other sides have one row per batch and adaptive execution splits the hot one.
    """
    out = process.join(batch_quality(inspection), "batch_id", "inner")
    if production is not None:
        sums = production_sums(
            production,
            {
                "wip": "total_wip",
                "downtime_hours": "total_downtime",
                "rework_units": "batch_rework",
                "scrap_units": "batch_scrap",
            },
        )
        out = out.join(sums, "batch_id", "left")
    return out


def category_counts_by_batch(inspection: DataFrame) -> DataFrame:
    """Long form: batch_id, category, count, rate; only pairs that occur."""
    cat = category_column(inspection)
    known = has_category(cat)
    rows = inspection.where(F.col("batch_id").isNotNull()).select(
        F.col("batch_id").cast("string").alias("batch_id"),
        F.when(known, F.trim(F.col(cat))).alias("category"),
    )
    counted = rows.groupBy("batch_id", "category").agg(F.count(F.lit(1)).alias("count"))
    sizes = counted.groupBy("batch_id").agg(F.sum("count").alias("_n"))
    return (
        counted.where(F.col("category").isNotNull())
        .join(sizes, "batch_id")
        .select("batch_id", "category", "count", per_unit(F.col("count"), F.col("_n")).alias("rate"))
    )


def dominant_variants(inspection: DataFrame) -> DataFrame:
    """The most frequent variant per batch, ties to the smallest; counted before grouping."""
    column = "variant" if "variant" in inspection.columns else "variant_id"
    counted = inspection.groupBy("batch_id", F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(F.col("batch_id").cast("string").alias("batch_id")).agg(
        F.coalesce(
            F.min_by("_v", F.when(F.col("_v").isNotNull(), F.struct(-F.col("_n"), F.col("_v")))), F.lit("Unknown")
        ).alias("dominant_variant")
    )


def batch_table(
    inspection: DataFrame,
    process: DataFrame | None = None,
    production: DataFrame | None = None,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """One wide row per batch: quality, rate_/count_ per category, telemetry, production.

    ``categories`` fixes the category columns; without it they are looked up.
    """
    cat = category_column(inspection)
    rows = inspection.where(F.col("batch_id").isNotNull()).withColumns(
        {"batch_id": F.col("batch_id").cast("string"), "_defect": defect_flag(inspection)}
    )
    if cat:
        rows = rows.withColumn("_cat", F.when(has_category(cat), F.trim(F.col(cat))))
        if categories is None:
            categories = column_values(rows, "_cat")
    else:
        categories = []
    counts = [F.count(F.when(F.col("_cat") == c, 1)).alias(f"count_{c}") for c in categories]
    first = [F.min("timestamp").alias("first_ts")] if "timestamp" in rows.columns else []
    table = rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_inspected"), F.sum("_defect").alias("defect_count"), *counts, *first
    )
    n, d = F.col("total_inspected"), F.col("defect_count")
    table = table.withColumns(
        {
            "defect_rate": per_unit(d, n),
            "conforming_count": F.greatest(F.lit(0), n - d),
            **{f"rate_{c}": per_unit(F.col(f"count_{c}"), n) for c in categories},
        }
    )
    if "variant" in inspection.columns or "variant_id" in inspection.columns:
        table = table.join(dominant_variants(inspection), "batch_id", "left")
    for side in (
        telemetry_means(process) if process is not None else None,
        production_sums(production) if production is not None and "batch_id" in production.columns else None,
    ):
        if side is not None:
            table = table.join(side.withColumn("batch_id", F.col("batch_id").cast("string")), "batch_id", "left")
    return table


def parameter_columns(table: DataFrame) -> list[str]:
    """Numeric columns that are process parameters."""
    return [
        f.name
        for f in table.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in NOT_PARAMETERS
        and not f.name.startswith(("rate_", "count_"))
    ]


def batch_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Inclusive range of batch ids; reaches the scan as a pushed filter."""
    return df.where(F.col("batch_id").between(first, last))


def batch_time_range(df: DataFrame, inspection: DataFrame, start, end) -> DataFrame:
    """Rows of the batches whose first inspection lies in [start, end]."""
    firsts = inspection.groupBy("batch_id").agg(F.min("timestamp").alias("_t")).where(F.col("_t").between(start, end))
    return df.join(firsts.select("batch_id"), "batch_id", "left_semi")


def _batches_in_time(inspection: DataFrame) -> DataFrame:
    return (
        inspection.where(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(
            F.min("timestamp").alias("first_ts"),
            F.count(F.lit(1)).alias("units"),
            F.sum(defect_flag(inspection)).alias("defects"),
        )
        .withColumn("defect_rate", per_unit(F.col("defects"), F.col("units")))
    )


def batch_replay(inspection: DataFrame) -> DataFrame:
    """Running totals as the batches arrive, with an alert against the running rate."""
    walked = running(
        _batches_in_time(inspection),
        [],
        ["first_ts", "batch_id"],
        {"u": "units", "d": "defects", "b": F.lit(1).cast("long")},
    )
    cum_units, cum_defects = F.col("before_u") + F.col("units"), F.col("before_d") + F.col("defects")
    return walked.select(
        "batch_id",
        (F.col("before_b") + 1).alias("step"),
        F.col("total_b").alias("steps"),
        (F.col("total_b") - F.col("before_b") - 1).alias("remaining"),
        "units",
        "defects",
        "defect_rate",
        cum_units.alias("cumulative_units"),
        cum_defects.alias("cumulative_defects"),
        per_unit(cum_defects, cum_units).alias("cumulative_rate"),
        (F.col("defect_rate") > per_unit(cum_defects, cum_units) * fv.ALERT_RATIO).alias("is_alert"),
    )


def batch_trend_flags(inspection: DataFrame) -> DataFrame:
    """Batch rates against the unweighted mean of the batch rates."""
    rates = _batches_in_time(inspection)
    mean = rates.agg(F.avg("defect_rate")).scalar()
    return rates.select(
        "batch_id",
        "first_ts",
        "units",
        "defects",
        "defect_rate",
        mean.alias("mean_rate"),
        (F.col("defect_rate") > mean * fv.ALERT_RATIO).alias("is_alert"),
    )


def unpivoted(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name="parameter", value="x") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), name, value
    )


def drift_profile(table: DataFrame, parameters: Sequence[str] | None = None) -> DataFrame:
    """parameter, batch, value, mean and 2-sigma limits, outlier flag, defect rate.

    The limits are one row per parameter, so they are joined by broadcast.
    """
    params = list(parameters or parameter_columns(table))
    ids = ["batch_id", "defect_rate"] + (["first_ts"] if "first_ts" in table.columns else [])
    long = unpivoted(table, ids, params).where(F.col("x").isNotNull())
    limits = long.groupBy("parameter").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    out = long.join(F.broadcast(limits), "parameter")
    return out.withColumns(
        {
            "upper": F.col("mean") + 2.0 * F.col("std"),
            "lower": F.col("mean") - 2.0 * F.col("std"),
            "is_outlier": F.abs(F.col("x") - F.col("mean")) > 2.0 * F.col("std"),
        }
    )


def outlier_batches(table: DataFrame, parameters: Sequence[str] | None = None) -> DataFrame:
    """The batches outside the limits, one row each (never a list per parameter)."""
    return (
        drift_profile(table, parameters)
        .where("is_outlier")
        .select("parameter", "batch_id", "x", "lower", "upper", "defect_rate")
    )


def affected_rates(table: DataFrame, parameters: Sequence[str] | None = None) -> DataFrame:
    """Per parameter: how many batches are outside the limits, and their mean defect rate."""
    profile = drift_profile(table, parameters)
    return profile.groupBy("parameter").agg(
        F.max("mean").alias("mean"),
        F.max("std").alias("std"),
        F.max("lower").alias("lower"),
        F.max("upper").alias("upper"),
        F.count(F.when(F.col("is_outlier"), 1)).alias("affected_batches_count"),
        F.coalesce(F.avg(F.when(F.col("is_outlier"), F.col("defect_rate"))), F.lit(0.0)).alias("affected_defect_rate"),
    )


# ---- descriptive statistics ----------------------------------------------


def inspection_stats(inspection: DataFrame) -> DataFrame:
    """section, name, count: totals, variants, and categories of the defective units."""
    flag = defect_flag(inspection)
    cat = category_column(inspection)
    base = inspection.select(
        "batch_id", "variant", flag.alias("_d"), F.when(flag == 1, F.col(cat)).alias("_cat")
    )
    pre = base.groupBy("batch_id", "variant", "_cat").agg(F.count(F.lit(1)).alias("n"), F.sum("_d").alias("d"))
    totals = pre.agg(
        F.sum("n").alias("total_units"),
        F.sum("d").alias("defective_units"),
        F.countDistinct("batch_id").alias("unique_batches"),
    ).unpivot([], ["total_units", "defective_units", "unique_batches"], "name", "count")
    parts = [totals.select(F.lit("total").alias("section"), "name", "count")]
    for section, column in (("variant", "variant"), ("category", "_cat")):
        parts.append(
            pre.where(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("name"))
            .agg(F.sum("n").alias("count"))
            .select(F.lit(section).alias("section"), "name", "count")
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def process_stats(process: DataFrame) -> DataFrame:
    """parameter, mean, std (population), min, max, median."""
    long = unpivoted(process, [], telemetry_columns(process)).where(F.col("x").isNotNull())
    simple = long.groupBy("parameter").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    middle = percentiles(long, ["parameter"], "x", {"median": 0.5}).select("parameter", "median")
    return simple.join(F.broadcast(middle), "parameter")  # one row per column


def production_stats(production: DataFrame) -> DataFrame:
    """Totals (station null) and one row per station, from one rollup."""
    station = F.col("station")
    return production.rollup("station").agg(
        F.grouping("station").alias("is_total"),
        F.sum("units_in").alias("total_units_in"),
        F.sum("units_out").alias("total_units_out"),
        F.sum("scrap_units").alias("total_scrap"),
        F.sum("rework_units").alias("total_rework"),
        F.sum("downtime_hours").alias("total_downtime_hours"),
        (F.sum("units_out") / F.greatest(F.lit(1), F.sum("units_in")) * 100.0).alias("yield_pct"),
        F.avg("capacity").alias("mean_capacity"),
        F.avg("wip").alias("mean_wip"),
    ).withColumn("station", F.when(F.col("is_total") == 1, F.lit("ALL")).otherwise(station))


def category_counts(inspection: DataFrame, defective_only: bool = True) -> DataFrame:
    """Categories by frequency, name breaking ties."""
    cat = category_column(inspection)
    keep = has_category(cat)
    if defective_only:
        keep = keep & (defect_flag(inspection) == 1)
    return (
        inspection.where(keep)
        .groupBy(F.col(cat).alias("category"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "category")
    )


def distinct_keys(inspection: DataFrame) -> DataFrame:
    cat = category_column(inspection)
    return inspection.agg(
        F.countDistinct("batch_id").alias("batches"),
        F.countDistinct(F.when(has_category(cat), F.trim(F.col(cat)))).alias("categories"),
        F.countDistinct("variant").alias("variants"),
    )

"""Station capacity, load, utilisation and the bottleneck, for any set of lines.

``by`` names the columns that separate lines; without it the table is one line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plantgauge import fixed_values as fv
from plantgauge.functions.columns import clamp, cycle_minutes, ratio, rounded


def _first_present(df: DataFrame, names: Sequence[str], default: float) -> Column:
    found = [F.col(n).cast("double") for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default)


def station_rollup(
    production: DataFrame,
    by: Sequence[str] = (),
    hours: float = fv.SHIFT_HOURS,
    hours_per_batch: float | None = None,
) -> DataFrame:
    """Batches rolled up per station: mean cycle time and WIP, sums of the rest.

    ``hours`` is the period the sums belong to. ``hours_per_batch`` instead
    counts that many hours for each batch of the line, so that downtime summed
    over many shifts is compared with many shifts.
    """
    rolled = production.groupBy(*by, "station").agg(
        F.avg("cycle_time").alias("cycle_time"),
        F.sum("downtime_hours").alias("downtime_hours"),
        F.sum("units_in").alias("units_in"),
        F.sum("units_out").alias("units_out"),
        F.sum("rework_units").alias("rework_units"),
        F.sum("scrap_units").alias("scrap_units"),
        F.avg("wip").alias("wip"),
    )
    if hours_per_batch is None:
        return rolled.withColumn("hours", F.lit(float(hours)))
    batches = production.groupBy(*by).agg(F.countDistinct("batch_id").alias("_b"))
    if by:
        out = rolled.join(batches, list(by))
        return out.withColumn("hours", F.col("_b") * F.lit(float(hours_per_batch))).drop("_b")
    return rolled.withColumn("hours", batches.scalar() * F.lit(float(hours_per_batch)))


def station_metrics(stations: DataFrame, by: Sequence[str] = (), hours: float = fv.SHIFT_HOURS) -> DataFrame:
    """Capacity, load and utilisation of each station row.

    capacity = 60/cycle * (1 - downtime), load = in * (1 + rework/out),
    utilisation = load / (capacity * hours).
    """
    h = F.col("hours") if "hours" in stations.columns else F.lit(float(hours))
    safe_h = F.greatest(h, F.lit(1e-4))
    cycle = cycle_minutes(_first_present(stations, ["cycle_time", "cycle_time_sec"], 1.0))
    if "downtime_fraction" in stations.columns:
        down = F.col("downtime_fraction").cast("double")
    elif "downtime_hours" in stations.columns:
        down = F.col("downtime_hours").cast("double") / safe_h
    elif "downtime_min" in stations.columns:
        down = F.col("downtime_min").cast("double") / 60.0 / safe_h
    else:
        down = F.lit(0.0)
    name = next((c for c in ("station", "station_name") if c in stations.columns), None)
    base = stations.select(
        *by,
        (F.col(name).cast("string") if name else F.lit("Station")).alias("station"),
        h.alias("hours"),
        cycle.alias("_ct"),
        clamp(F.coalesce(down, F.lit(0.0)), 0.0, 1.0).alias("_dt"),
        _first_present(stations, ["units_in"], 0.0).alias("_in"),
        _first_present(stations, ["units_out"], 0.0).alias("_out"),
        _first_present(stations, ["rework_units", "rework_count"], 0.0).alias("_rework"),
        _first_present(stations, ["scrap_units", "scrap_count"], 0.0).alias("_scrap"),
        _first_present(stations, ["wip", "wip_count"], 0.0).alias("_wip"),
    )
    base = base.withColumns(
        {"_cap": F.lit(60.0) / F.col("_ct") * (F.lit(1.0) - F.col("_dt")), "_rr": ratio(F.col("_rework"), F.col("_out"))}
    ).withColumn("_load", F.col("_in") * (F.lit(1.0) + F.col("_rr")))
    return base.select(
        *by,
        "station",
        "hours",
        rounded(F.col("_ct"), 4).alias("cycle_time"),
        rounded(F.col("_dt"), 4).alias("downtime_fraction"),
        rounded(F.col("_cap"), 2).alias("effective_capacity"),
        F.col("_in").cast("long").alias("units_in"),
        F.col("_out").cast("long").alias("units_out"),
        F.col("_rework").cast("long").alias("rework_units"),
        F.col("_scrap").cast("long").alias("scrap_units"),
        rounded(F.col("_rr"), 4).alias("rework_rate"),
        rounded(F.col("_load"), 2).alias("effective_load"),
        rounded(ratio(F.col("_load"), F.col("_cap") * F.col("hours")), 4).alias("utilization"),
        F.col("_wip").cast("long").alias("wip"),
    )


def _worst(metrics: DataFrame) -> Column:
    """The station with the highest (utilisation, wip, cycle time); name breaks ties."""
    fields = ["station", "hours", "cycle_time", "downtime_fraction", "effective_capacity", "units_in", "units_out",
              "rework_units", "scrap_units", "effective_load", "rework_rate", "utilization", "wip"]
    order = F.struct(-F.col("utilization"), -F.col("wip"), -F.col("cycle_time"), F.col("station"))
    return F.min_by(F.struct(*fields), order)


def evidence(b: Column) -> Column:
    return F.format_string(
        "%s: utilization %.0f%%, WIP %d, rework adds %.0f%% extra load",
        b["station"], b["utilization"] * 100.0, b["wip"], b["rework_rate"] * 100.0,
    )


def line_summary(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bottleneck, throughput with and without rework, and line totals; one row per line."""
    rows = metrics.groupBy(*by).agg(
        _worst(metrics).alias("b"),
        F.coalesce(F.sum("wip"), F.lit(0)).alias("total_wip"),
        F.coalesce(F.sum("scrap_units"), F.lit(0)).alias("total_scrap"),
        F.coalesce(F.sum("rework_units"), F.lit(0)).alias("total_rework"),
        F.count(F.lit(1)).alias("stations"),
        F.sum(F.col("downtime_fraction") * F.col("hours")).alias("downtime_hours"),
        F.max("hours").alias("hours"),
        F.sum(rounded(F.col("cycle_time") * 60.0, 1)).alias("total_line_cycle_time_sec"),
    )
    cap = F.coalesce(F.col("b.effective_capacity"), F.lit(0.0))
    with_rework = cap / (F.lit(1.0) + F.coalesce(F.col("b.rework_rate"), F.lit(0.0)))
    return rows.select(
        *by,
        F.col("b.station").alias("bottleneck_station"),
        F.col("b.utilization").alias("utilization"),
        F.col("b.wip").alias("wip"),
        F.col("b.rework_rate").alias("rework_rate"),
        F.when(F.col("b").isNull(), F.lit("No station data available")).otherwise(evidence(F.col("b"))).alias(
            "bottleneck_evidence"
        ),
        cap.alias("line_throughput"),
        cap.alias("throughput_without_rework"),
        rounded(with_rework, 2).alias("throughput_with_rework"),
        rounded(cap - with_rework, 2).alias("throughput_lost_due_to_rework"),
        "total_wip",
        "total_scrap",
        "total_rework",
        "stations",
        "hours",
        "downtime_hours",
        "total_line_cycle_time_sec",
    )


def bottleneck(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The constraining station of each line, all its figures."""
    return metrics.groupBy(*by).agg(_worst(metrics).alias("b")).select(*by, "b.*")


def littles_law(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected WIP = throughput * total cycle time, against the actual WIP."""
    expected = F.col("line_throughput") * (F.col("total_line_cycle_time_sec") / 3600.0)
    return summary.select(
        *by,
        "line_throughput",
        rounded(F.col("total_line_cycle_time_sec"), 1).alias("total_line_cycle_time_sec"),
        F.col("total_wip").alias("total_actual_wip"),
        rounded(expected, 1).alias("littles_law_expected_wip"),
        rounded(F.col("total_wip") - expected, 1).alias("wip_sanity_delta"),
    )


def utilization_split(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Utilisation in percent, split into first pass and rework."""
    total = F.col("utilization") * 100.0
    nominal = F.least(total, total / (F.lit(1.0) + F.col("rework_rate")))
    return metrics.select(
        *by,
        "station",
        rounded(nominal, 1).alias("nominal_utilization_pct"),
        rounded(F.greatest(F.lit(0.0), total - nominal), 1).alias("rework_utilization_pct"),
    )


def _with_worst(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mark the constraining station of each line (one row per line is joined back)."""
    worst = bottleneck(metrics, by).select(*by, F.col("station").alias("_worst"))
    if by:
        marked = metrics.join(worst, list(by))
        return marked.withColumn("is_bottleneck", F.col("station") == F.col("_worst")).drop("_worst")
    return metrics.withColumn("is_bottleneck", F.col("station") == worst.scalar())


def station_kpis(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-station report: nominal figures, headroom, downtime, bottleneck flag."""
    cap = F.col("effective_capacity")
    return _with_worst(metrics, by).select(
        *by,
        "station",
        rounded(F.lit(60.0) / F.greatest(F.lit(1e-4), F.col("cycle_time")), 1).alias("nominal_capacity_uph"),
        F.col("effective_capacity").alias("effective_capacity_uph"),
        rounded(F.col("cycle_time") * 60.0, 1).alias("cycle_time_sec"),
        F.col("wip").alias("wip_count"),
        rounded(F.col("downtime_fraction") * F.col("hours") * 60.0, 1).alias("downtime_min"),
        F.col("rework_units").alias("rework_count"),
        rounded(
            F.least(F.lit(100.0), F.col("units_in") / F.greatest(F.lit(1.0), cap * F.col("hours")) * 100.0), 1
        ).alias("nominal_utilization_pct"),
        rounded(F.col("rework_rate") * 100.0, 1).alias("rework_utilization_add"),
        rounded(F.col("utilization") * 100.0, 1).alias("total_effective_utilization_pct"),
        F.greatest(F.lit(0.0), rounded(cap - F.col("effective_load") / F.col("hours"), 1)).alias("headroom_uph"),
        "is_bottleneck",
    )

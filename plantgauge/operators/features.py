"""Tabular features of inspected units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plantgauge import fixed_values as fv
from plantgauge.functions.columns import sequence_number, to_number
from plantgauge.operators.batch import telemetry_means
from plantgauge.operators.bounds import small_side
from plantgauge.operators.clean import impute_medians

NOT_MEASUREMENTS = {
    "label", "is_defective", "unit_id", "batch_id", "variant", "variant_id", "timestamp", "defect_category",
    "defect_family", "image_path", "bbox", *fv.TELEMETRY,
}
VARIANTS = ["alpha", "beta", "gamma"]


def measurement_columns(inspection: DataFrame) -> list[str]:
    return [
        f.name
        for f in inspection.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in NOT_MEASUREMENTS
    ]


def tabular(inspection: DataFrame, process: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(inspection rows with feature columns, feature names in order).

    Batch telemetry means are joined to the units (one row per batch, sent to the
    units while few; else a hot batch only skews the inspection side), missing numbers become the column
    median, absent telemetry becomes 0.
    """
    rows = inspection
    if process is not None and "batch_id" in inspection.columns and "batch_id" in process.columns:
        present = [c for c in fv.TELEMETRY if c in process.columns]
        means = telemetry_means(process.withColumns({c: to_number(c) for c in present}), present)
        rows = rows.drop(*present).join(small_side(means), "batch_id", "left")
    telemetry = [c if c in rows.columns else f"default_{c}" for c in fv.TELEMETRY]
    rows = rows.withColumns({c: F.lit(0.0) for c in telemetry if c.startswith("default_")})
    measures = measurement_columns(inspection)
    rows = impute_medians(rows, [c for c in telemetry if not c.startswith("default_")] + measures)
    variant = next((c for c in ("variant", "variant_id") if c in rows.columns), None)
    if variant:
        text = F.lower(F.col(variant).cast("string"))
        flags = {f"variant_is_{v}": F.coalesce(text.contains(v), F.lit(False)).cast("double") for v in VARIANTS}
    else:
        flags = {"variant_unknown": F.lit(0.0)}
    rows = rows.withColumns(flags)
    names = [*telemetry, *flags, *measures]
    if "unit_id" in rows.columns:
        number = sequence_number("unit_id")
        ends = inspection.agg(F.struct(F.min(number).alias("low"), F.max(number).alias("high"))).scalar()
        width = F.greatest(F.lit(1.0), ends["high"] - ends["low"])
        rows = rows.withColumn("unit_seq_norm", F.coalesce((number - ends["low"]) / width, F.lit(0.0)))
        names.append("unit_seq_norm")
    return rows, names


def scale(rows: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (+1e-5) of each feature."""
    found = rows.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in names], *[(F.stddev_pop(c) + 1e-5).alias(f"std_{c}") for c in names]
    ).first()
    return {c: (found[f"mean_{c}"] or 0.0, found[f"std_{c}"] or 1e-5) for c in names}


def max_abs_z(rows: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Largest absolute z-score over the features."""
    z: list[Column] = [F.abs((F.col(c) - F.lit(mean)) / F.lit(std)) for c, (mean, std) in stats.items()]
    return rows.withColumn("anomaly_z", F.greatest(*z) if len(z) > 1 else z[0])

"""Column remapping, type coercion and missing-value rules of the four tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plantgauge import fixed_values as fv
from plantgauge.functions.columns import is_defective, to_number
from plantgauge.operators.prefix import filled, medians, numbered, patched


def alias_map(kind: str) -> dict[str, str]:
    """alias -> canonical name over all tables; the table's own aliases win."""
    out: dict[str, str] = {}
    for domain in [d for d in fv.ALIASES if d != kind] + ([kind] if kind in fv.ALIASES else []):
        for target, names in fv.ALIASES[domain].items():
            out.update({a: target for a in names})
    return out


def remap_columns(df: DataFrame, kind: str = "generic") -> DataFrame:
    """Normalise names and map aliases. Several sources of one target are
    coalesced in column order; minutes feeding an hours column are divided."""
    known = alias_map(kind.lower())
    sources: dict[str, list[Column]] = {}
    types: dict[str, set[str]] = {}
    for field in df.schema.fields:
        clean = field.name.strip().lower().replace(" ", "_")
        target = known.get(clean, clean)
        col = F.col(f"`{field.name}`")
        kind_name = field.dataType.simpleString()
        if clean in fv.MINUTE_ALIASES and target != clean:
            col, kind_name = to_number(col) / 60.0, "double"
        sources.setdefault(target, []).append(col)
        types.setdefault(target, set()).add(kind_name)
    out = []
    for target, cols in sources.items():
        if len(types[target]) > 1:
            cols = [c.cast("string") for c in cols]
        out.append((cols[0] if len(cols) == 1 else F.coalesce(*cols)).alias(target))
    return df.select(*out)


def missing_columns(df: DataFrame, kind: str) -> list[str]:
    present = set(df.columns)
    return [c for c in fv.EXPECTED[kind] if c not in present]


def add_missing(df: DataFrame, kind: str) -> DataFrame:
    """Expected columns that are absent come in as nulls."""
    return df.withColumns(
        {c: F.lit(None).cast("string" if c in fv.TEXT_COLUMNS else "double") for c in missing_columns(df, kind)}
    )


def validation_row(raw: DataFrame, kind: str) -> DataFrame:
    """One row: is the remapped table complete, what is missing, how many rows.

    Cleaning never drops a row, so one count serves both row columns.
    """
    remapped = remap_columns(raw, kind)
    missing = missing_columns(remapped, kind)
    expected = fv.EXPECTED[kind]
    if missing:
        text = (
            f"Validation Warning for '{kind}': Missing {len(missing)} required column(s): {missing}. "
            f"Present columns: {remapped.columns}."
        )
    else:
        text = f"Validation Success for '{kind}': All {len(expected)} required columns present."
    return raw.agg(F.count(F.lit(1)).alias("initial_rows")).select(
        F.lit(kind).alias("dataset"),
        F.lit(not missing).alias("is_valid"),
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"),
        F.lit(text).alias("validation_message"),
        "initial_rows",
        F.col("initial_rows").alias("cleaned_rows"),
    )


def _any_null(df: DataFrame, column: str) -> bool:
    return not df.where(F.col(column).isNull()).select(F.lit(1)).limit(1).isEmpty()


def fill_timestamps(df: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """Forward fill, then backward fill, then a constant; in ``row_key`` order."""
    if "timestamp" not in df.columns or not _any_null(df, "timestamp"):
        return df
    if df.where(F.col("timestamp").isNotNull()).select(F.lit(1)).limit(1).isEmpty():  # nothing to fill from, so no order
        return df.withColumn("timestamp", F.lit(fv.DEFAULT_TIMESTAMP).cast(df.schema["timestamp"].dataType))
    return filled(df, row_key, "timestamp", fv.DEFAULT_TIMESTAMP)


def fill_unit_ids(df: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """Null unit ids become U<1000 + position>; only those rows are joined back."""
    if "unit_id" not in df.columns:
        return df
    df = df.withColumn("unit_id", F.col("unit_id").cast("string"))
    if not _any_null(df, "unit_id"):
        return df
    spots = numbered(df.select(*row_key, "unit_id"), [], list(row_key)).where(F.col("unit_id").isNull())
    spots = spots.select(
        *[F.col(k).alias(f"_r_{k}") for k in row_key],
        F.concat(F.lit("U"), (F.lit(fv.FIRST_FALLBACK_UNIT) + F.col("row_index")).cast("string")).alias("_id"),
    )
    return patched(df, row_key, "unit_id", spots, F.col("_id"))


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coerce to numbers and fill with the column median, 0.0 if all null."""
    present = [c for c in columns if c in df.columns]
    df = df.withColumns({c: to_number(c) for c in present})
    if not present:
        return df
    middle = medians(df.select(*present), present)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(middle[c] or 0.0)) for c in present})


def standard_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("label", is_defective("label").cast("int"))


def clean_text(c: str, default: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(default))


def clean_inspection(df: DataFrame, row_key: Sequence[str]) -> DataFrame:
    out = fill_timestamps(fill_unit_ids(df, row_key), row_key)
    if "label" in out.columns:
        out = standard_labels(out)
    if "defect_category" in out.columns:
        category = clean_text("defect_category", fv.DEFAULT_CATEGORY)
        if "label" in out.columns:
            category = F.when(F.col("label") == 0, fv.DEFAULT_CATEGORY).otherwise(category)
        out = out.withColumn("defect_category", category)
    if "variant" in out.columns:
        out = out.withColumn("variant", clean_text("variant", fv.DEFAULT_VARIANT))
    return out


def clean_process(df: DataFrame, row_key: Sequence[str]) -> DataFrame:
    return fill_timestamps(impute_medians(df, fv.TELEMETRY), row_key)


def clean_production(df: DataFrame, row_key: Sequence[str] = ()) -> DataFrame:
    out = impute_medians(df, fv.PRODUCTION_NUMBERS)
    if "station" in out.columns:
        out = out.withColumn("station", clean_text("station", fv.DEFAULT_STATION))
    return fill_timestamps(out, row_key) if row_key else out


def clean_economic(df: DataFrame, row_key: Sequence[str] = ()) -> DataFrame:
    present = [c for c in fv.EXPECTED["economic"] if c in df.columns]
    return df.withColumns({c: F.coalesce(to_number(c), F.lit(0.0)) for c in present})


CLEANERS = {
    "inspection": clean_inspection,
    "process": clean_process,
    "production": clean_production,
    "economic": clean_economic,
}


def canonical(df: DataFrame, kind: str, row_key: Sequence[str]) -> DataFrame:
    """Remap, complete and clean one table."""
    keys = [k for k in row_key if k not in df.columns]
    if keys:
        raise ValueError(f"row key columns not found: {keys}")
    return CLEANERS[kind](add_missing(remap_columns(df, kind), kind), row_key)


# alias column -> expression, added where the source exists and the alias does not
COMPANIONS = {
    "inspection": {
        "is_defective": ("label", lambda c: is_defective(c).cast("int")),
        "defect_family": ("defect_category", F.col),
        "variant_id": ("variant", F.col),
    },
    "production": {
        "station_id": ("station", F.col),
        "station_name": ("station", F.col),
        "nominal_capacity_uph": ("capacity", F.col),
        "cycle_time_sec": ("cycle_time", F.col),
        "wip_count": ("wip", F.col),
        "downtime_min": ("downtime_hours", lambda c: F.col(c) * 60.0),
        "rework_count": ("rework_units", F.col),
        "scrap_count": ("scrap_units", F.col),
    },
    "economic": {
        "scrap_penalty_per_unit": ("scrap_cost", F.col),
        "rework_cost_per_unit": ("rework_cost", F.col),
        "downtime_penalty_hourly": ("downtime_cost_per_hour", F.col),
        "labor_rate_hourly": ("labor_cost", F.col),
        "overhead_rate_hourly": ("overhead_cost", F.col),
    },
    "process": {},
}


def add_companions(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumns(
        {
            name: make(source)
            for name, (source, make) in COMPANIONS[kind].items()
            if source in df.columns and name not in df.columns
        }
    )

"""Readers: CSV tables, the three load modes, class-per-folder image listings, features."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from plantgauge import fixed_values as fv
from plantgauge.operators import clean

FILE_ORDER = ["_file", "_block", "_row"]


def read_raw_csv(spark: SparkSession, path: str | None, kind: str) -> DataFrame:
    """All columns as text, plus the position of each row in its file.

    A path that cannot be read gives an empty table with the expected columns.
    """
    try:
        if not path:
            raise FileNotFoundError(kind)
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
        names = raw.columns
        return raw.select(
            *[F.col(f"`{c}`") for c in names],
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
    except (AnalysisException, FileNotFoundError):
        fields = [T.StructField(c, T.StringType()) for c in fv.EXPECTED[kind]]
        fields += [
            T.StructField("_file", T.StringType()),
            T.StructField("_block", T.LongType()),
            T.StructField("_row", T.LongType()),
        ]
        return spark.createDataFrame([], T.StructType(fields))


def load_csv(spark: SparkSession, path: str | None, kind: str) -> tuple[DataFrame, DataFrame]:
    """(clean table, one-row validation report)."""
    raw = read_raw_csv(spark, path, kind)
    table = clean.canonical(raw, kind, FILE_ORDER).drop(*FILE_ORDER)
    return table, clean.validation_row(raw.drop(*FILE_ORDER), kind)


MODES = {
    # mode -> (is_synthetic, source text)
    "Upload": (False, "User Uploaded CSV Files"),
    "Organizer": (False, "Official Organizer Image Dataset"),
    "Demo": (True, "DEMO / SYNTHETIC DATA"),
}


def load_all(
    spark: SparkSession,
    mode: str,
    paths: dict[str, str],
    image_folder: str | None = None,
) -> dict[str, DataFrame]:
    """The four tables, their validation report and the provenance rows.

    ``paths`` maps inspection / process / production / economic to CSV paths. In
    Organizer mode the inspection table is the CSV as it stands, or the listing
    of ``image_folder`` if there is no CSV; the CSV tables remain the sample data
    and ``demo_inspection`` keeps their inspection table.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    tables: dict[str, DataFrame] = {}
    reports = []
    for kind in ("inspection", "process", "production", "economic"):
        table, report = load_csv(spark, paths.get(kind), kind)
        tables[kind] = table
        reports.append(report)
    if mode == "Organizer":
        tables["demo_inspection"] = tables["inspection"]
        organizer_csv = paths.get("organizer_inspection")
        if organizer_csv:
            tables["inspection"] = spark.read.option("header", True).csv(organizer_csv)
        elif image_folder:
            tables["inspection"] = image_listing(spark, image_folder)
        reports[0] = clean.validation_row(tables["inspection"], "inspection").withColumns(
            {"is_valid": F.lit(True), "missing_columns": F.array().cast("array<string>")}
        )
    out = {k: clean.add_companions(v, k) if k in clean.COMPANIONS else v for k, v in tables.items()}
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    out["validation"] = report
    synthetic, text = MODES[mode]
    out["provenance"] = report.select(
        "dataset",
        F.lit(mode).alias("data_mode"),
        F.lit(synthetic).alias("is_synthetic"),
        F.lit(text).alias("source_name"),
        F.lit(mode == "Organizer").alias("other_tabs_demo"),
        F.col("cleaned_rows").alias("record_count"),
    )
    for name, table in out.items():
        table.createOrReplaceTempView(name)
    return out


def with_provenance(df: DataFrame, source_name: str, is_synthetic: bool) -> DataFrame:
    """Mark each row with where it came from."""
    return df.withColumns({"source_name": F.lit(source_name), "is_synthetic": F.lit(is_synthetic)})


def image_listing(spark: SparkSession, folder: str, per_class: int | None = None) -> DataFrame:
    """label, defect_category, image_path of a class-per-folder image tree.

    Only paths are read, never the bytes. ``per_class`` keeps the first n paths
    of each class; the limit is applied before the shuffle.
    """
    pattern = "*.{" + ",".join(fv.IMAGE_SUFFIXES + [s.upper() for s in fv.IMAGE_SUFFIXES]) + "}"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(F.col("path").alias("image_path"))
    )
    listed = files.withColumn(
        "defect_category", F.lower(F.element_at(F.split("image_path", "/"), -2))
    ).where(F.col("defect_category").isin(fv.IMAGE_CLASSES))
    if per_class is not None:
        w = Window.partitionBy("defect_category").orderBy("image_path")
        listed = listed.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_class).drop("_n")
    label = F.when(F.col("defect_category") == fv.NORMAL_CLASS, "good").otherwise("defective")
    return listed.select(label.alias("label"), "defect_category", "image_path")


def read_features(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """The embedding table; with ``splits``, only those partitions are read."""
    df = spark.read.parquet(path)
    return df.where(F.col("split").isin(splits)) if splits else df

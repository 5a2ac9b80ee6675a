"""Running defect totals as inspected units arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantgauge.functions.columns import is_defective
from plantgauge.session import fresh_folder


def defect_windows(units: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Units and defects per event-time window and batch; rows later than ``late``
    behind the newest event are dropped. Works on a stream and on a table."""
    timed = units.where(F.col("timestamp").isNotNull()).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if units.isStreaming:
        timed = timed.withWatermark("timestamp", late)
    return (
        timed.groupBy(F.window("timestamp", window), "batch_id")
        .agg(F.count(F.lit(1)).alias("units"), F.sum(is_defective("label").cast("int")).alias("defects"))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "batch_id", "units", "defects"
        )
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived, then stop; a restart continues from the checkpoint."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def closed_windows(spark: SparkSession, units: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The windows that are final, from one pass over the arrived units."""
    path, mark = fresh_folder(spark, "windows"), fresh_folder(spark, "windows-progress")
    run_to_table(defect_windows(units, window, late), path, mark)
    return spark.read.parquet(path)


def cumulative(closed: DataFrame) -> DataFrame:
    """Totals up to each closed window, over all batches.

    Windows are few (one per period), so ordering them is cheap.
    """
    from pyspark.sql import Window

    per_window = closed.groupBy("window_start", "window_end").agg(
        F.sum("units").alias("units"), F.sum("defects").alias("defects")
    )
    upto = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_window.withColumns(
        {"cumulative_units": F.sum("units").over(upto), "cumulative_defects": F.sum("defects").over(upto)}
    )

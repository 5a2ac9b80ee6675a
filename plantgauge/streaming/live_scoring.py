"""Score arriving units and keep status counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def score_arrivals(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], counts_path: str, checkpoint: str, status: str = "predicted_status"
) -> None:
    """Apply ``score`` to each micro-batch and store its status counts.

    The counts of a micro-batch go to its own folder, overwritten if the
    micro-batch is repeated after a failure, so no unit is counted twice.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        counts = score(batch).groupBy(status).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{counts_path}/epoch={epoch}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def status_totals(spark: SparkSession, counts_path: str, status: str = "predicted_status") -> DataFrame:
    return spark.read.parquet(counts_path).groupBy(status).agg(F.sum("n").alias("n"))

"""Trained models, sinks and streams over the test tables (mostly without a SQL twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge import fixed_values as fv
from plantgauge.catalog.base import CTES, query
from plantgauge.catalog.batches import DEF, table
from plantgauge.catalog.routing import routed, scored_units
from plantgauge.catalog.splits import split_features
from plantgauge.operators import models, routing, splits
from plantgauge.plans.classifier_report import ClassifierReport
from plantgauge.session import cut_lineage, fresh_folder
from plantgauge.sources import sinks, tables
from plantgauge.sources.driver_views import VIEWS
from plantgauge.streaming import live_scoring, running_totals


def _two_stage(t):
    prepared, names = models.prepare(t.inspection, t.process)
    rows = cut_lineage(splits.group_split(prepared, "batch_id", "unit_id", F.col("actual")))
    model = models.train_two_stage(rows.where(F.col("split") == "train"), names)
    return model, rows


@query()
def rf_two_stage(t):
    model, rows = _two_stage(t)
    return routing.predictions(routing.route(models.score_two_stage(model, rows.where(F.col("split") == "test"))))


@query()
def rf_two_stage_metrics(t):
    model, rows = _two_stage(t)
    return models.two_stage_metrics(models.score_two_stage(model, rows.where(F.col("split") == "test")))


def _embedding_model(t):
    rows = cut_lineage(split_features(t))
    model = models.train_embedding_model(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val"))
    return model, rows


def classifier(t) -> ClassifierReport:
    return ClassifierReport(cut_lineage(split_features(t)))


@query()
def logreg_embeddings(t):
    return classifier(t).per_class()


@query()
def logreg_operating_point(t):
    return classifier(t).operating_point()


@query()
def logreg_calibration(t):
    return classifier(t).calibration()


@query()
def heldout_class(t):
    return models.held_out_classes(cut_lineage(split_features(t)))


@query()
def robust_retrain(t):
    return models.robust_retrain(cut_lineage(split_features(t)))


@query()
def model_roundtrip(t):
    """Train, store, load, and compare the predictions of both on the test split."""
    model, rows = _embedding_model(t)
    path = fresh_folder(t.spark, "model")
    loaded = sinks.trained_or_loaded(path, lambda: model.pipeline, features=64)
    again = models.EmbeddingModel(model.indexer, sinks.load_model(path, 64) or loaded, model.temperature)
    test = rows.where(F.col("split") == "test")
    a = models.embedding_scores(model, test).select("vec_id", F.col("predicted_class").alias("before"))
    b = models.embedding_scores(again, test).select("vec_id", F.col("predicted_class").alias("after"))
    return a.join(b, "vec_id").withColumn("same", F.col("before") == F.col("after"))


@query(oracle="SELECT 'csv' AS sink, count(*) AS n FROM routed WHERE is_uncertain UNION ALL"
       " SELECT 'json', count(*) FROM routed UNION ALL SELECT 'parquet by split', count(*) FROM split_features WHERE split = 'val'")
def csv_json_sinks(t):
    """Predictions to JSON, their triage queue to CSV, features by split; counts read back.

    Both text sinks are compressed, and units are scored once: the queue comes from the stored predictions.
    """
    rows = routed(t)
    json = sinks.write_json(rows, fresh_folder(t.spark, "predictions"), compression="gzip")
    written = t.spark.read.schema(rows.schema).json(json)
    csv = sinks.write_csv(routing.triage_queue(written, "uncertain"), fresh_folder(t.spark, "queue"), compression="gzip")
    feats = sinks.write_features(split_features(t), fresh_folder(t.spark, "features"))
    parts = [
        ("csv", t.spark.read.option("header", True).csv(csv)),
        ("json", written),
        ("parquet by split", tables.read_features(t.spark, feats, ["val"])),
    ]
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("sink"), "n") for n, df in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(oracle="SELECT batch_id, defect_rate FROM batch_table", doubles="defect_rate")
def stored_result(t):
    """A result computed once and then served from its table."""
    path = fresh_folder(t.spark, "stored")
    sinks.stored_or_computed(t.spark, path, lambda: table(t).select("batch_id", "defect_rate"))
    return sinks.stored_or_computed(t.spark, path, lambda: table(t).select("batch_id", "defect_rate").limit(0))


@query(oracle="SELECT 'Demo' AS data_mode, true AS is_synthetic, 'sample' AS source_name, count(*) AS n FROM production")
def provenance(t):
    rows = tables.with_provenance(t.production, "sample", True).withColumn("data_mode", F.lit("Demo"))
    return rows.groupBy("data_mode", "is_synthetic", "source_name").agg(F.count(F.lit(1)).alias("n"))


def arrivals(t):
    """The inspection view with its fact table read as a stream."""
    stream = t.arriving("lineitem", maxFilesPerTrigger=1)
    return t.spark.sql(VIEWS["inspection"], lineitem=stream, part=t.base("part"))


CTES["windows"] = f"""
SELECT time_bucket(INTERVAL 30 DAY, timestamp, TIMESTAMP '1970-01-01') AS s, batch_id, count(*) AS units,
       CAST(sum({DEF}) AS BIGINT) AS defects FROM inspection WHERE timestamp IS NOT NULL GROUP BY ALL"""
CLOSED = "s + INTERVAL 30 DAY <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM inspection)"


@query(
    oracle=f"""SELECT strftime(s, '%Y-%m-%d') AS window_start, batch_id, units, defects FROM windows WHERE {CLOSED}"""
)
def stream_running_defects(t):
    closed = running_totals.closed_windows(t.spark, arrivals(t), "30 days")
    return closed.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "batch_id", "units", "defects")


@query(
    oracle=f"""SELECT strftime(s, '%Y-%m-%d') AS window_start, CAST(sum(units) AS BIGINT) AS units,
                      CAST(sum(defects) AS BIGINT) AS defects, CAST(sum(sum(units)) OVER w AS BIGINT) AS cumulative_units,
                      CAST(sum(sum(defects)) OVER w AS BIGINT) AS cumulative_defects
               FROM windows WHERE {CLOSED} GROUP BY s WINDOW w AS (ORDER BY s ROWS UNBOUNDED PRECEDING)"""
)
def stream_cumulative_defects(t):
    total = running_totals.cumulative(running_totals.closed_windows(t.spark, arrivals(t), "30 days"))
    return total.drop("window_end").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


class _Arrived:
    """Lets the scored view run on a micro-batch."""

    def __init__(self, inspection):
        self.inspection = inspection


@query(oracle="SELECT predicted_status, count(*) AS n FROM routed GROUP BY predicted_status")
def stream_scoring(t):
    path, mark = fresh_folder(t.spark, "counts"), fresh_folder(t.spark, "counts-progress")
    live_scoring.score_arrivals(arrivals(t), lambda b: routing.route(scored_units(_Arrived(b))), path, mark)
    return live_scoring.status_totals(t.spark, path)


@query()
def stream_model_scoring(t):
    """Arriving vectors scored by a stored pipeline."""
    model, rows = _embedding_model(t)
    path = sinks.save_model(model.pipeline, fresh_folder(t.spark, "live-model"))
    stored = models.EmbeddingModel(model.indexer, sinks.load_model(path), model.temperature)
    feats = t.spark.sql(VIEWS["features"], embeddings=t.arriving("embeddings"))
    counts, mark = fresh_folder(t.spark, "live-counts"), fresh_folder(t.spark, "live-progress")
    live_scoring.score_arrivals(
        feats, lambda b: routing.route_classes(models.embedding_scores(stored, b), fv.UNCERTAIN_BELOW), counts, mark
    )
    return live_scoring.status_totals(t.spark, counts)

"""Trained classifiers: the two-stage forest on tabular features and the
multinomial model on embeddings, with the experiments built on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from plantgauge import fixed_values as fv
from plantgauge.functions import vectors
from plantgauge.functions.columns import has_category, is_defective, wilson
from plantgauge.operators import evaluation, features, neighbors
from plantgauge.operators.batch import category_column
from plantgauge.operators.bounds import column_values
from plantgauge.session import cut_lineage

SEED = 42
# rows of a training task: what Spark ML keeps of them (some 600 bytes each for 100 trees) fits beside its neighbours
TASK_ROWS = 1_000_000


def spread(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows in even parts, one for each core at least and of ``TASK_ROWS`` at most, each
    sorted by ``order``.

    Tree passes take long per row; the few or uneven splits of a scan leave cores idle in every
    pass. A part also sends the figures of every tree node, so there are no more than needed.
    Rows alike stand together: they take the same way down the trees and add to the same figures,
    which the processor then holds. The forest asks for no order.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(parts).sortWithinPartitions(*order)


def coarsest_first(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns by how many values they hold, so that rows sorted by them agree in as many as can be."""
    held = df.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    return sorted(names, key=lambda c: held[c])


def balanced_weights(df: DataFrame, label: str) -> Column:
    """n / (classes * n_class) as an expression; the class counts are a few rows."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(whole / (len(counts) * n))).otherwise(weight)
    return weight


def forest(label: str, features_col: str = "features") -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=100, maxDepth=8, labelCol=label, featuresCol=features_col, weightCol="_w", seed=SEED,
        maxMemoryInMB=1024,  # more tree nodes per pass over the data
    )


@dataclass
class TwoStage:
    """Detector of defective units, and the category model if there were two categories."""

    names: list[str]
    detector: PipelineModel
    category: PipelineModel | None
    scale: dict[str, tuple[float, float]]


def prepare(inspection: DataFrame, process: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """Features, 0/1 label and trimmed category of each unit, settled once for
    training, scaling and scoring."""
    rows, names = features.tabular(inspection, process)
    label = "label" if "label" in rows.columns else "is_defective"
    cat = category_column(rows)
    rows = rows.withColumns(
        {
            "actual": is_defective(label).cast("int"),
            "actual_category": F.coalesce(F.trim(F.col(cat)), F.lit(fv.DEFAULT_CATEGORY)) if cat else F.lit(fv.DEFAULT_CATEGORY),
        }
    )
    return rows, names


def train_two_stage(prepared: DataFrame, names: Sequence[str]) -> TwoStage:
    """Stage one on all training rows, stage two on its defective rows with a category.

    ``prepared`` holds the training rows of :func:`prepare`.
    """
    assemble = VectorAssembler(inputCols=list(names), outputCol="features")
    rows = prepared.select(*names, "actual", balanced_weights(prepared, "actual").alias("_w"))
    order = coarsest_first(prepared, names)
    detector = Pipeline(stages=[assemble, forest("actual")]).fit(spread(rows, order))
    bad = prepared.where((F.col("actual") == 1) & has_category("actual_category"))
    category = None
    if bad.select("actual_category").distinct().limit(2).count() >= 2:
        indexer = StringIndexer(inputCol="actual_category", outputCol="_y", stringOrderType="alphabetAsc").fit(bad)
        weighted = bad.withColumn("_w", balanced_weights(bad, "actual_category"))
        back = IndexToString(inputCol="_best", outputCol="family", labels=indexer.labels)
        model = forest("_y").setPredictionCol("_best").setProbabilityCol("_fp").setRawPredictionCol("_fr")
        coded = indexer.transform(weighted).select(*names, "_y", "_w")
        fitted = Pipeline(stages=[assemble, model]).fit(spread(coded, order))
        category = PipelineModel(stages=[*fitted.stages, back])
    return TwoStage(list(names), detector, category, features.scale(prepared, names))


def score_two_stage(model: TwoStage, prepared: DataFrame) -> DataFrame:
    """Adds p_good, p_defective, confidence, raw_prediction, family, anomaly_z."""
    out = model.detector.transform(prepared)
    p = vector_to_array("probability")
    out = out.withColumns({"p_good": p[0], "p_defective": p[1], "raw_prediction": F.col("prediction").cast("int")})
    out = out.drop("features", "rawPrediction", "probability", "prediction")
    if model.category is not None:
        out = model.category.transform(out).drop("features", "_best", "_fp", "_fr")
    else:
        out = out.withColumn("family", F.lit(fv.DEFAULT_CATEGORY))
    out = features.max_abs_z(out, model.scale)
    return out.withColumns(
        {
            "confidence": F.greatest("p_good", "p_defective"),
            "family": F.when(F.col("raw_prediction") == 1, F.col("family")).otherwise(fv.DEFAULT_CATEGORY),
        }
    )


def two_stage_metrics(scored: DataFrame, threshold: float = fv.UNCERTAIN_BELOW) -> DataFrame:
    """One row: detector rates, calibration error, selective accuracy and category accuracy.

    The rows are scored once for all parts of the result.
    """
    scored = cut_lineage(scored.select("actual", "actual_category", "raw_prediction", "p_defective", "confidence", "family"))
    called = scored.withColumns(
        {
            "predicted": F.col("raw_prediction"),
            "correct": (F.col("raw_prediction") == F.col("actual")).cast("int"),
        }
    )
    rates = evaluation.binary_rates(evaluation.confusion_counts(called))
    sure = evaluation.selective_metrics(called, threshold)
    bins = evaluation.ece_bins(called, confidence="p_defective", correct="actual", last_closed=False)
    known = called.where((F.col("actual") == 1) & has_category("actual_category"))
    second = known.agg(
        F.count(F.lit(1)).alias("category_units"),
        F.coalesce(F.avg((F.col("family") == F.col("actual_category")).cast("double")), F.lit(0.0)).alias("category_accuracy"),
    )
    out = rates
    for part in (sure, evaluation.ece(bins), second):
        row = part.select(F.struct("*")).scalar()
        out = out.withColumns({c: row[c] for c in part.columns})
    return out


# ---- embeddings ------------------------------------------------------------


@dataclass
class EmbeddingModel:
    indexer: StringIndexerModel
    pipeline: PipelineModel
    temperature: float = 1.0

    @property
    def classes(self) -> list[str]:
        return list(self.indexer.labels)


def train_embedding_model(train: DataFrame, val: DataFrame, vec: str = "embedding", label: str = "category") -> EmbeddingModel:
    """Balanced multinomial regression (C = 1), its temperature fitted on ``val``."""
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    rows = indexer.transform(train).select(
        array_to_vector(vectors.doubles(F.col(vec))).alias("_x"), "_y", balanced_weights(train, label).alias("_w")
    )
    n = rows.count()  # balanced weights sum to the number of rows
    model = LogisticRegression(
        family="multinomial", featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=1000,
        regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False,
    )
    fitted = EmbeddingModel(indexer, Pipeline(stages=[model]).fit(rows))
    fitted.temperature = evaluation.fit_temperature(embedding_logits(fitted, val, vec, label))
    return fitted


def embedding_logits(model: EmbeddingModel, rows: DataFrame, vec: str = "embedding", label: str = "category") -> DataFrame:
    """Adds logits and target (0-based index of the true class, null if unknown)."""
    out = model.pipeline.transform(rows.withColumn("_x", array_to_vector(vectors.doubles(F.col(vec)))))
    place = F.array_position(F.lit(model.classes), F.col(label)).cast("int")
    return out.withColumns(
        {"logits": vector_to_array("rawPrediction"), "target": F.when(place > 0, place - 1)}
    ).drop("_x", "rawPrediction", "probability", "prediction")


def embedding_scores(model: EmbeddingModel, rows: DataFrame, vec: str = "embedding", label: str = "category") -> DataFrame:
    """Calibrated probabilities, predicted class, confidence, p_defective and 0/1 columns."""
    out = embedding_logits(model, rows, vec, label)
    out = out.withColumn("probs", vectors.softmax(F.col("logits"), model.temperature)).drop("logits")
    normal = model.classes.index(fv.NORMAL_CLASS) if fv.NORMAL_CLASS in model.classes else None
    best = F.element_at(F.lit(model.classes), vectors.argmax(F.col("probs")) + 1)
    p_def = F.lit(1.0) - F.col("probs")[normal] if normal is not None else F.lit(1.0)
    return out.withColumns(
        {
            "actual_class": F.col(label),
            "predicted_class": best,
            "confidence": F.array_max("probs"),
            "p_defective": p_def,
            "actual": (F.col(label) != fv.NORMAL_CLASS).cast("int"),
            "predicted": (p_def >= 0.5).cast("int"),
        }
    )


def known_distances(split_rows: DataFrame, id_col: str, vec: str, label: str, k: int) -> DataFrame:
    """id, class, distance of the validation and test rows to every class of the training rows."""
    rows = split_rows.select(F.col(id_col).alias("id"), F.col(label).alias("class"), F.col(vec).alias("vec"), "split")
    bank = rows.where((F.col("split") == "train") & F.col("class").isNotNull()).drop("split")
    return neighbors.class_distances(rows.where(F.col("split").isin("val", "test")).select("id", "vec"), bank, k)


def held_out_class(
    split_rows: DataFrame, held_out: str, id_col: str = "vec_id", vec: str = "embedding", label: str = "category",
    threshold: float = fv.UNCERTAIN_BELOW, k: int = fv.NEIGHBOURS, distances: DataFrame | None = None,
) -> DataFrame:
    """Retrain and recalibrate without one class, then flag the test split.

    One row per group (``held out`` and each known class, and ``known`` for all of
    them): units, novel / uncertain / either counts and rates, Wilson interval of
    the novel rate, threshold and temperature. ``distances`` are those of :func:`known_distances`,
    if the caller has them.
    """
    known = split_rows.where(F.col(label) != held_out)
    train, val = known.where(F.col("split") == "train"), known.where(F.col("split") == "val")
    model = train_embedding_model(train, val, vec, label)

    if distances is None:
        distances = known_distances(split_rows, id_col, vec, label, k)
    scores = neighbors.held_out_scores(distances, [held_out]).where(F.col("novelty_score").isNotNull())
    novel = scores.select(F.col("id").alias(id_col), "novelty_score")
    limit = neighbors.score_threshold(
        novel.join(val.select(id_col), id_col), "novelty_score", fv.NOVELTY_PERCENTILE, fv.EMPTY_NOVELTY_THRESHOLD
    ).first()
    test = split_rows.where(F.col("split") == "test")
    scored = embedding_scores(model, test, vec, label).select(id_col, label, "confidence")
    flags = scored.join(novel, id_col).withColumns(
        {
            "is_novel": F.col("novelty_score") > limit["threshold"],
            "is_uncertain": F.col("confidence") < threshold,
        }
    )
    own = F.when(F.col(label) == held_out, F.array(F.lit("held out"))).otherwise(F.array(F.lit("known"), F.col(label)))
    g = flags.withColumn("group", F.explode(own)).groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("is_novel"), 1)).alias("novel"),
        F.count(F.when(F.col("is_uncertain"), 1)).alias("uncertain"),
        F.count(F.when(F.col("is_novel") | F.col("is_uncertain"), 1)).alias("novel_or_uncertain"),
        F.avg("novelty_score").alias("mean_novelty_score"),
    )
    w = wilson(F.col("novel"), F.col("n"))
    return g.select(
        F.lit(held_out).alias("held_out_class"), "group", "n", "novel", "uncertain", "novel_or_uncertain",
        w["rate"].alias("novel_rate"), w["low"].alias("novel_low"), w["high"].alias("novel_high"),
        (F.col("uncertain") / F.col("n")).alias("uncertain_rate"),
        (F.col("novel_or_uncertain") / F.col("n")).alias("either_rate"),
        "mean_novelty_score",
        F.lit(limit["threshold"]).alias("threshold"), F.lit(model.temperature).alias("temperature"),
    )


def held_out_classes(
    split_rows: DataFrame, classes: Sequence[str] | None = None, id_col: str = "vec_id", vec: str = "embedding",
    label: str = "category", threshold: float = fv.UNCERTAIN_BELOW, k: int = fv.NEIGHBOURS,
) -> DataFrame:
    """:func:`held_out_class` for every class but the normal one, keyed by ``held_out_class``.

    Classes are few by the check of ``column_values``; each is one training run, whose figures are
    settled before the next one starts. The training rows are searched once for all of them.
    """
    held = list(classes) if classes is not None else [c for c in column_values(split_rows, label) if c != fv.NORMAL_CLASS]
    if not held:
        raise ValueError("no class to hold out")
    distances = cut_lineage(known_distances(split_rows, id_col, vec, label, k))
    out = None
    for c in held:
        rows = cut_lineage(held_out_class(split_rows, c, id_col, vec, label, threshold, k, distances))
        out = rows if out is None else out.unionByName(rows)
    return out


def robust_retrain(
    split_rows: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "category",
    threshold: float = fv.UNCERTAIN_BELOW,
) -> DataFrame:
    """The model as it is and the model retrained with one augmented copy per training
    row, both under every condition: deltas and status per condition."""
    train, val = split_rows.where(F.col("split") == "train"), split_rows.where(F.col("split") == "val")
    originals = train.select(id_col, label, vectors.doubles(F.col(vec)).alias(vec))
    both = originals.unionByName(neighbors.augmented(originals, vec, id_col))
    held = cut_lineage(neighbors.perturbed(split_rows.where(F.col("split") == "test").select(id_col, label, vec), vec, id_col))
    evaluated = []
    for rows in (originals, both):
        model = train_embedding_model(cut_lineage(rows), val, vec, label)
        scored = embedding_scores(model, held, vec, label)
        evaluated.append(evaluation.evaluate_conditions(scored, threshold=threshold))
    return evaluation.before_after(*evaluated)

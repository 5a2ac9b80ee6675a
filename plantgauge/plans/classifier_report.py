"""Train the embedding classifier and report on its held-out rows.

Validation rows choose temperature and threshold; test rows are only reported.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from plantgauge import fixed_values as fv
from plantgauge.functions import vectors
from plantgauge.functions.columns import rounded
from plantgauge.operators import evaluation, models, routing
from plantgauge.session import cut_lineage


@dataclass
class ClassifierReport:
    """``rows`` holds an id, an embedding, a category and a split."""

    rows: DataFrame
    vec: str = "embedding"
    label: str = "category"
    uncertain_below: float = fv.UNCERTAIN_BELOW
    cost_false_reject: float = 41.72
    escaped_multiple: float = 5.0
    prevalence: float = 0.10

    def _split(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name)

    @cached_property
    def model(self) -> models.EmbeddingModel:
        return models.train_embedding_model(self._split("train"), self._split("val"), self.vec, self.label)

    @cached_property
    def scored(self) -> DataFrame:
        """Validation and test rows with calibrated scores, settled once for all metrics."""
        held = self.rows.where(F.col("split").isin("val", "test"))
        return cut_lineage(models.embedding_scores(self.model, held, self.vec, self.label).drop(self.vec))

    @property
    def test(self) -> DataFrame:
        return self.scored.where(F.col("split") == "test")

    def cells(self) -> DataFrame:
        return evaluation.confusion_matrix(self.test, (), "actual_class", "predicted_class")

    def per_class(self) -> DataFrame:
        return evaluation.per_class_metrics(self.cells(), (), "actual_class", "predicted_class")

    def macro(self) -> DataFrame:
        return evaluation.macro_metrics(self.per_class())

    def defect_cells(self) -> DataFrame:
        """The matrix of the defective classes only."""
        return self.cells().where(F.col("actual_class") != fv.NORMAL_CLASS)

    def binary(self) -> DataFrame:
        return evaluation.binary_rates(evaluation.confusion_counts(self.test))

    def areas(self) -> DataFrame:
        return evaluation.areas(evaluation.score_steps(self.test, score="p_defective"))

    def calibration(self) -> DataFrame:
        """ECE on the test rows before and after the temperature."""
        logits = models.embedding_logits(self.model, self._split("test"), self.vec, self.label)
        names = F.lit(self.model.classes)
        parts = []
        for name, t in (("before", 1.0), ("after", self.model.temperature)):
            probs = logits.withColumn("_p", vectors.softmax(F.col("logits"), t))
            parts.append(
                probs.select(
                    F.lit(name).alias("calibration"), F.array_max("_p").alias("confidence"),
                    (F.element_at(names, vectors.argmax(F.col("_p")) + 1) == F.col(self.label)).cast("int").alias("correct"),
                )
            )
        both = parts[0].unionByName(parts[1])
        return evaluation.ece(evaluation.ece_bins(both, ["calibration"]), ["calibration"])

    def selective(self) -> DataFrame:
        return evaluation.selective_metrics(self._judged(), self.uncertain_below)

    def coverage(self) -> DataFrame:
        return evaluation.coverage_curve(self._judged())

    def _judged(self) -> DataFrame:
        return self.test.withColumn("correct", (F.col("actual") == F.col("predicted")).cast("int"))

    def operating_point(self) -> DataFrame:
        costs = (self.cost_false_reject, self.cost_false_reject * self.escaped_multiple, self.prevalence)
        val = self.scored.where(F.col("split") == "val")
        best = evaluation.best_threshold(evaluation.cost_curve(val, *costs, p="p_defective"))
        return evaluation.operating_point(self.test, best, *costs, p="p_defective")

    def predictions(self) -> DataFrame:
        routed = routing.route_classes(self.test, self.uncertain_below)
        return routed.withColumns(
            {"confidence": rounded(F.col("confidence"), 4), "p_defective": rounded(F.col("p_defective"), 4)}
        ).drop("probs", "target")

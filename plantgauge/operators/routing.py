"""Verdicts, triage and rationale of scored units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantgauge import fixed_values as fv
from plantgauge.functions.columns import is_defective, rounded


def route(scored: DataFrame, threshold: float = fv.UNCERTAIN_BELOW, novel_z: float = fv.NOVEL_Z) -> DataFrame:
    """Add is_novel, is_uncertain, predicted_status, prediction and triage_recommendation.

    NOVEL outranks UNCERTAIN, which outranks REJECT and ACCEPT. ``scored`` holds
    confidence, anomaly_z, raw_prediction and family.
    """
    status = (
        F.when(F.col("anomaly_z") > novel_z, "NOVEL")
        .when(F.col("confidence") < threshold, "UNCERTAIN")
        .when(F.col("raw_prediction") == 1, "REJECT")
        .otherwise("ACCEPT")
    )
    s = F.col("predicted_status")
    return scored.withColumns(
        {
            "is_novel": F.col("anomaly_z") > novel_z,
            "is_uncertain": F.col("confidence") < threshold,
            "predicted_status": status,
        }
    ).withColumns(
        {
            "prediction": F.when(s == "REJECT", F.format_string("Defective (%s)", "family"))
            .when(s == "ACCEPT", "Good")
            .otherwise(s),
            "triage_recommendation": F.when(s == "NOVEL", fv.TRIAGE_TEXT["NOVEL"])
            .when(s == "UNCERTAIN", fv.TRIAGE_TEXT["UNCERTAIN"])
            .when(s == "REJECT", F.format_string(fv.TRIAGE_TEXT["REJECT"], F.col("family")))
            .otherwise(fv.TRIAGE_TEXT["ACCEPT"]),
        }
    )


def predictions(routed: DataFrame) -> DataFrame:
    """The prediction table: display rounding and canonical columns."""
    return routed.select(
        "unit_id", "batch_id", "variant", F.col("actual").alias("actual_label"), "actual_category",
        rounded(F.col("p_good"), 3).alias("p_good"), rounded(F.col("p_defective"), 3).alias("p_defective"),
        rounded(F.col("confidence"), 3).alias("confidence"), rounded(F.col("anomaly_z"), 2).alias("anomaly_z"),
        "predicted_status", "prediction", "is_uncertain", "is_novel", "triage_recommendation",
    )


def route_classes(scored: DataFrame, threshold: float = fv.UNCERTAIN_BELOW) -> DataFrame:
    """Status and action of a class prediction without novelty (held-out test rows)."""
    status = F.when(F.col("confidence") < threshold, "UNCERTAIN").when(
        F.col("predicted_class") != fv.NORMAL_CLASS, "REJECT"
    )
    out = scored.withColumn("predicted_status", status.otherwise("ACCEPT"))
    s = F.col("predicted_status")
    return out.withColumns(
        {
            "is_uncertain": s == "UNCERTAIN",
            "prediction": F.when(F.col("predicted_class") != fv.NORMAL_CLASS, "defective").otherwise("good"),
            "triage_recommendation": F.when(s == "UNCERTAIN", fv.SPLIT_TRIAGE_TEXT["UNCERTAIN"])
            .when(s == "REJECT", fv.SPLIT_TRIAGE_TEXT["REJECT"])
            .otherwise(fv.SPLIT_TRIAGE_TEXT["ACCEPT"]),
        }
    )


QUEUES = ("uncertain", "defective", "all")


def triage_queue(routed: DataFrame, which: str = "uncertain", actual: str = "actual_label") -> DataFrame:
    """The uncertain units, the rejected / novel / truly defective ones, or all."""
    if which not in QUEUES:
        raise ValueError(f"queue must be one of {QUEUES}")
    if which == "uncertain":
        return routed.where(F.col("is_uncertain"))
    if which == "defective":
        return routed.where(F.col("predicted_status").isin("REJECT", "NOVEL") | is_defective(actual))
    return routed


def status_counts(routed: DataFrame, status: str = "predicted_status", by: Sequence[str] = ()) -> DataFrame:
    """Units and share per status (a handful of rows per group)."""
    counts = routed.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("share", F.col("n") / F.greatest(F.lit(1), whole))


def verdict(novel: Column, uncertain: Column, predicted_class: Column) -> Column:
    return (
        F.when(novel, "NOVEL")
        .when(uncertain, "UNCERTAIN")
        .when(predicted_class == fv.NORMAL_CLASS, "GOOD")
        .otherwise("DEFECTIVE")
    )


def top_two(probs: Column, classes: Sequence[str]) -> Column:
    """Array of the two most probable (prob, class) structs; class name breaks ties."""
    pairs = F.zip_with(probs, F.lit(list(classes)), lambda p, c: F.struct((-p).alias("neg"), c.alias("class")))
    best = F.slice(F.array_sort(pairs), 1, 2)
    return F.transform(best, lambda e: F.struct(e["class"].alias("class"), (-e["neg"]).alias("prob")))


def rationale(
    status: Column, confidence: Column, threshold: Column, top1: Column, p1: Column, top2: Column, p2: Column,
    anomaly: Column, anomaly_limit: Column, novelty: Column, novelty_limit: Column, n_classes: int, k: int = fv.NEIGHBOURS,
) -> Column:
    """The sentence that explains a verdict, from its numbers only."""
    novel = (status == "NOVEL") | ((novelty_limit > 0) & (novelty > novelty_limit))
    over = anomaly > anomaly_limit
    first, second = p1 * 100.0, p2 * 100.0
    bad_note = F.when(over, F.format_string(fv.ANOMALY_OVER, anomaly, anomaly_limit)).otherwise(
        F.format_string(fv.ANOMALY_INSIDE, anomaly, anomaly_limit)
    )
    good_note = F.when(over, F.format_string(fv.ANOMALY_MINOR, anomaly, anomaly_limit)).otherwise(
        F.format_string(fv.ANOMALY_GOOD, anomaly, anomaly_limit)
    )
    return (
        F.when(novel, F.format_string(fv.WHY_NOVEL, novelty, novelty_limit, F.lit(k), F.lit(n_classes)))
        .when(
            (status == "UNCERTAIN") | (confidence < threshold),
            F.format_string(fv.WHY_UNCERTAIN, confidence, top1, threshold, top1, first, top2, second),
        )
        .when(
            status == "DEFECTIVE",
            F.format_string(fv.WHY_DEFECTIVE, F.upper(top1), confidence, threshold, top1, first, top2, second, bad_note),
        )
        .otherwise(F.format_string(fv.WHY_GOOD, confidence, threshold, first, top2, second, good_note))
    )


def evidence_records(scored: DataFrame, classes: Sequence[str], threshold: float = fv.UNCERTAIN_BELOW) -> DataFrame:
    """Add the verdict and an ``evidence`` struct. ``scored`` holds probs, confidence,
    predicted_class, novelty_score, novelty_threshold, anomaly_score, anomaly_threshold."""
    novel = F.col("novelty_score") > F.col("novelty_threshold")
    out = scored.withColumns(
        {
            "is_novel": novel,
            "is_uncertain": F.col("confidence") < threshold,
            "status": verdict(novel, F.col("confidence") < threshold, F.col("predicted_class")),
            "_two": top_two(F.col("probs"), classes),
        }
    )
    one, two = F.col("_two")[0], F.get(F.col("_two"), F.lit(1))
    second, p2 = F.coalesce(two["class"], F.lit("none")), F.coalesce(two["prob"], F.lit(0.0))
    why = rationale(
        F.col("status"), F.col("confidence"), F.lit(float(threshold)), one["class"], one["prob"], second, p2,
        F.col("anomaly_score"), F.col("anomaly_threshold"), F.col("novelty_score"), F.col("novelty_threshold"), len(classes),
    )
    record = F.struct(
        "status", rounded(F.col("confidence") * 100.0, 1).alias("confidence_pct"), F.lit(float(threshold)).alias("threshold"),
        one["class"].alias("top1_class"), rounded(one["prob"], 4).alias("top1_prob"),
        second.alias("top2_class"), rounded(p2, 4).alias("top2_prob"),
        rounded(F.col("novelty_score"), 4).alias("novelty_score"), rounded(F.col("novelty_threshold"), 4).alias("novelty_threshold"),
        rounded(F.col("anomaly_score"), 3).alias("anomaly_score"), rounded(F.col("anomaly_threshold"), 3).alias("anomaly_threshold"),
        why.alias("why"),
    )
    return out.withColumn("evidence", record).drop("_two")


def audit(routed: DataFrame, actual_class: str = "actual_class", predicted_class: str = "predicted_class") -> DataFrame:
    """Correct, category mismatch, or wrong."""
    a, p = F.col(actual_class), F.col(predicted_class)
    same_side = (a != fv.NORMAL_CLASS) == (p != fv.NORMAL_CLASS)
    same_class = (a == fv.NORMAL_CLASS) | (F.lower(a) == F.lower(p))
    return routed.withColumn(
        "audit", F.when(same_side & same_class, "correct").when(same_side, "category mismatch").otherwise("wrong")
    )

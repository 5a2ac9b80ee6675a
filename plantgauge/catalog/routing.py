"""Verdicts and triage on scores that follow from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge import fixed_values as fv
from plantgauge.catalog.base import CTES, query, r, u
from plantgauge.catalog.batches import DEF
from plantgauge.catalog.evaluation import multi_scored, multiclass_logits
from plantgauge.catalog.vectors import BANK, labelled, novelty
from plantgauge.functions import draws
from plantgauge.functions.columns import is_defective
from plantgauge.operators import neighbors, routing
from plantgauge.session import cut_lineage

CTES["unit_scores"] = f"""
SELECT unit_id, batch_id, variant, {DEF} AS actual, coalesce(trim(defect_category), 'None') AS family,
       0.35::DOUBLE * {DEF} + 0.65::DOUBLE * {u("unit_id || '|p'")} AS p, 3.2::DOUBLE * {u("unit_id || '|z'")} AS z
FROM inspection"""
CTES["routed"] = f"""
SELECT unit_id, batch_id, variant, actual AS actual_label, family AS actual_category, {r('1.0 - p', 3)} AS p_good,
       {r('p', 3)} AS p_defective, {r('c', 3)} AS confidence, {r('z', 2)} AS anomaly_z, status AS predicted_status,
       CASE status WHEN 'REJECT' THEN 'Defective (' || family || ')' WHEN 'ACCEPT' THEN 'Good' ELSE status END AS prediction,
       c < 0.7 AS is_uncertain, z > 2.8 AS is_novel,
       CASE status WHEN 'NOVEL' THEN '{fv.TRIAGE_TEXT["NOVEL"]}' WHEN 'UNCERTAIN' THEN '{fv.TRIAGE_TEXT["UNCERTAIN"]}'
                   WHEN 'ACCEPT' THEN '{fv.TRIAGE_TEXT["ACCEPT"]}'
                   ELSE replace('{fv.TRIAGE_TEXT["REJECT"]}', '%s', family) END AS triage_recommendation
FROM (SELECT *, CASE WHEN z > 2.8 THEN 'NOVEL' WHEN c < 0.7 THEN 'UNCERTAIN' WHEN p >= 0.5 THEN 'REJECT' ELSE 'ACCEPT' END AS status
      FROM (SELECT *, greatest(p, 1.0 - p) AS c FROM unit_scores))"""
CTES["class_probs"] = """
SELECT vec_id, category, class, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY vec_id) AS p
FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM logit_rows WHERE split = 'test')"""
CTES["two_best"] = """
SELECT vec_id, category, max(CASE WHEN k = 1 THEN class END) AS top1, max(CASE WHEN k = 1 THEN p END) AS p1,
       max(CASE WHEN k = 2 THEN class END) AS top2, max(CASE WHEN k = 2 THEN p END) AS p2
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS k FROM class_probs) GROUP BY ALL"""
CTES["anomalies"] = """
SELECT q.vec_id, q.split, q.category, min(list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS score
FROM split_features q, bank b WHERE q.split <> 'train' GROUP BY ALL"""
CTES["verdicts"] = """
SELECT t.*, novelty_score AS ns, (SELECT threshold FROM novelty_limit) AS nt, a.score AS an,
       (SELECT quantile_cont(score, 0.99) FROM anomalies WHERE split = 'val' AND category = 'normal') AS al,
       CASE WHEN novelty_score > (SELECT threshold FROM novelty_limit) THEN 'NOVEL' WHEN p1 < 0.2 THEN 'UNCERTAIN'
            WHEN top1 = 'normal' THEN 'GOOD' ELSE 'DEFECTIVE' END AS status
FROM two_best t JOIN novelty n ON n.id = t.vec_id JOIN anomalies a ON a.vec_id = t.vec_id"""
# class means give flat probabilities, so the verdict threshold is lower here
SURE = 0.2


def scored_units(t):
    rows = t.inspection
    flag = is_defective("label").cast("int")
    p = F.lit(0.35) * flag + F.lit(0.65) * draws.uniform(F.col("unit_id"), "p")
    rows = rows.select(
        "unit_id", "batch_id", "variant", flag.alias("actual"),
        F.coalesce(F.trim("defect_category"), F.lit(fv.DEFAULT_CATEGORY)).alias("actual_category"),
        p.alias("p_defective"), (F.lit(3.2) * draws.uniform(F.col("unit_id"), "z")).alias("anomaly_z"),
    )
    return rows.withColumns(
        {
            "p_good": F.lit(1.0) - F.col("p_defective"),
            "confidence": F.greatest(F.col("p_defective"), F.lit(1.0) - F.col("p_defective")),
            "raw_prediction": (F.col("p_defective") >= 0.5).cast("int"),
            "family": F.col("actual_category"),
        }
    )


def routed(t):
    return routing.predictions(routing.route(scored_units(t)))


@query(oracle="SELECT * FROM routed WHERE is_uncertain", doubles="p_good p_defective confidence anomaly_z")
def triage_queue(t):
    return routing.triage_queue(routed(t), "uncertain")


@query(
    oracle="SELECT * FROM routed WHERE predicted_status IN ('REJECT', 'NOVEL') OR actual_label = 1",
    doubles="p_good p_defective confidence anomaly_z",
)
def triage_defective(t):
    return routing.triage_queue(routed(t), "defective")


@query(
    oracle="""SELECT predicted_status, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share
              FROM routed GROUP BY predicted_status""",
    doubles="share",
)
def triage_counts(t):
    return routing.status_counts(routed(t))


@query(
    oracle="""SELECT batch_id, predicted_status, count(*) AS n,
                     count(*) / sum(count(*)) OVER (PARTITION BY batch_id)::DOUBLE AS share
              FROM routed GROUP BY batch_id, predicted_status""",
    doubles="share",
)
def triage_counts_by_batch(t):
    return routing.status_counts(routed(t), by=["batch_id"])


def verdict_rows(t):
    _, classes = multiclass_logits(t)
    rows = labelled(t)
    scores = cut_lineage(novelty(t))  # used for the threshold and for the verdicts
    limit = neighbors.score_threshold(
        scores.where(F.col("split") == "val"), "novelty_score", fv.NOVELTY_PERCENTILE, fv.EMPTY_NOVELTY_THRESHOLD
    ).first()
    normal = rows.where((F.col("split") == "train") & (F.col("class") == fv.NORMAL_CLASS)).select("id", "vec")
    asked = rows.where(F.col("split") != "train")
    far = cut_lineage(neighbors.bank_scores(asked.select("id", "vec"), neighbors.reference_bank(normal, BANK)))
    good_val = far.join(asked.where((F.col("split") == "val") & (F.col("class") == fv.NORMAL_CLASS)).select("id"), "id")
    edge = neighbors.score_threshold(good_val, "anomaly_score", fv.ANOMALY_PERCENTILE, fv.EMPTY_ANOMALY_THRESHOLD).first()
    out = (
        multi_scored(t)
        .where(F.col("split") == "test")
        .join(scores.select(F.col("id").alias("vec_id"), "novelty_score"), "vec_id")
        .join(far.withColumnRenamed("id", "vec_id"), "vec_id")
        .withColumns(
            {
                "novelty_threshold": F.lit(limit["threshold"]),
                "anomaly_threshold": F.lit(edge["threshold"]),
            }
        )
    )
    return routing.evidence_records(out, classes, SURE)


@query(oracle="SELECT vec_id, category AS actual_class, top1 AS predicted_class, status FROM verdicts")
def unit_verdict(t):
    return verdict_rows(t).select("vec_id", "actual_class", "predicted_class", "status")


NOVEL = fv.WHY_NOVEL.replace("'", "''")
NOTE_BAD = f"CASE WHEN an > al THEN printf('{fv.ANOMALY_OVER}', an, al) ELSE printf('{fv.ANOMALY_INSIDE}', an, al) END"
NOTE_GOOD = f"CASE WHEN an > al THEN printf('{fv.ANOMALY_MINOR}', an, al) ELSE printf('{fv.ANOMALY_GOOD}', an, al) END"


WHY = f"""CASE status
                 WHEN 'NOVEL' THEN printf('{NOVEL}', ns, nt, {fv.NEIGHBOURS}, (SELECT count(DISTINCT class) FROM class_probs))
                 WHEN 'UNCERTAIN' THEN printf('{fv.WHY_UNCERTAIN}', p1, top1, {SURE}::DOUBLE, top1, p1 * 100, top2, p2 * 100)
                 WHEN 'DEFECTIVE' THEN printf('{fv.WHY_DEFECTIVE}', upper(top1), p1, {SURE}::DOUBLE, top1, p1 * 100, top2, p2 * 100, {NOTE_BAD})
                 ELSE printf('{fv.WHY_GOOD}', p1, {SURE}::DOUBLE, p1 * 100, top2, p2 * 100, {NOTE_GOOD}) END"""


@query(oracle=f"SELECT vec_id, {WHY} AS why FROM verdicts")
def rationale(t):
    return verdict_rows(t).select("vec_id", F.col("evidence.why").alias("why"))


@query(oracle="SELECT vec_id, top1, p1, top2, p2 FROM two_best", doubles="p1 p2")
def top2_classes(t):
    _, classes = multiclass_logits(t)
    rows = multi_scored(t).where(F.col("split") == "test").withColumn("two", routing.top_two(F.col("probs"), classes))
    a, b = F.col("two")[0], F.col("two")[1]
    return rows.select(
        "vec_id", a["class"].alias("top1"), a["prob"].alias("p1"), b["class"].alias("top2"), b["prob"].alias("p2")
    )


@query(
    oracle="""SELECT predicted_status, audit, count(*) AS n FROM (
                SELECT CASE WHEN confidence < 0.15 THEN 'UNCERTAIN' WHEN predicted_class <> 'normal' THEN 'REJECT' ELSE 'ACCEPT' END AS predicted_status,
                       CASE WHEN (actual_class <> 'normal') <> (predicted_class <> 'normal') THEN 'wrong'
                            WHEN actual_class = 'normal' OR actual_class = predicted_class THEN 'correct'
                            ELSE 'category mismatch' END AS audit FROM multi WHERE split = 'test') GROUP BY ALL"""
)
def verdict_audit(t):
    rows = routing.route_classes(multi_scored(t).where(F.col("split") == "test"), 0.15)
    return routing.audit(rows).groupBy("predicted_status", "audit").agg(F.count(F.lit(1)).alias("n"))


@query(
    oracle=f"""SELECT vec_id, category AS actual_class, ns > nt AS is_novel, p1 < {SURE} AS is_uncertain, status, {r('p1 * 100.0', 1)} AS confidence_pct,
                      {SURE}::DOUBLE AS threshold, top1 AS top1_class, {r('p1', 4)} AS top1_prob, top2 AS top2_class, {r('p2', 4)} AS top2_prob,
                      {r('ns', 4)} AS novelty_score, {r('nt', 4)} AS novelty_threshold, {r('an', 3)} AS anomaly_score,
                      {r('al', 3)} AS anomaly_threshold, {WHY} AS why FROM verdicts""",
    doubles="confidence_pct threshold top1_prob top2_prob novelty_score novelty_threshold anomaly_score anomaly_threshold",
)
def evidence_records(t):
    return verdict_rows(t).select("vec_id", "actual_class", "is_novel", "is_uncertain", "evidence.*")

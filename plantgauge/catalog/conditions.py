"""Robustness: the class-mean classifier on test vectors under every condition, before and
after its means are taken over augmented copies too."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge.catalog import vectors as vector_queries  # noqa: F401  (registers subqueries used below)
from plantgauge.catalog.base import CTES, query
from plantgauge.catalog.evaluation import RATES, class_means, predictions, sql_ratio, sql_wilson, with_logits
from plantgauge.catalog.splits import split_features
from plantgauge.functions import vectors
from plantgauge.operators import evaluation, neighbors
from plantgauge.session import cut_lineage

UNSURE = 0.15

CTES["centroids_after"] = """
SELECT category, list(m ORDER BY i) AS c FROM (
  SELECT category, i, avg(x) AS m FROM (
    SELECT category, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM (
      SELECT category, embedding::DOUBLE[] AS v FROM split_features WHERE split = 'train'
      UNION ALL SELECT f.category, a.v FROM aug_6 a JOIN split_features f ON f.vec_id = a.vec_id)) GROUP BY category, i) GROUP BY category"""


def _sql_predictions(means: str) -> str:
    return f"""
SELECT vec_id, condition, category AS actual_class, arg_min(class, k) AS predicted_class, max(p) AS confidence,
       CAST(category <> 'normal' AS INTEGER) AS actual,
       CAST(1.0::DOUBLE - max(p) FILTER (WHERE class = 'normal') >= 0.5 AS INTEGER) AS predicted,
       CAST(arg_min(class, k) = category AS INTEGER) AS correct
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, condition ORDER BY p DESC, class) AS k
      FROM (SELECT *, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY vec_id, condition) AS p
            FROM (SELECT *, max(z) OVER (PARTITION BY vec_id, condition) AS top
                  FROM (SELECT p.vec_id, condition, f.category, c.category AS class, 10.0::DOUBLE * list_cosine_similarity(p.v, c.c) AS z
                        FROM perturbed p JOIN split_features f ON f.vec_id = p.vec_id, {means} c WHERE f.split = 'test'))))
GROUP BY vec_id, condition, category"""


CTES["conditioned"] = _sql_predictions("centroids")
CTES["conditioned_after"] = _sql_predictions("centroids_after")
CFRR, CFAR = sql_wilson("fp", "(tn + fp)"), sql_wilson("fn", "(tp + fn)")


def _sql_conditions(source: str) -> str:
    return f"""
SELECT e.*, first_value(accuracy) OVER b - accuracy AS drop_accuracy, first_value(f1_macro) OVER b - f1_macro AS drop_f1_macro
FROM (SELECT g.condition, n, accuracy, f1_macro, tn, fp, fn, tp, {CFRR[0]} AS frr, {CFRR[1]} AS frr_low, {CFRR[2]} AS frr_high,
             {CFAR[0]} AS far, {CFAR[1]} AS far_low, {CFAR[2]} AS far_high, uncertain_fraction, mean_confidence
      FROM (SELECT condition, count(*) AS n, avg(correct) AS accuracy,
                   count(*) FILTER (WHERE actual = 0 AND predicted = 0) AS tn, count(*) FILTER (WHERE actual = 0 AND predicted = 1) AS fp,
                   count(*) FILTER (WHERE actual = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS tp,
                   avg(CAST(confidence < {UNSURE} AS INTEGER)) AS uncertain_fraction, avg(confidence) AS mean_confidence
            FROM {source} GROUP BY condition) g
      JOIN (SELECT condition, avg(f1) AS f1_macro FROM (
              SELECT condition, class, {sql_ratio('2 * sum(hit)', 'sum(called) + sum(support)')} AS f1 FROM (
                SELECT condition, actual_class AS class, 1 AS support, 0 AS called, correct AS hit FROM {source}
                UNION ALL SELECT condition, predicted_class, 0, 1, 0 FROM {source}) GROUP BY condition, class) GROUP BY condition) f
      ON f.condition = g.condition) e
WINDOW b AS (ORDER BY condition <> 'baseline' ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


CTES["condition_eval"] = _sql_conditions("conditioned")
CTES["condition_after"] = _sql_conditions("conditioned_after")
CONDITION_DOUBLES = "accuracy f1_macro " + RATES + " uncertain_fraction mean_confidence drop_accuracy drop_f1_macro"


def conditioned(t, augment: bool = False):
    """Predictions for the test vectors under all twelve conditions."""
    feats = split_features(t).select("vec_id", "category", "split", "embedding")
    train = feats.where(F.col("split") == "train").select("vec_id", "category", vectors.doubles(F.col("embedding")).alias("embedding"))
    if augment:
        train = train.unionByName(neighbors.augmented(train, "embedding", "vec_id"))
    means = class_means(train)
    rows = neighbors.perturbed(feats.where(F.col("split") == "test").drop("split"), "embedding", "vec_id")
    return predictions(with_logits(rows, means), sorted(means), ["condition"]).drop("probs")


def evaluated(t, augment: bool = False):
    return evaluation.evaluate_conditions(cut_lineage(conditioned(t, augment)), threshold=UNSURE)


@query(oracle="SELECT * FROM condition_eval", doubles=CONDITION_DOUBLES)
def condition_eval(t):
    return evaluated(t)


@query(
    oracle="""SELECT condition, drop_accuracy, drop_f1_macro, f1_macro, accuracy FROM condition_eval
              WHERE condition <> 'baseline' ORDER BY round(drop_f1_macro, 9) DESC, condition LIMIT 1""",
    doubles="drop_accuracy drop_f1_macro f1_macro accuracy",
)
def worst_condition(t):
    return evaluation.worst_condition(evaluated(t))


_PAIRS = ["accuracy", "f1_macro", "frr", "far", "mean_confidence"]


@query(
    oracle="SELECT b.condition, "
    + ", ".join(f"b.{c} AS baseline_{c}, a.{c} AS robust_{c}, a.{c} - b.{c} AS delta_{c}" for c in _PAIRS)
    + """, CASE WHEN round(a.f1_macro - b.f1_macro, 9) > 0.001 OR round(a.accuracy - b.accuracy, 9) > 0.001 THEN 'Improved'
               WHEN round(a.f1_macro - b.f1_macro, 9) < -0.001 OR round(a.accuracy - b.accuracy, 9) < -0.001 THEN 'Degraded'
               ELSE 'Unchanged' END AS status
         FROM condition_eval b JOIN condition_after a ON a.condition = b.condition""",
    doubles=" ".join(f"{p}_{c}" for c in _PAIRS for p in ("baseline", "robust", "delta")),
)
def before_after(t):
    return evaluation.before_after(evaluated(t), evaluated(t, augment=True))

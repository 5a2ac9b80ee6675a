"""Evaluation on scores that follow from the tables: a hash-blurred label for the
binary case, nearest class means of the embeddings for the multi-class case."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from plantgauge.catalog.base import CTES, query, r, u
from plantgauge.catalog.splits import split_features
from plantgauge.functions import draws, vectors
from plantgauge.functions.columns import wilson
from plantgauge.operators import evaluation

COST_FR, COST_FA, PI = 41.72, 208.60, 0.10
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 4.0, 8.0]
Z = "1.959963984540054::DOUBLE"

CTES["scored"] = f"""
SELECT *, greatest(p, 1.0::DOUBLE - p) AS confidence, CAST(p >= 0.5 AS INTEGER) AS predicted,
       CAST((p >= 0.5) = (actual = 1) AS INTEGER) AS correct
FROM (SELECT doc_id, 1 - quality AS actual, 0.35::DOUBLE * (1 - quality) + 0.65::DOUBLE * {u("doc_id || '|p'")} AS p,
             CASE WHEN {u("doc_id || '|s'")} < 0.5 THEN 'val' ELSE 'test' END AS split FROM labels)"""
CTES["counts"] = """
SELECT count(*) FILTER (WHERE actual = 0 AND predicted = 0) AS tn, count(*) FILTER (WHERE actual = 0 AND predicted = 1) AS fp,
       count(*) FILTER (WHERE actual = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS tp
FROM scored"""
CTES["centroids"] = """
SELECT category, list(m ORDER BY i) AS c FROM (
  SELECT category, i, avg(x) AS m FROM (
    SELECT category, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i
    FROM split_features WHERE split = 'train') GROUP BY category, i) GROUP BY category"""
CTES["logit_rows"] = """
SELECT f.vec_id, f.category, f.split, c.category AS class, 10.0::DOUBLE * list_cosine_similarity(f.embedding::DOUBLE[], c.c) AS z
FROM split_features f, centroids c"""
CTES["multi"] = """
SELECT vec_id, split, category AS actual_class, arg_min(class, k) AS predicted_class, max(p) AS confidence,
       CAST(category <> 'normal' AS INTEGER) AS actual,
       CAST(1.0::DOUBLE - max(p) FILTER (WHERE class = 'normal') >= 0.5 AS INTEGER) AS predicted
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS k
      FROM (SELECT *, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY vec_id) AS p
            FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM logit_rows)))
GROUP BY vec_id, split, category"""


def scored(t):
    y = 1 - F.col("quality")
    doc = F.col("doc_id")
    rows = t.base("labels").select(
        "doc_id",
        y.alias("actual"),
        (F.lit(0.35) * y + F.lit(0.65) * draws.uniform(doc, "p")).alias("p"),
        F.when(draws.uniform(doc, "s") < 0.5, "val").otherwise("test").alias("split"),
    )
    called = F.col("p") >= 0.5
    return rows.withColumns(
        {
            "confidence": F.greatest(F.col("p"), F.lit(1.0) - F.col("p")),
            "predicted": called.cast("int"),
            "correct": (called == (F.col("actual") == 1)).cast("int"),
        }
    )


def class_means(train) -> dict[str, list[float]]:
    """The mean vector of each class of the training rows, summed JVM-side."""
    mean = Summarizer.mean(array_to_vector(vectors.doubles(F.col("embedding"))))
    rows = train.groupBy("category").agg(vector_to_array(mean).alias("c"))
    return {row["category"]: row["c"] for row in rows.collect()}  # one row per class


def with_logits(rows, means: dict[str, list[float]]):
    """Adds ``logits`` (10 times the cosine with each class mean, classes in order of name)."""

    def direction(c):
        size = max(1e-10, math.sqrt(sum(x * x for x in means[c])))
        return F.lit([x / size for x in means[c]])

    v = vectors.unit(vectors.doubles(F.col("embedding")))
    z = vectors.let(v, lambda q: F.array(*[F.lit(10.0) * vectors.dot(q, direction(c)) for c in sorted(means)]))
    return rows.withColumn("logits", z)


def predictions(rows, classes: list[str], keep=()):
    """vec_id, actual_class, predicted_class, confidence, actual, predicted, probs from logits."""
    normal = classes.index("normal")
    scores = vectors.let(
        vectors.softmax(F.col("logits")),
        lambda p: F.struct(
            vectors.argmax(p).alias("best"), F.array_max(p).alias("top"), p[normal].alias("good"), p.alias("probs")
        ),
    )
    return rows.withColumn("s", scores).select(
        "vec_id", *keep, F.col("category").alias("actual_class"),
        F.element_at(F.lit(classes), F.col("s.best") + 1).alias("predicted_class"),
        F.col("s.top").alias("confidence"),
        (F.col("category") != "normal").cast("int").alias("actual"),
        (F.lit(1.0) - F.col("s.good") >= 0.5).cast("int").alias("predicted"),
        F.col("s.probs").alias("probs"),
    )


def multiclass_logits(t):
    """(rows with logits against each class mean, sorted class names)."""
    feats = split_features(t)
    means = class_means(feats.where(F.col("split") == "train"))
    classes = sorted(means)
    target = F.array_position(F.lit(classes), F.col("category")).cast("int") - 1
    return with_logits(feats, means).select("vec_id", "category", "split", "logits", target.alias("target")), classes


def multi_scored(t):
    rows, classes = multiclass_logits(t)
    return predictions(rows, classes, ["split"])


def sql_wilson(count: str, n: str) -> tuple[str, str, str]:
    p = f"({count} / {n}::DOUBLE)"
    centre = f"({p} + {Z} * {Z} / (2.0::DOUBLE * {n}))"
    half = f"({Z} * sqrt({p} * (1.0 - {p}) / {n} + {Z} * {Z} / (4.0::DOUBLE * {n} * {n})))"
    den = f"(1.0::DOUBLE + {Z} * {Z} / {n})"
    low = f"CASE WHEN {n} <= 0 OR {count} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, ({centre} - {half}) / {den}) END"
    high = f"CASE WHEN {n} <= 0 THEN 0.0::DOUBLE WHEN {count} = {n} THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, ({centre} + {half}) / {den}) END"
    return f"CASE WHEN {n} <= 0 THEN 0.0::DOUBLE ELSE {p} END", low, high


def sql_ratio(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN ({n}) / ({d})::DOUBLE ELSE 0.0::DOUBLE END"


WB = sql_wilson("defect_count", "total_units")


@query(
    oracle=f"SELECT batch_id, {WB[0]} AS rate, {WB[1]} AS low, {WB[2]} AS high FROM batch_quality",
    doubles="rate low high",
)
def wilson_rates(t):
    from plantgauge.operators.batch import batch_quality

    w = wilson(F.col("defect_count"), F.col("total_units"))
    return batch_quality(t.inspection).select("batch_id", *[w[k].alias(k) for k in ("rate", "low", "high")])


FRR, FAR = sql_wilson("fp", "(tn + fp)"), sql_wilson("fn", "(tp + fn)")
BINARY = f"""tn, fp, fn, tp, (tp + tn) / (tn + fp + fn + tp)::DOUBLE AS accuracy, {sql_ratio('tp', 'tp + fp')} AS precision,
{sql_ratio('tp', 'tp + fn')} AS recall, {sql_ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
({sql_ratio('2 * tp', '2 * tp + fp + fn')} + {sql_ratio('2 * tn', '2 * tn + fn + fp')}) / 2.0 AS f1_macro,
{FRR[0]} AS frr, {FRR[1]} AS frr_low, {FRR[2]} AS frr_high, {FAR[0]} AS far, {FAR[1]} AS far_low, {FAR[2]} AS far_high"""
RATES = "frr frr_low frr_high far far_low far_high"


@query(oracle=f"SELECT {BINARY} FROM counts", doubles="accuracy precision recall f1 f1_macro " + RATES)
def confusion_binary(t):
    return evaluation.binary_rates(evaluation.confusion_counts(scored(t)))


CTES["cells"] = """
SELECT actual_class, predicted_class, count(*) AS n FROM multi WHERE split = 'test' GROUP BY ALL"""
CTES["per_class"] = f"""
SELECT class, {sql_ratio('hit', 'called')} AS precision, {sql_ratio('hit', 'support')} AS recall,
       {sql_ratio('2 * hit', 'called + support')} AS f1, support
FROM (SELECT class, coalesce((SELECT sum(n) FROM cells WHERE actual_class = class), 0)::BIGINT AS support,
             coalesce((SELECT sum(n) FROM cells WHERE predicted_class = class), 0)::BIGINT AS called,
             coalesce((SELECT sum(n) FROM cells WHERE predicted_class = class AND actual_class = class), 0)::BIGINT AS hit
      FROM (SELECT actual_class AS class FROM cells UNION SELECT predicted_class FROM cells))"""


def test_cells(t):
    return evaluation.confusion_matrix(
        multi_scored(t).where(F.col("split") == "test"), (), "actual_class", "predicted_class"
    )


@query(oracle="SELECT * FROM cells")
def confusion_multi(t):
    return test_cells(t)


@query(oracle="SELECT * FROM per_class", doubles="precision recall f1")
def per_class_metrics(t):
    return evaluation.per_class_metrics(test_cells(t), (), "actual_class", "predicted_class")


@query(
    oracle="""SELECT avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
                     sum(recall * support) / sum(support) AS accuracy, CAST(sum(support) AS BIGINT) AS n FROM per_class""",
    doubles="precision_macro recall_macro f1_macro accuracy",
)
def macro_metrics(t):
    return evaluation.macro_metrics(evaluation.per_class_metrics(test_cells(t), (), "actual_class", "predicted_class"))


CTES["steps"] = """
SELECT p AS score, pos, neg, row_number() OVER w AS step, count(*) OVER () AS steps, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
       sum(pos) OVER () AS np, sum(neg) OVER () AS nn
FROM (SELECT p, count(*) FILTER (WHERE actual = 1) AS pos, count(*) FILTER (WHERE actual = 0) AS neg FROM scored GROUP BY p)
WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"""


def score_steps(t):
    return evaluation.score_steps(scored(t), score="p")


@query(
    oracle="""SELECT sum(neg * (tp - pos + tp) / 2.0::DOUBLE) / (max(np) * max(nn)) AS roc_auc,
                     sum(pos * (tp / (tp + fp)::DOUBLE + CASE WHEN tp + fp - pos - neg > 0
                         THEN (tp - pos) / (tp + fp - pos - neg)::DOUBLE ELSE 1.0::DOUBLE END) / 2.0::DOUBLE) / max(np) AS pr_auc,
                     CAST(max(np) AS BIGINT) AS positives, CAST(max(nn) AS BIGINT) AS negatives FROM steps""",
    doubles="roc_auc pr_auc",
)
def roc_auc(t):
    return evaluation.areas(score_steps(t))


@query(
    oracle="SELECT step, steps, score AS threshold, fp / nn::DOUBLE AS fpr, tp / np::DOUBLE AS tpr FROM steps",
    doubles="threshold fpr tpr",
)
def roc_curve(t):
    return evaluation.roc_curve(score_steps(t), score="p")


@query(
    oracle="""SELECT step, steps, score AS threshold, tp / np::DOUBLE AS recall, tp / (tp + fp)::DOUBLE AS precision FROM steps
              WHERE (step - 1) % greatest(1, steps // 50) = 0""",
    doubles="threshold recall precision",
)
def pr_curve(t):
    return evaluation.strided(evaluation.pr_curve(score_steps(t), score="p"))


def _sql_bins(source: str, value: str, right: str, keep: str) -> str:
    return f"""
SELECT b.bin, b.bin * 0.1::DOUBLE AS lower, (b.bin + 1) * 0.1::DOUBLE AS upper,
       (b.bin * 0.1::DOUBLE + (b.bin + 1) * 0.1::DOUBLE) / 2.0 AS center, coalesce(n, 0) AS count,
       coalesce(n, 0) / (SELECT count(*) FROM {source})::DOUBLE AS fraction, coalesce(acc, 0.0::DOUBLE) AS accuracy,
       coalesce(conf, (b.bin * 0.1::DOUBLE + (b.bin + 1) * 0.1::DOUBLE) / 2.0) AS confidence,
       coalesce(abs(acc - conf), 0.0::DOUBLE) AS gap,
       coalesce(n / (SELECT count(*) FROM {source})::DOUBLE * abs(acc - conf), 0.0::DOUBLE) AS ece_part
FROM (SELECT unnest(range(10))::INTEGER AS bin) b LEFT JOIN (
  SELECT bin, count(*) AS n, avg({right}) AS acc, avg(v) AS conf FROM (
    SELECT *, {value} AS v, {' + '.join(f'CAST({value} >= {i} * 0.1::DOUBLE AS INTEGER)' for i in range(1, 10))} AS bin
    FROM {source}) WHERE {keep} GROUP BY bin) g ON g.bin = b.bin"""


BIN_DOUBLES = "lower upper center fraction accuracy confidence gap ece_part"
CTES["multi_test"] = """
SELECT *, CAST(actual_class = predicted_class AS INTEGER) AS correct FROM multi WHERE split = 'test'"""


@query(oracle=_sql_bins("multi_test", "confidence", "correct", "true"), doubles=BIN_DOUBLES)
def ece_bins(t):
    rows = multi_scored(t).where(F.col("split") == "test")
    return evaluation.ece_bins(rows.withColumn("correct", (F.col("actual_class") == F.col("predicted_class")).cast("int")))


@query(
    oracle=f"SELECT sum(ece_part) AS ece FROM ({_sql_bins('scored', 'p', 'actual', 'v < 1.0')})",
    doubles="ece",
)
def ece_binary(t):
    return evaluation.ece(evaluation.ece_bins(scored(t), confidence="p", correct="actual", last_closed=False))


@query(
    oracle=f"""SELECT temperature, avg(lse - zt / temperature) AS nll FROM (
                 SELECT vec_id, temperature, ln(sum(exp((z - top) / temperature))) AS lse,
                        max(CASE WHEN class = category THEN z - top END) AS zt
                 FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM logit_rows WHERE split = 'val'),
                      (SELECT unnest({TEMPERATURES})::DOUBLE AS temperature)
                 GROUP BY vec_id, temperature) GROUP BY temperature""",
    doubles="temperature nll",
)
def temperature_grid(t):
    rows, _ = multiclass_logits(t)
    return evaluation.nll_by_temperature(rows.where(F.col("split") == "val"), TEMPERATURES)


@query(
    oracle="""SELECT vec_id, class, exp((z - top) / 2.0::DOUBLE) / sum(exp((z - top) / 2.0::DOUBLE)) OVER (PARTITION BY vec_id) AS prob
              FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM logit_rows)""",
    doubles="prob",
)
def softmax_probs(t):
    rows, classes = multiclass_logits(t)
    pairs = F.arrays_zip(F.lit(classes).alias("class"), vectors.softmax(F.col("logits"), 2.0).alias("prob"))
    return rows.select("vec_id", F.explode(pairs).alias("e")).select("vec_id", "e.class", "e.prob")


STEP = "((0.99::DOUBLE - 0.01::DOUBLE) / 199)"
CTES["cost_curve"] = f"""
SELECT threshold, frr, far, 1000.0::DOUBLE * ({COST_FR * (1 - PI)}::DOUBLE * frr + {COST_FA * PI}::DOUBLE * far) AS cost_per_1000
FROM (SELECT threshold, count(*) FILTER (WHERE actual = 0 AND p >= threshold) / greatest(1, count(*) FILTER (WHERE actual = 0))::DOUBLE AS frr,
             count(*) FILTER (WHERE actual = 1 AND p < threshold) / greatest(1, count(*) FILTER (WHERE actual = 1))::DOUBLE AS far
      FROM scored, (SELECT CASE WHEN i = 199 THEN 0.99::DOUBLE ELSE 0.01::DOUBLE + i * {STEP} END AS threshold
                    FROM (SELECT unnest(range(200)) AS i))
      WHERE split = 'val' GROUP BY threshold)"""
CTES["best_threshold"] = f"""
SELECT {r('threshold', 4)} AS optimal_threshold, cost_per_1000 AS expected_cost_per_1000, frr, far
FROM cost_curve ORDER BY round(cost_per_1000, 9), threshold LIMIT 1"""


@query(oracle="SELECT * FROM cost_curve", doubles="threshold frr far cost_per_1000")
def cost_curve(t):
    return evaluation.cost_curve(scored(t).where(F.col("split") == "val"), COST_FR, COST_FA, PI)


@query(oracle="SELECT * FROM best_threshold", doubles="optimal_threshold expected_cost_per_1000 frr far")
def cost_threshold(t):
    return evaluation.best_threshold(cost_curve(t))


OFRR, OFAR = sql_wilson("fp_count", "greatest(1, tn + fp_count)"), sql_wilson("fn_count", "greatest(1, tp + fn_count)")


@query(
    oracle=f"""SELECT *, 1000.0::DOUBLE * ({COST_FR * (1 - PI)}::DOUBLE * frr + {COST_FA * PI}::DOUBLE * far) AS expected_cost_per_1000,
                      {1000 * (1 - PI)}::DOUBLE * frr AS false_rejects_per_1000, {1000 * PI}::DOUBLE * far AS escaped_defects_per_1000
               FROM (SELECT optimal_threshold, fp_count, fn_count, {OFRR[0]} AS frr, {OFRR[1]} AS frr_low, {OFRR[2]} AS frr_high,
                            {OFAR[0]} AS far, {OFAR[1]} AS far_low, {OFAR[2]} AS far_high
                     FROM (SELECT any_value(optimal_threshold) AS optimal_threshold,
                                  count(*) FILTER (WHERE actual = 0 AND p >= optimal_threshold) AS fp_count,
                                  count(*) FILTER (WHERE actual = 1 AND p < optimal_threshold) AS fn_count,
                                  count(*) FILTER (WHERE actual = 0 AND p < optimal_threshold) AS tn,
                                  count(*) FILTER (WHERE actual = 1 AND p >= optimal_threshold) AS tp
                           FROM scored, (SELECT optimal_threshold FROM best_threshold) WHERE split = 'test'))""",
    doubles="optimal_threshold " + RATES + " expected_cost_per_1000 false_rejects_per_1000 escaped_defects_per_1000",
)
def operating_point(t):
    rows = scored(t)
    best = evaluation.best_threshold(evaluation.cost_curve(rows.where(F.col("split") == "val"), COST_FR, COST_FA, PI))
    return evaluation.operating_point(rows.where(F.col("split") == "test"), best, COST_FR, COST_FA, PI)


CSTEP = "((0.99::DOUBLE - 0.5::DOUBLE) / 49)"


@query(
    oracle=f"""SELECT threshold, count(*) FILTER (WHERE confidence >= threshold) / count(*)::DOUBLE AS coverage,
                      coalesce(avg(correct) FILTER (WHERE confidence >= threshold), 1.0) AS accuracy
               FROM scored, (SELECT CASE WHEN i = 49 THEN 0.99::DOUBLE ELSE 0.5::DOUBLE + i * {CSTEP} END AS threshold
                             FROM (SELECT unnest(range(50)) AS i)) GROUP BY threshold""",
    doubles="threshold coverage accuracy",
)
def coverage_curve(t):
    return evaluation.coverage_curve(scored(t))


@query(
    oracle="""SELECT count(*) AS n, count(*) FILTER (WHERE confidence < 0.7) AS uncertain_count,
                     count(*) FILTER (WHERE confidence < 0.7) / count(*)::DOUBLE AS uncertain_fraction,
                     count(*) FILTER (WHERE confidence >= 0.7) AS confident_count,
                     coalesce(avg(correct) FILTER (WHERE confidence >= 0.7), 0.0) AS confident_accuracy FROM scored""",
    doubles="uncertain_fraction confident_accuracy",
)
def selective_metrics(t):
    return evaluation.selective_metrics(scored(t))


@query(
    oracle="""SELECT count(*) AS n, avg(CAST(p <= (SELECT quantile_cont(p, 0.99) FROM scored WHERE split = 'val' AND actual = 0)
                                             AS INTEGER)) AS fraction_below_limit
              FROM scored WHERE split = 'test' AND actual = 0""",
    doubles="fraction_below_limit",
)
def below_limit(t):
    from plantgauge.operators.prefix import percentiles

    good = scored(t).where(F.col("actual") == 0)
    limit = percentiles(good.where(F.col("split") == "val"), [], "p", {"limit": 0.99}).select("limit").scalar()
    return evaluation.below_limit(good.where(F.col("split") == "test"), F.col("p"), limit)

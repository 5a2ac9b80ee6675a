"""Classifier evaluation on a scored frame: confusion, curves, calibration, costs.

Every operator takes ``by``, the columns that separate models or conditions, and
first collapses the rows (per score, per bin or per threshold), so that nothing
larger than the number of distinct scores is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantgauge import fixed_values as fv
from plantgauge.functions import vectors
from plantgauge.functions.columns import per_unit, ratio, rounded, wilson
from plantgauge.operators.prefix import running
from plantgauge.session import cut_lineage


def _count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def _join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on the group keys; without keys both sides have few rows and one is a single row."""
    if by:
        return left.join(right, list(by), how)
    row = right.select(F.struct("*")).scalar()
    return left.withColumns({c: row[c] for c in right.columns})


# ---- confusion -------------------------------------------------------------


def confusion_counts(df: DataFrame, by: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """tn, fp, fn, tp of 0/1 columns."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    return df.groupBy(*by).agg(
        _count_if(~a & ~p).alias("tn"), _count_if(~a & p).alias("fp"),
        _count_if(a & ~p).alias("fn"), _count_if(a & p).alias("tp"),
    )


def binary_rates(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1, macro F1, and FRR / FAR with Wilson intervals."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1 = ratio(tp * 2.0, tp * 2 + fp + fn)
    f1_good = ratio(tn * 2.0, tn * 2 + fn + fp)
    frr, far = wilson(fp, tn + fp), wilson(fn, tp + fn)
    return counts.select(
        *by, "tn", "fp", "fn", "tp",
        ratio((tp + tn).cast("double"), tn + fp + fn + tp).alias("accuracy"),
        ratio(tp.cast("double"), tp + fp).alias("precision"),
        ratio(tp.cast("double"), tp + fn).alias("recall"),
        f1.alias("f1"),
        ((f1 + f1_good) / 2.0).alias("f1_macro"),
        frr["rate"].alias("frr"), frr["low"].alias("frr_low"), frr["high"].alias("frr_high"),
        far["rate"].alias("far"), far["low"].alias("far_low"), far["high"].alias("far_high"),
    )


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), actual="actual", predicted="predicted") -> DataFrame:
    """Cells of the multi-class matrix that occur: actual, predicted, n."""
    return df.groupBy(*by, actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def per_class_metrics(cells: DataFrame, by: Sequence[str] = (), actual="actual", predicted="predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, from the matrix cells."""
    a, p, n = F.col(actual), F.col(predicted), F.col("n")
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(a.alias("class"), n.alias("support"), none.alias("called"), F.when(a == p, n).otherwise(none).alias("hit")),
        F.struct(p.alias("class"), none.alias("support"), n.alias("called"), none.alias("hit")),
    )
    rows = cells.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    g = rows.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hit")])
    hit = F.col("hit").cast("double")
    return g.select(
        *by, "class",
        ratio(hit, F.col("called")).alias("precision"),
        ratio(hit, F.col("support")).alias("recall"),
        ratio(hit * 2.0, F.col("called") + F.col("support")).alias("f1"),
        "support",
    )


def macro_metrics(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted class means, and accuracy as the support-weighted recall."""
    return per_class.groupBy(*by).agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("n"),
    )


# ---- curves ----------------------------------------------------------------


def score_steps(df: DataFrame, by: Sequence[str] = (), score: str = "score", actual: str = "actual") -> DataFrame:
    """One row per distinct score, highest first, with the positives and negatives
    at it (pos, neg), above it (before_) and in all (total_)."""
    pos = F.col(actual) == 1
    hist = df.groupBy(*by, score).agg(_count_if(pos).alias("pos"), _count_if(~pos).alias("neg"))
    return running(hist, by, [F.desc(score)], {"pos": "pos", "neg": "neg", "step": F.lit(1).cast("long")})


def roc_curve(steps: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """step, threshold, fpr, tpr; the corner (0, 0) belongs to no threshold and is left out."""
    return steps.select(
        *by, (F.col("before_step") + 1).alias("step"), F.col("total_step").alias("steps"), F.col(score).alias("threshold"),
        per_unit(F.col("before_neg") + F.col("neg"), F.col("total_neg")).alias("fpr"),
        per_unit(F.col("before_pos") + F.col("pos"), F.col("total_pos")).alias("tpr"),
    )


def pr_curve(steps: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """step, threshold, recall, precision; the end (recall 0, precision 1) is left out."""
    tp = F.col("before_pos") + F.col("pos")
    called = tp + F.col("before_neg") + F.col("neg")
    return steps.select(
        *by, (F.col("before_step") + 1).alias("step"), F.col("total_step").alias("steps"), F.col(score).alias("threshold"),
        per_unit(tp, F.col("total_pos")).alias("recall"), per_unit(tp, called).alias("precision"),
    )


def strided(curve: DataFrame, points: int = 50) -> DataFrame:
    """Every (steps div points)-th step, starting with the first."""
    stride = F.greatest(F.lit(1), F.floor(F.col("steps") / points))
    return curve.where((F.col("step") - 1) % stride == 0)


def areas(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid areas under both curves, each trapezoid from its own step."""
    pos, neg, bp, bn = (F.col(c) for c in ("pos", "neg", "before_pos", "before_neg"))
    now = (bp + pos) / (bp + pos + bn + neg)
    before = F.when(bp + bn > 0, bp / F.greatest(F.lit(1), bp + bn)).otherwise(1.0)
    return steps.groupBy(*by).agg(
        (F.sum(neg * (bp + bp + pos) / 2.0) / F.greatest(F.lit(1), F.max("total_pos") * F.max("total_neg"))).alias("roc_auc"),
        (F.sum(pos * (now + before) / 2.0) / F.greatest(F.lit(1), F.max("total_pos"))).alias("pr_auc"),
        F.max("total_pos").alias("positives"), F.max("total_neg").alias("negatives"),
    )


# ---- calibration -----------------------------------------------------------


def _groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.select(*by).distinct() if by else df.sparkSession.range(1).select()


def _bin(c: Column, n_bins: int) -> Column:
    """Index of the equal-width bin of [0, 1]; 1.0 falls in the last."""
    step = 1.0 / n_bins
    inner = [(c >= i * step).cast("int") for i in range(1, n_bins)]
    return sum(inner[1:], inner[0])


def ece_bins(
    df: DataFrame, by: Sequence[str] = (), confidence: str = "confidence", correct: str = "correct",
    n_bins: int = 10, last_closed: bool = True,
) -> DataFrame:
    """Reliability bins, empty ones included, and each bin's share of the error.

    ``last_closed`` False leaves out a confidence of exactly 1 (but still counts
    it in the total), which is how the binary variant is defined.
    """
    value = F.col(confidence)
    binned = df.withColumn("bin", _bin(value, n_bins))
    inside = F.lit(True) if last_closed else value < 1.0
    g = binned.groupBy(*by, "bin").agg(
        _count_if(inside).alias("count"),
        F.avg(F.when(inside, F.col(correct).cast("double"))).alias("_acc"),
        F.avg(F.when(inside, value)).alias("_conf"),
        F.count(F.lit(1)).alias("_all"),
    )
    grid = _groups(df, by).select(*by, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    full = grid.join(g, [*by, "bin"], "left")
    whole = F.sum("_all").over(Window.partitionBy(*by))  # n_bins rows per group
    width = F.lit(1.0 / n_bins)
    centre = (F.col("bin") * width + (F.col("bin") + 1) * width) / 2.0
    n = F.coalesce("count", F.lit(0).cast("long"))
    gap = F.abs(F.coalesce("_acc", F.lit(0.0)) - F.coalesce("_conf", F.lit(0.0)))
    share = n / F.greatest(F.lit(1), whole)
    return full.select(
        *by, "bin",
        (F.col("bin") * width).alias("lower"), ((F.col("bin") + 1) * width).alias("upper"), centre.alias("center"),
        n.alias("count"), share.alias("fraction"),
        F.coalesce("_acc", F.lit(0.0)).alias("accuracy"),
        F.coalesce("_conf", centre).alias("confidence"),
        F.when(n > 0, gap).otherwise(0.0).alias("gap"),
        F.when(n > 0, share * gap).otherwise(0.0).alias("ece_part"),
    )


def ece(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return bins.groupBy(*by).agg(F.sum("ece_part").alias("ece"))


def nll_by_temperature(
    df: DataFrame, temperatures: Sequence[float], by: Sequence[str] = (), logits: str = "logits", target: str = "target"
) -> DataFrame:
    """Mean negative log-likelihood at each temperature; partial sums only are shuffled."""
    grid = F.array(*[F.lit(float(t)) for t in temperatures])
    rows = df.select(*by, logits, target, F.explode(grid).alias("temperature"))
    loss = vectors.neg_log_likelihood(F.col(logits), F.col(target), F.col("temperature"))
    return rows.groupBy(*by, "temperature").agg(F.avg(loss).alias("nll"))


def fit_temperature(
    df: DataFrame, logits: str = "logits", target: str = "target", low: float = 0.01, high: float = 10.0,
    points: int = 33, rounds: int = 4,
) -> float:
    """The temperature in [low, high] with the least NLL: the loss is unimodal in
    T, so each job narrows the range to the two steps around the best point."""
    rows = df.select(logits, target).where(F.col(logits).isNotNull()).persist()
    try:
        a, b, best = low, high, 1.0
        for _ in range(rounds):
            step = (b - a) / (points - 1)
            found = nll_by_temperature(rows, [a + step * i for i in range(points)], (), logits, target)
            row = found.where(F.col("nll").isNotNull()).agg(F.min_by("temperature", F.struct("nll", "temperature"))).first()
            if row[0] is None:
                return 1.0
            best = row[0]
            a, b = max(low, best - step), min(high, best + step)
        return max(0.01, best)
    finally:
        rows.unpersist()


# ---- thresholds ------------------------------------------------------------


def _linspace(low: float, high: float, n: int, i: Column) -> Column:
    step = (high - low) / (n - 1)
    return F.when(i == n - 1, F.lit(high)).otherwise(F.lit(low) + i * F.lit(step))


def thresholds_passed(c: Column, low: float, high: float, n: int) -> Column:
    """How many of the n evenly spaced thresholds are <= c, compared exactly:
    arithmetic gives the neighbourhood, comparisons decide."""
    step = (high - low) / (n - 1)
    near = F.floor((c - F.lit(low)) / F.lit(step))
    base = F.greatest(F.lit(-1), F.least(F.lit(n), near))
    hits = [
        F.when((base + d >= 0) & (base + d <= n - 1) & (_linspace(low, high, n, base + d) <= c), 1).otherwise(0)
        for d in (-1, 0, 1)
    ]
    below = F.greatest(F.lit(0), F.least(F.lit(n), base - 1))
    return (below + sum(hits[1:], hits[0])).cast("int")


def _sweep(df: DataFrame, by: Sequence[str], value: Column, low: float, high: float, n: int, sums: dict[str, Column]) -> DataFrame:
    """Per threshold: ``over_<name>`` summed over rows with value >= it, and ``all_<name>``.

    Rows are first counted per number of thresholds they pass (n+1 groups).
    """
    hist = df.withColumn("_k", thresholds_passed(value, low, high, n)).groupBy(*by, "_k").agg(
        *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    grid = _groups(df, by).select(*by, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_k"))
    full = grid.join(hist, [*by, "_k"], "left").na.fill(0, list(sums))
    whole = Window.partitionBy(*by)  # n+1 rows per group
    from_top = whole.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
    swept = full.select(
        *by, "_k",
        *[F.coalesce(F.sum(s).over(from_top), F.lit(0)).alias(f"over_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"all_{s}") for s in sums],
    )
    return swept.where(F.col("_k") < n).withColumn("threshold", _linspace(low, high, n, F.col("_k"))).drop("_k")


def cost_curve(
    df: DataFrame, cost_fr: float, cost_fa: float, prevalence: float = 0.10, by: Sequence[str] = (),
    p: str = "p", actual: str = "actual", n_grid: int = 200,
) -> DataFrame:
    """FRR, FAR and expected cost per 1000 units at each threshold of the grid."""
    pi = min(0.999, max(0.001, float(prevalence)))
    defect = F.col(actual) == 1
    swept = _sweep(df, by, F.col(p), 0.01, 0.99, n_grid, {
        "good": F.when(defect, 0).otherwise(1), "bad": F.when(defect, 1).otherwise(0),
    })
    frr = per_unit(F.col("over_good"), F.col("all_good"))
    far = per_unit(F.col("all_bad") - F.col("over_bad"), F.col("all_bad"))
    cost = F.lit(1000.0) * (F.lit(cost_fr * (1.0 - pi)) * frr + F.lit(cost_fa * pi) * far)
    return swept.select(*by, "threshold", frr.alias("frr"), far.alias("far"), cost.alias("cost_per_1000"))


def best_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The first threshold of least cost."""
    least = F.min_by(F.struct("threshold", "cost_per_1000", "frr", "far"), F.struct(F.round("cost_per_1000", 9), F.col("threshold")))
    return curve.groupBy(*by).agg(least.alias("b")).select(
        *by, rounded(F.col("b.threshold"), 4).alias("optimal_threshold"),
        F.col("b.cost_per_1000").alias("expected_cost_per_1000"), F.col("b.frr").alias("frr"), F.col("b.far").alias("far"),
    )


def operating_point(
    df: DataFrame, best: DataFrame, cost_fr: float, cost_fa: float, prevalence: float = 0.10, by: Sequence[str] = (),
    p: str = "p", actual: str = "actual",
) -> DataFrame:
    """Rates, intervals and cost of the chosen threshold on other rows."""
    rows = _join(df, best.select(*by, "optimal_threshold"), by)
    called = rows.withColumn("predicted", (F.col(p) >= F.col("optimal_threshold")).cast("int"))
    counts = confusion_counts(called, [*by, "optimal_threshold"], actual)
    fp, fn = F.col("fp"), F.col("fn")
    frr = wilson(fp, F.greatest(F.lit(1), F.col("tn") + fp))
    far = wilson(fn, F.greatest(F.lit(1), F.col("tp") + fn))
    pi = float(prevalence)
    return counts.select(
        *by, "optimal_threshold", fp.alias("fp_count"), fn.alias("fn_count"),
        frr["rate"].alias("frr"), frr["low"].alias("frr_low"), frr["high"].alias("frr_high"),
        far["rate"].alias("far"), far["low"].alias("far_low"), far["high"].alias("far_high"),
        (F.lit(1000.0) * (F.lit(cost_fr * (1.0 - pi)) * frr["rate"] + F.lit(cost_fa * pi) * far["rate"])).alias("expected_cost_per_1000"),
        (F.lit(1000.0 * (1.0 - pi)) * frr["rate"]).alias("false_rejects_per_1000"),
        (F.lit(1000.0 * pi) * far["rate"]).alias("escaped_defects_per_1000"),
    )


def coverage_curve(
    df: DataFrame, by: Sequence[str] = (), confidence: str = "confidence", correct: str = "correct",
    low: float = 0.50, high: float = 0.99, n: int = 50,
) -> DataFrame:
    """Share of rows at or above each confidence, and their accuracy (1 if there are none)."""
    swept = _sweep(df, by, F.col(confidence), low, high, n, {
        "rows": F.lit(1), "right": F.col(correct).cast("int"),
    })
    covered = F.col("over_rows")
    return swept.select(
        *by, "threshold", per_unit(covered, F.col("all_rows")).alias("coverage"),
        F.when(covered > 0, F.col("over_right") / F.greatest(F.lit(1), covered)).otherwise(1.0).alias("accuracy"),
    )


def selective_metrics(
    df: DataFrame, threshold: float = fv.UNCERTAIN_BELOW, by: Sequence[str] = (), confidence="confidence", correct="correct"
) -> DataFrame:
    """How many rows are uncertain, and the accuracy of the others (0 if there are none)."""
    sure = F.col(confidence) >= threshold
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), _count_if(~sure).alias("uncertain_count"),
        _count_if(sure & (F.col(correct).cast("int") == 1)).alias("_right"),
    )
    confident = F.col("n") - F.col("uncertain_count")
    return g.select(
        *by, "n", "uncertain_count", per_unit(F.col("uncertain_count"), F.col("n")).alias("uncertain_fraction"),
        confident.alias("confident_count"), ratio(F.col("_right").cast("double"), confident).alias("confident_accuracy"),
    )


def below_limit(df: DataFrame, score: Column, limit: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose score does not exceed the limit."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((score <= limit).cast("double")).alias("fraction_below_limit")
    )


# ---- conditions ------------------------------------------------------------


def evaluate_conditions(
    df: DataFrame, condition: str = "condition", baseline: str = "baseline", by: Sequence[str] = (),
    threshold: float = fv.UNCERTAIN_BELOW,
) -> DataFrame:
    """Metrics per condition and their drop against the baseline condition.

    ``df`` holds actual_class, predicted_class, actual, predicted (0/1) and confidence.
    One grouping of ``df`` into cells; all figures follow from these few rows.
    """
    keys = [*by, condition]
    groups = [*keys, "actual_class", "predicted_class", "actual", "predicted"]
    cells = cut_lineage(
        df.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("n"),
            _count_if(F.col("confidence") < threshold).alias("_unsure"),
            F.sum("confidence").alias("_sum"),
            F.count("confidence").alias("_known"),
        )
    )
    matrix = cells.groupBy(*keys, "actual_class", "predicted_class").agg(F.sum("n").alias("n"))
    multi = macro_metrics(per_class_metrics(matrix, keys, "actual_class", "predicted_class"), keys)
    bad, called = F.col("actual") == 1, F.col("predicted") == 1
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    counts = cells.groupBy(*keys).agg(
        total(~bad & ~called).alias("tn"), total(~bad & called).alias("fp"), total(bad & ~called).alias("fn"), total(bad & called).alias("tp")
    )
    binary = binary_rates(counts, keys).drop("accuracy", "precision", "recall", "f1", "f1_macro")
    sure = cells.groupBy(*keys).agg(
        (F.sum("_unsure") / F.sum("_known")).alias("uncertain_fraction"), (F.sum("_sum") / F.sum("_known")).alias("mean_confidence")
    )
    rows = multi.select(*keys, "n", "accuracy", "f1_macro").join(binary, keys).join(sure, keys)
    # one row per condition, so the window is small
    whole = Window.partitionBy(*by)
    of_base = lambda c: F.max(F.when(F.col(condition) == baseline, F.col(c))).over(whole) - F.col(c)
    return rows.select("*", of_base("accuracy").alias("drop_accuracy"), of_base("f1_macro").alias("drop_f1_macro"))


def worst_condition(evaluated: DataFrame, condition: str = "condition", baseline: str = "baseline", by: Sequence[str] = ()) -> DataFrame:
    """The condition with the largest F1 drop, name breaking ties."""
    most = F.min_by(
        F.struct(condition, "drop_accuracy", "drop_f1_macro", "f1_macro", "accuracy"),
        F.struct(-F.round("drop_f1_macro", 9), F.col(condition)),
    )
    return evaluated.where(F.col(condition) != baseline).groupBy(*by).agg(most.alias("w")).select(*by, "w.*")


def before_after(before: DataFrame, after: DataFrame, condition: str = "condition") -> DataFrame:
    """Deltas per condition and whether it improved; improvement is tested first."""
    names = ["accuracy", "f1_macro", "frr", "far", "mean_confidence"]
    left = before.select(condition, *[F.col(c).alias(f"baseline_{c}") for c in names])
    right = after.select(condition, *[F.col(c).alias(f"robust_{c}") for c in names])
    both = left.join(right, condition).withColumns(
        {f"delta_{c}": F.col(f"robust_{c}") - F.col(f"baseline_{c}") for c in names}
    )
    acc, f1 = F.round("delta_accuracy", 9), F.round("delta_f1_macro", 9)
    status = F.when((f1 > 0.001) | (acc > 0.001), "Improved").when((f1 < -0.001) | (acc < -0.001), "Degraded")
    return both.withColumn("status", status.otherwise("Unchanged"))

"""Which process parameters go with defects: rank correlation, median split,
false-discovery control and bootstrap ranges.

Everything runs on pairs (keys, batch_id, x, y), one pipeline for all
parameters and all defect families at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantgauge import fixed_values as fv
from plantgauge.functions import draws
from plantgauge.functions.columns import clamp, rounded
from plantgauge.functions.tails import t_two_sided, u_two_sided
from plantgauge.operators import batch
from plantgauge.operators.bounds import BROADCAST_ROWS, WINDOW_ROWS, row_count, small_side
from plantgauge.operators.prefix import mid_ranks, numbered, percentiles
from plantgauge.session import cut_lineage

# Means that differ only by summation order must tie, or ranks would not be reproducible.
VALUE_DIGITS = 10
# pairs of a task that resamples: 64 MB of value numbers
TASK_PAIRS = 8_000_000


@dataclass
class Pairs:
    """Complete (x, y) pairs by key, settled in the shared folder."""

    df: DataFrame
    keys: list[str]
    n_batches: int
    # a key has at most one row per batch, so this bounds every group
    bounded: bool


def _settle(df: DataFrame, keys: Sequence[str], n_batches: int) -> Pairs:
    clean = df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumns(
        {"x": F.round("x", VALUE_DIGITS), "y": F.round("y", VALUE_DIGITS)}
    )
    return Pairs(clean, list(keys), n_batches, n_batches <= WINDOW_ROWS)


def overall_pairs(table: DataFrame, parameters: Sequence[str] | None = None) -> Pairs:
    """Each parameter against the batch defect rate."""
    params = list(parameters or batch.parameter_columns(table))
    narrow = cut_lineage(table.select("batch_id", F.col("defect_rate").alias("y"), *params))
    return _settle(batch.unpivoted(narrow, ["batch_id", "y"], params), ["parameter"], row_count(narrow))


def family_pairs(
    table: DataFrame, parameters: Sequence[str] | None = None, rates: DataFrame | None = None
) -> Pairs:
    """Each parameter against the rate of each defect category.

    ``rates`` is the long table batch_id, category, rate of the pairs that occur; batches where a
    category does not occur have rate 0. So there is no column per category and no limit to
    their number. Without it the rate_ columns of ``table`` are taken.
    """
    params = list(parameters or batch.parameter_columns(table))
    if rates is None:
        columns = [c for c in table.columns if c.startswith("rate_")]
        names = {c: c.removeprefix("rate_") for c in columns}
        narrow = cut_lineage(table.select("batch_id", *params, *[F.col(f"`{c}`").alias(names[c]) for c in columns]))
        by_family = narrow.unpivot(["batch_id", *params], list(names.values()), "family", "y")
    else:
        narrow = cut_lineage(table.select("batch_id", *params))
        known = cut_lineage(rates.select(F.col("batch_id").cast("string").alias("batch_id"), F.col("category").alias("family"), F.col("rate").alias("y")))
        # every batch has a rate of every family, so the result is this grid
        grid = narrow.crossJoin(small_side(known.select("family").distinct()))
        by_family = grid.join(known, ["batch_id", "family"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
        by_family = by_family.select("batch_id", *params, "family", "y")
    long = batch.unpivoted(by_family, ["batch_id", "family", "y"], params)
    return _settle(long, ["family", "parameter"], row_count(narrow))


def with_ranks(p: Pairs, weight: str | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Add rx, ry (average ties) and ty, the number of rows that share y."""
    keys = list(keys or p.keys)
    w = F.col(weight) if weight else F.lit(1)
    if p.bounded:
        def ranked(value):
            peers = F.sum(w).over(Window.partitionBy(*keys, value))
            upto = F.sum(w).over(
                Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
            )
            return upto - (peers - 1) / F.lit(2.0), peers

        rx, _ = ranked("x")
        ry, ty = ranked("y")
        return p.df.withColumn("rx", rx).withColumns({"ry": ry, "ty": ty})
    out = p.df
    for value, rank, ties in (("x", "rx", "tx"), ("y", "ry", "ty")):
        ranks = mid_ranks(p.df, keys, value, weight, rank).withColumnRenamed("ties", ties)
        out = out.join(ranks, [*keys, value])
    return out.drop("tx")



def factor_statistics(p: Pairs) -> DataFrame:
    """One row per key with every statistic of the pair, from one pass over the ranks.

    n, rho, t, high/low means of y about the median of x, delta, U, group sizes,
    tie term, mean and population std of x, 2-sigma limits, outlier figures.
    Keys with fewer than 3 pairs or a constant x are left out.
    """
    ranked = with_ranks(p)
    if p.bounded:  # the exact aggregate keeps the values of a group in memory
        middle = p.df.groupBy(*p.keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("x", 0.5).alias("median"))
    else:
        middle = percentiles(p.df, p.keys, "x", {"median": 0.5})
    spread = p.df.groupBy(*p.keys).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    per_key = middle.join(spread, p.keys).where((F.col("n") >= 3) & (F.col("std") > 0)).drop("n")
    rows = ranked.join(F.broadcast(per_key), p.keys)  # one row per parameter (and family)
    high = F.col("x") > F.col("median")
    outside = F.abs(F.col("x") - F.col("mean")) > 2.0 * F.col("std")
    agg = rows.groupBy(*p.keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("rx", "ry").alias("_cov"),  # corr itself fails on a constant side under ANSI
        (F.stddev_pop("rx") * F.stddev_pop("ry")).alias("_spread"),
        F.count(F.when(high, 1)).alias("n_high"),
        F.count(F.when(~high, 1)).alias("n_low"),
        F.avg(F.when(high, F.col("y"))).alias("_yh"),
        F.avg(F.when(~high, F.col("y"))).alias("_yl"),
        F.avg("y").alias("_y"),
        F.sum(F.when(high, F.col("ry"))).alias("_rh"),
        F.sum(F.col("ty").cast("double") * F.col("ty") - 1.0).alias("tie_term"),
        F.max("median").alias("median"),
        F.max("mean").alias("mean"),
        F.max("std").alias("std"),
        F.count(F.when(outside, 1)).alias("affected_batches_count"),
        F.coalesce(F.avg(F.when(outside, F.col("y"))), F.lit(0.0)).alias("affected_defect_rate"),
    )
    rho = F.when(F.col("_spread") > 0, clamp(F.col("_cov") / F.col("_spread"), -1.0, 1.0)).otherwise(F.lit(0.0))
    # perfect agreement must come out as exactly one, however the sums were added up
    near_one = F.abs(rho) > 1.0 - 1e-12
    out = agg.withColumn("rho", F.when(near_one, F.signum(rho)).otherwise(rho))
    dof = F.col("n") - 2
    gap = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("rho") * F.col("rho"))
    t = F.when(gap > 0, F.col("rho") * F.sqrt(dof / gap)).otherwise(
        F.when(F.col("rho") == 0, 0.0).otherwise(F.lit(float("inf")))
    )
    high_mean, low_mean = F.coalesce("_yh", "_y"), F.coalesce("_yl", "_y")
    u = F.col("_rh") - F.col("n_high") * (F.col("n_high") + 1) / 2.0
    return out.select(
        *p.keys,
        "n",
        "rho",
        t.alias("t"),
        "median",
        "n_high",
        "n_low",
        high_mean.alias("high_mean"),
        low_mean.alias("low_mean"),
        (high_mean - low_mean).alias("delta"),
        F.coalesce(u, F.lit(0.0)).alias("u"),
        "tie_term",
        "mean",
        "std",
        (F.col("mean") + 2.0 * F.col("std")).alias("upper"),
        (F.col("mean") - 2.0 * F.col("std")).alias("lower"),
        "affected_batches_count",
        "affected_defect_rate",
    )


def affected_batches(p: Pairs) -> DataFrame:
    """keys, batch_id, x, y, limits of every batch outside the 2-sigma limits of a parameter.

    Rows instead of a list per parameter: their number grows with the batches.
    """
    limits = factor_statistics(p).select(*p.keys, "lower", "upper")  # one row per key
    out = p.df.join(small_side(limits), p.keys)
    return out.where((F.col("x") > F.col("upper")) | (F.col("x") < F.col("lower"))).select(
        *p.keys, "batch_id", "x", "y", "lower", "upper"
    )


def category_correlations(p: Pairs) -> DataFrame:
    """parameter, family, rho (3 digits) for the families whose rate varies; pairs by family."""
    varying = p.df.groupBy("family").agg((F.stddev_pop("y") > 0).alias("_v")).where("_v").drop("_v")
    stats = factor_statistics(p).join(varying, "family", "left_semi")
    return stats.select("parameter", "family", rounded(F.col("rho"), 3).alias("rho"))


def effect_score(rho: Column, delta: Column) -> Column:
    return F.lit(0.7) * F.abs(rho) + F.lit(0.3) * F.least(F.lit(1.0), F.abs(delta) * 3.0)


def benjamini_hochberg(df: DataFrame, p: str, family: Sequence[str], tie: Sequence[str], q: str = "q") -> DataFrame:
    """Adjusted p-values within each family (its tests are columns, so few)."""
    whole = Window.partitionBy(*family)
    by_p = whole.orderBy(p, *tie)
    stepped = df.withColumns({"_rank": F.row_number().over(by_p), "_m": F.count(F.lit(1)).over(whole)})
    raw = F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_rank"))
    down = whole.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.withColumn("_raw", raw).withColumn(q, F.min("_raw").over(down)).drop("_rank", "_m", "_raw")


def bootstrap_rho(p: Pairs, n_boot: int = 1000, ci: float = 0.95, seed: int = 42, rho: DataFrame | None = None) -> DataFrame:
    """keys, ci_low, ci_high of Spearman's rho over resampled batches.

    The pairs of a key are numbered by batch id; draw j of repetition b takes
    pair md5(seed|b|j) mod n. Draws of the same pair become a weight, and ranks
    are taken again in every repetition with those weights. Fewer than three
    pairs give (-1, 1); if every repetition is constant, rho itself (from ``rho``, if
    the caller has it).
    """
    coded = cut_lineage(_coded(p.df, p.keys)) if p.bounded else None
    if coded is not None and row_count(coded) <= BROADCAST_ROWS:  # one row per key
        found, counts = _resampled(coded, p.keys, n_boot, ci, seed), coded.select(*p.keys, "n")
    else:
        base = cut_lineage(numbered(p.df, p.keys, ["batch_id"]))
        found = _resampled_by_joins(p, base, n_boot, ci, seed)
        counts = base.groupBy(*p.keys).agg(F.count(F.lit(1)).alias("n"))
    points = factor_statistics(p).select(*p.keys, "rho") if rho is None else rho
    out = counts.join(found, p.keys, "left").join(points, p.keys, "left")
    few = F.col("n") < 3
    return out.select(
        *p.keys,
        "n",
        F.when(few, -1.0).otherwise(rounded(clamp(F.coalesce("lo", "rho"), -1.0, 1.0), 3)).alias("ci_low"),
        F.when(few, 1.0).otherwise(rounded(clamp(F.coalesce("hi", "rho"), -1.0, 1.0), 3)).alias("ci_high"),
    )


def _coded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, cx, cy: one row per key with the numbers of its values of x and of y in order
    of the batches, 8 bytes a pair. A key has at most ``WINDOW_ROWS`` pairs."""
    import numpy as np
    import pandas as pd

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_index")
        codes = [np.unique(pdf[c].to_numpy(), return_inverse=True)[1].astype("int32").tobytes() for c in ("x", "y")]
        return pd.DataFrame([(*pdf[keys].iloc[0], len(pdf), *codes)], columns=[*keys, "n", "cx", "cy"])

    placed = df.withColumn("row_index", F.row_number().over(Window.partitionBy(*keys).orderBy("batch_id")))
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return placed.select(*keys, "row_index", "x", "y").groupBy(*keys).applyInPandas(
        code, f"{schema}, n long, cx binary, cy binary"
    )


def _resampled(coded: DataFrame, keys: Sequence[str], n_boot: int, ci: float, seed: int) -> DataFrame:
    """keys, lo, hi from the rows of :func:`_coded`.

    Keys are cut into chunks of ``TASK_PAIRS`` pairs, and every chunk meets every block of
    repetitions in a task of its own. In a repetition the draws of a pair are its weight, and a
    running sum of weights over the value numbers gives the ranks. The draws do not depend on the
    key, so a task hashes each once.
    """
    width = len(keys)
    before = F.sum("n").over(Window.orderBy("n", *keys)) - F.col("n")  # one row per key, without its pairs
    chunk = coded.where(F.col("n") >= 3).select(*keys, "n", F.floor(before / TASK_PAIRS).cast("int").alias("_chunk"))
    chunk = cut_lineage(chunk)
    chunks = (chunk.agg(F.max("_chunk")).first()[0] or 0) + 1
    spark = coded.sparkSession
    blocks = max(1, min(n_boot, -(-4 * spark.sparkContext.defaultParallelism // chunks)))

    def repeat(batches):
        import hashlib

        import numpy as np
        import pandas as pd

        def ranks(codes, w):
            mass = np.bincount(codes, weights=w)
            return (np.cumsum(mass) - (mass - 1.0) / 2.0)[codes]

        held = {}
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                *key, n, cx, cy, block = row
                held.setdefault(block, []).append((key, n, np.frombuffer(cx, "int32"), np.frombuffer(cy, "int32")))
        md5 = hashlib.md5
        for block, rows in held.items():
            places = [str(i).encode() for i in range(max(r[1] for r in rows))]
            for rep in range(block, n_boot, blocks):
                start = f"{seed}|{rep}|".encode()
                drawn = np.frombuffer(b"".join([md5(start + i).digest()[:4] for i in places]), ">u4").astype(np.int64)
                out, weights = [], {}
                for key, n, cx, cy in rows:
                    if n not in weights:
                        weights = {n: np.bincount(drawn[:n] % n, minlength=n).astype(float)}  # keys come by size
                    w = weights[n]
                    rx, ry = ranks(cx, w), ranks(cy, w)
                    middle = (n + 1) / 2.0
                    dx, dy = rx - middle, ry - middle
                    vx, vy = (w * dx * dx).sum(), (w * dy * dy).sum()
                    if vx > 0 and vy > 0:
                        out.append((*key, float((w * dx * dy).sum() / np.sqrt(vx) / np.sqrt(vy))))
                yield pd.DataFrame(out, columns=[f"k{i}" for i in range(width)] + ["r"])

    schema = ", ".join(f"k{i} {coded.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)) + ", r double"
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tasks = coded.join(F.broadcast(chunk), [*keys, "n"]).withColumn("_block", every)
    tasks = tasks.repartitionById(chunks * blocks, (F.col("_chunk") * blocks + F.col("_block")).cast("int"))
    rhos = tasks.sortWithinPartitions("_block", "n").select(*keys, "n", "cx", "cy", "_block").mapInPandas(repeat, schema)
    return _range_of(rhos.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)}), keys, ci)


def _range_of(rhos: DataFrame, keys: Sequence[str], ci: float) -> DataFrame:
    tail = (1.0 - ci) / 2.0
    # one value per repetition, so the exact aggregate holds n_boot values at most
    return rhos.groupBy(*keys).agg(F.percentile("r", tail).alias("lo"), F.percentile("r", 1.0 - tail).alias("hi"))


def _resampled_by_joins(p: Pairs, base: DataFrame, n_boot: int, ci: float, seed: int) -> DataFrame:
    """The same for any number of pairs: draws are counted per pair and looked up by a join,
    ranks are taken again in every repetition."""
    picks = (
        base.where(F.col("total_rows") >= 3)
        .select(*p.keys, "total_rows", "row_index", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
        .select(*p.keys, "rep", draws.index(F.col("total_rows"), seed, F.col("rep"), F.col("row_index")).alias("pick"))
        .groupBy(*p.keys, "rep", "pick")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    looked_up = picks.join(
        small_side(base.select(*p.keys, F.col("row_index").cast("long").alias("pick"), "x", "y")), [*p.keys, "pick"]
    )
    ranked = with_ranks(Pairs(looked_up, p.keys, p.n_batches, p.bounded), "w", [*p.keys, "rep"])
    w = F.col("w")
    sums = ranked.groupBy(*p.keys, "rep").agg(
        F.sum(w).alias("n"),
        F.sum(w * F.col("rx")).alias("a"),
        F.sum(w * F.col("ry")).alias("b"),
        F.sum(w * F.col("rx") * F.col("rx")).alias("aa"),
        F.sum(w * F.col("ry") * F.col("ry")).alias("bb"),
        F.sum(w * F.col("rx") * F.col("ry")).alias("ab"),
    )
    n = F.col("n")
    vx, vy = n * F.col("aa") - F.col("a") * F.col("a"), n * F.col("bb") - F.col("b") * F.col("b")
    rhos = sums.where((vx > 0) & (vy > 0)).select(
        *p.keys, ((n * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(vx) / F.sqrt(vy)).alias("r")
    )
    return _range_of(rhos, p.keys, ci)


def with_p_values(stats: DataFrame) -> DataFrame:
    """p_spearman and p_mwu, from small Arrow UDFs over one row per key."""
    return stats.withColumns(
        {
            "p_spearman": t_two_sided(F.col("t"), F.col("n") - 2),
            "p_mwu": u_two_sided(F.col("u"), F.col("n_high"), F.col("n_low"), F.col("tie_term")),
        }
    )


def evidence_label(rho: Column, p: Column, delta: Column, p_mwu: Column) -> Column:
    r, d = F.abs(rho), F.abs(delta)
    strong = ((r >= 0.60) & (p < 0.05)) | ((d >= 0.08) & (p_mwu < 0.10))
    moderate = ((r >= 0.35) & (p < 0.15)) | (d >= 0.04)
    return F.when(strong, "Strong").when(moderate, "Moderate").otherwise("Weak")


def sample_warning(n: Column) -> Column:
    """Caveat text for few batches, null for enough."""
    tail5 = " batches). Correlation tests are severely underpowered."
    tail10 = " batches). Statistical associations are preliminary."
    text = n.cast("string")
    return (
        F.when(n < 5, F.concat(F.lit("⚠️ Very small sample size (N = "), text, F.lit(tail5)))
        .when(n < 10, F.concat(F.lit("⚠️ Small sample size (N = "), text, F.lit(tail10)))
        .otherwise(F.lit(None).cast("string"))
    )


def ranked_factors(p: Pairs) -> DataFrame:
    """Statistics, p-values, adjusted p-values, labels and rank; one row per parameter,
    none below three batches."""
    stats = with_p_values(factor_statistics(p)).withColumn("sample_size", F.lit(p.n_batches))
    adjusted = benjamini_hochberg(
        cut_lineage(stats.where(F.col("sample_size") >= 3)), "p_spearman", [], ["parameter"]
    )
    raw = evidence_label(F.col("rho"), F.col("p_spearman"), F.col("delta"), F.col("p_mwu"))
    significant = F.col("q") < fv.SIGNIFICANCE
    labelled = adjusted.withColumns(
        {
            "raw_evidence_label": raw,
            "is_significant": significant,
            "evidence_label": F.when(significant, raw).otherwise("not significant"),
            "effect_score": effect_score(F.col("rho"), F.col("delta")),
        }
    )
    by_effect = Window.orderBy(F.desc(F.round("effect_score", 9)), "parameter")  # one row per parameter
    return labelled.withColumn("rank", F.row_number().over(by_effect))


def analyze_factors(table: DataFrame, parameters: Sequence[str] | None = None, n_boot: int = 1000) -> DataFrame:
    """The ranked factor report with bootstrap ranges, one row per parameter."""
    p = overall_pairs(table, parameters)
    out = ranked_factors(p).join(bootstrap_rho(p, n_boot).drop("n"), "parameter")
    return out.select(
        "rank",
        "parameter",
        "sample_size",
        rounded(F.col("rho"), 3).alias("spearman_rho"),
        rounded(F.col("p_spearman"), 4).alias("spearman_p_value"),
        rounded(F.col("q"), 4).alias("spearman_p_adjusted"),
        "is_significant",
        "ci_low",
        "ci_high",
        rounded(F.col("high_mean") * 100.0, 2).alias("high_defect_mean"),
        rounded(F.col("low_mean") * 100.0, 2).alias("low_defect_mean"),
        rounded(F.col("delta") * 100.0, 2).alias("defect_rate_delta_pts"),
        rounded(F.col("p_mwu"), 4).alias("mwu_p_value"),
        "evidence_label",
        "raw_evidence_label",
        rounded(F.col("effect_score"), 4).alias("effect_score"),
        rounded(F.col("mean"), 2).alias("mean"),
        rounded(F.col("std"), 2).alias("std"),
        rounded(F.col("upper"), 2).alias("upper_limit_2sigma"),
        rounded(F.col("lower"), 2).alias("lower_limit_2sigma"),
        "affected_batches_count",
        rounded(F.col("affected_defect_rate") * 100.0, 2).alias("affected_defect_rate"),
        sample_warning(F.col("sample_size")).alias("sample_warning"),
        F.lit(fv.FACTOR_DISCLAIMER).alias("disclaimer"),
    )


def family_label(rho: Column, p: Column, significant: Column) -> Column:
    r = F.abs(rho)
    return (
        F.when(significant & (r >= 0.60), "Strong")
        .when(significant & (r >= 0.35), "Moderate")
        .when((r >= 0.35) & (p < 0.15), "Moderate (Uncorrected only)")
        .otherwise("Weak / not significant")
    )


def analyze_families(
    table: DataFrame, parameters: Sequence[str] | None = None, n_boot: int = 1000, rates: DataFrame | None = None
) -> DataFrame:
    """Every family against every parameter; ``position`` 1 is the family's top factor."""
    p = family_pairs(table, parameters, rates)
    varying = Window.partitionBy("family")
    stats = factor_statistics(p).withColumn("p_spearman", t_two_sided(F.col("t"), F.col("n") - 2))
    adjusted = benjamini_hochberg(cut_lineage(stats), "p_spearman", ["family"], ["parameter"])
    ci = bootstrap_rho(p, n_boot).drop("n")
    constant = p.df.groupBy("family").agg((F.stddev_pop("y") > 0).alias("_v")).where("_v").drop("_v")
    out = adjusted.join(ci, p.keys).join(constant, "family", "left_semi")
    significant = F.col("q") < fv.SIGNIFICANCE
    position = F.row_number().over(varying.orderBy(F.desc(F.round(F.abs("rho"), 9)), "parameter"))
    return out.select(
        "family",
        "parameter",
        position.alias("position"),
        rounded(F.col("rho"), 3).alias("rho"),
        rounded(F.col("p_spearman"), 4).alias("raw_p"),
        rounded(F.col("q"), 4).alias("adj_p"),
        "ci_low",
        "ci_high",
        significant.alias("is_significant"),
        F.when(significant, "Significant").otherwise("not significant").alias("significance_status"),
        family_label(F.col("rho"), F.col("p_spearman"), significant).alias("evidence_label"),
    )


def top_factor_per_family(stats: DataFrame) -> DataFrame:
    """The parameter with the largest |rho| in each family."""
    best = F.min_by(F.struct("parameter", "rho"), F.struct(-F.round(F.abs("rho"), 9), F.col("parameter")))
    return stats.groupBy("family").agg(best.alias("b")).select(
        "family", F.col("b.parameter").alias("parameter"), F.col("b.rho").alias("rho")
    )


def correlation_matrix(stats: DataFrame, families: Sequence[str]) -> DataFrame:
    """parameter by family, rho rounded to 3 digits."""
    return stats.groupBy("parameter").pivot("family", list(families)).agg(F.first(rounded(F.col("rho"), 3)))

"""Drift of a distribution from one period to the next: greatest gap between two empirical
distributions, and the stability index against a stored profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantgauge.functions.tails import kolmogorov_upper
from plantgauge.operators.bounds import small_side
from plantgauge.operators.prefix import percentiles, running

# bins of a profile, the least share that a bin is given, and the digits values are compared at
BINS = 10
LEAST_SHARE = 1e-4
VALUE_DIGITS = 9


def period_values(process: DataFrame, parameters: Sequence[str], unit: str = "week", time: str = "timestamp") -> DataFrame:
    """parameter, period (start of the calendar unit), x; rows without time or value are left out."""
    start = F.date_trunc(unit, F.col(time))
    long = process.select(start.alias("period"), *[F.col(c).cast("double").alias(c) for c in parameters]).unpivot(
        ["period"], list(parameters), "parameter", "x"
    )
    return long.where(F.col("period").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x")).withColumn(
        "x", F.round("x", VALUE_DIGITS)
    )


def distribution_gap(hist: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov statistic of every key.

    ``hist`` has one row per (keys, value) with the counts ``n_a`` and ``n_b`` of the two
    samples; a value that holds a third of a sample is one row here, and the running sums are
    taken slice by slice. Keys with an empty sample are left out.
    Columns: keys, n_a, n_b, gap, widest_at (smallest value where the gap is greatest).
    """
    walked = running(hist, keys, [value], {"a": "n_a", "b": "n_b"}).where((F.col("total_a") > 0) & (F.col("total_b") > 0))
    share_a = (F.col("before_a") + F.col("n_a")) / F.col("total_a")
    share_b = (F.col("before_b") + F.col("n_b")) / F.col("total_b")
    gap = F.abs(share_a - share_b)
    widest = F.max(F.struct(F.round(gap, 12).alias("g"), (-F.col(value)).alias("v"), gap.alias("gap")))
    found = walked.groupBy(*keys).agg(F.max("total_a").alias("n_a"), F.max("total_b").alias("n_b"), widest.alias("w"))
    return found.select(*keys, "n_a", "n_b", F.col("w.gap").alias("gap"), (-F.col("w.v")).alias("widest_at"))


def ks_between_periods(values: DataFrame, keys: Sequence[str], period: str = "period", value: str = "x") -> DataFrame:
    """Each period of a key against the next one that has values.

    Values are counted once per (keys, period, value); only these counts enter two
    comparisons. A key with a single period, like an empty table, gives no row.
    Columns: keys, earlier, later, n_a, n_b, gap, widest_at, p.
    """
    hist = values.groupBy(*keys, period, value).agg(F.count(F.lit(1)).alias("n"))
    periods = hist.select(*keys, period).distinct()
    order = Window.partitionBy(*keys).orderBy(period)  # one row per period
    steps = periods.withColumn("later", F.lead(period).over(order)).where(F.col("later").isNotNull())
    steps = small_side(steps.withColumnRenamed(period, "earlier"))
    sides = []
    for side, mine, none in (("earlier", "n_a", "n_b"), ("later", "n_b", "n_a")):
        rows = hist.withColumnRenamed(period, side).join(steps, [*keys, side])
        sides.append(rows.select(*keys, "earlier", "later", value, F.col("n").alias(mine), F.lit(0).cast("long").alias(none)))
    both = sides[0].unionByName(sides[1]).groupBy(*keys, "earlier", "later", value).agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")
    )
    out = distribution_gap(both, [*keys, "earlier", "later"], value)
    return out.withColumn("p", kolmogorov_upper(F.col("gap"), F.col("n_a"), F.col("n_b")))


def bin_of(edges: Column, value: Column) -> Column:
    """0-based bin: the number of edges below the value, so a bin holds its upper edge."""
    return F.size(F.filter(edges, lambda e: e < value))


def distribution_profile(values: DataFrame, keys: Sequence[str], value: str = "x", bins: int = BINS) -> DataFrame:
    """keys, edges, shares, n: what a reference period looks like, one row per key.

    The inner edges are exact quantiles; equal ones are merged, so a value that holds much of
    the period is a bin of its own. The table is small and can be stored and used on later
    data without the period's rows.
    """
    names = {f"e{i}": i / bins for i in range(1, bins)}
    edges = F.array_sort(F.array_distinct(F.array(*[F.round(n, VALUE_DIGITS) for n in names])))
    table = small_side(percentiles(values, keys, value, names).select(*keys, edges.alias("edges"), "n"))
    counted = (
        values.where(F.col(value).isNotNull()).join(table, list(keys))
        .groupBy(*keys, "edges", "n", bin_of(F.col("edges"), F.col(value)).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    by_bin = F.map_from_entries(F.collect_list(F.struct("_bin", "_k")))  # one entry per bin
    shares = F.transform(
        F.sequence(F.lit(0), F.size("edges")), lambda b: F.coalesce(F.try_element_at("_held", b), F.lit(0)) / F.col("n")
    )
    return counted.groupBy(*keys, "edges", "n").agg(by_bin.alias("_held")).select(*keys, "edges", shares.alias("shares"), "n")


def stability_index(profile: DataFrame, values: DataFrame, keys: Sequence[str], groups: Sequence[str], value: str = "x") -> DataFrame:
    """The population stability index of every (keys, groups) against its key's profile.

    Sum over bins of (q - p) ln(q / p). A bin that is empty on either side counts with
    ``LEAST_SHARE``. Keys without a profile are left out; groups without values give no row.
    Columns: keys, groups, n, bins, empty_bins, psi.
    """
    known = small_side(profile.select(*keys, "edges", "shares"))
    counted = (
        values.where(F.col(value).isNotNull()).join(known, list(keys))
        .groupBy(*keys, *groups, "shares", bin_of(F.col("edges"), F.col(value)).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_k"))
        .groupBy(*keys, *groups, "shares")
        .agg(F.sum("_k").alias("n"), F.map_from_entries(F.collect_list(F.struct("_bin", "_k"))).alias("_held"))
    )
    least = F.lit(LEAST_SHARE)

    def part(p, b):
        p = F.greatest(p, least)
        q = F.greatest(F.coalesce(F.try_element_at("_held", b), F.lit(0)) / F.col("n"), least)
        return (q - p) * F.ln(q / p)

    parts = F.transform("shares", part)
    return counted.select(
        *keys, *groups, "n", F.size("shares").alias("bins"), (F.size("shares") - F.size("_held")).alias("empty_bins"),
        F.aggregate(parts, F.lit(0.0), lambda a, b: a + b).alias("psi"),
    )

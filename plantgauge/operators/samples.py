"""Do groups differ: chi-square of contingency tables, Kruskal-Wallis, one-way ANOVA.

Rows are counted or summed per group first; what is joined and ordered afterwards has one row
per cell, distinct value or group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plantgauge.functions.tails import chi2_upper, f_upper
from plantgauge.operators.bounds import small_side
from plantgauge.operators.prefix import mid_ranks


def contingency_cells(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, a, b, n, row_n, column_n, total, expected, residual (Pearson) of every cell that occurs.

    Rows where a or b is null are left out. Totals are added up from the cells.
    """
    keys = list(keys)
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(*keys, a).agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy(*keys, b).agg(F.sum("n").alias("column_n"))
    out = cells.join(rows, [*keys, a]).join(columns, [*keys, b])
    if keys:
        out = out.join(rows.groupBy(*keys).agg(F.sum("row_n").alias("total")), keys)
    else:
        out = out.withColumn("total", rows.agg(F.sum("row_n")).scalar())
    expected = F.col("row_n") * (F.col("column_n") / F.col("total"))
    return out.withColumn("expected", expected).withColumn(
        "residual", (F.col("n") - F.col("expected")) / F.sqrt("expected")
    )


def chi_square(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """The test of independence of a and b per key: keys, n, rows, columns, statistic, dof,
    cramers_v, p.

    Cells that do not occur add their expected counts, which is what the others leave of the
    total: nothing is made dense. A table of one row or column has statistic, dof and V of 0
    and p of 1; an empty one gives no row.
    """
    keys = list(keys)
    cells = contingency_cells(df, a, b, keys)
    found = cells.groupBy(*keys).agg(
        F.max("total").alias("n"),
        F.count_distinct(a).alias("rows"),
        F.count_distinct(b).alias("columns"),
        F.sum(F.col("residual") * F.col("residual")).alias("_met"),
        F.sum("expected").alias("_expected"),
    )
    found = found.where(F.col("n").isNotNull())
    dof = (F.col("rows") - 1) * (F.col("columns") - 1)
    side = F.least("rows", "columns") - 1
    raw = F.col("_met") + F.greatest(F.lit(0.0), F.col("n") - F.col("_expected"))
    out = found.withColumns({"dof": dof, "statistic": F.when(dof > 0, raw).otherwise(0.0)})
    v = F.when(side > 0, F.sqrt(F.col("statistic") / (F.col("n") * side))).otherwise(0.0)
    return out.select(
        *keys, "n", "rows", "columns", "statistic", "dof", v.alias("cramers_v"),
        chi2_upper(F.col("statistic"), F.col("dof")).alias("p"),
    )


def kruskal_wallis(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Rank sums of the groups of every key: keys, n, groups, h (corrected for ties), dof, p.

    Ranks are taken on the distinct values of a key, slice by slice; a value that holds a third
    of the rows is one row. Null groups, null and NaN values are left out. A single group, or
    values that are all equal, give h = 0 and p = 1.
    """
    keys = list(keys)
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    hist = rows.groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("_k"))
    ranks = mid_ranks(hist, keys, value, weight="_k")
    per_key = ranks.groupBy(*keys).agg(
        F.sum("ties").alias("n"),
        F.sum(F.col("ties").cast("double") * F.col("ties") * F.col("ties") - F.col("ties")).alias("_ties"),
    )
    k = F.col("_k")
    sums = hist.join(ranks.drop("ties"), [*keys, value]).groupBy(*keys, group).agg(
        F.sum(k).alias("_n"), F.sum(k * F.col("rank")).alias("_r")
    )
    off = F.col("_r") / F.col("_n") - (F.col("n") + 1) / 2.0  # mean rank about the middle
    spread = sums.join(small_side(per_key), keys).groupBy(*keys, "n", "_ties").agg(
        F.count(F.lit(1)).alias("groups"), F.sum(F.col("_n") * off * off).alias("_between")
    )
    n = F.col("n").cast("double")
    room = 1.0 - F.col("_ties") / (n * n * n - n)
    h = F.when((n > 1) & (F.col("groups") > 1) & (room > 0), 12.0 / (n * (n + 1.0)) * F.col("_between") / room).otherwise(0.0)
    out = spread.select(*keys, "n", "groups", h.alias("h"), (F.col("groups") - 1).alias("dof"))
    return out.withColumn("p", chi2_upper(F.col("h"), F.col("dof")))


def anova(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """One-way analysis of variance per key: keys, n, groups, between, within (sums of squares),
    dof_between, dof_within, f, eta_squared, p.

    Sums are taken about the key's mean, so large values with a small spread lose no digits.
    Null groups, null and NaN values are left out. A single group or as many groups as rows
    have no f and p = 1; equal values within all of several groups have an infinite f if
    the groups differ, else 0.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    rows = df.where(F.col(group).isNotNull() & x.isNotNull() & ~F.isnan(x)).select(*keys, group, x.alias("_x"))
    centre = small_side(rows.groupBy(*keys).agg(F.avg("_x").alias("_c")))
    off = F.col("_x") - F.col("_c")
    sums = rows.join(centre, keys).groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(off).alias("_s"), F.sum(off * off).alias("_q")
    )
    found = sums.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"),
        F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_b"),
    )
    total = F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")
    between = F.greatest(F.lit(0.0), F.col("_b") - F.col("_s") * F.col("_s") / F.col("n"))
    within = F.greatest(F.lit(0.0), F.col("_q") - F.col("_b"))
    out = found.withColumns(
        {
            "between": between, "within": within, "_total": total,
            "dof_between": F.col("groups") - 1, "dof_within": F.col("n") - F.col("groups"),
        }
    )
    some = (F.col("dof_between") > 0) & (F.col("dof_within") > 0)
    f = F.when(some & (F.col("within") > 0), (F.col("between") / F.col("dof_between")) / (F.col("within") / F.col("dof_within")))
    f = f.when(some & (F.col("between") > 0), float("inf")).when(some, 0.0)
    eta = F.when(F.col("_total") > 0, F.col("between") / F.col("_total")).otherwise(0.0)
    out = out.select(*keys, "n", "groups", "between", "within", "dof_between", "dof_within", f.alias("f"), eta.alias("eta_squared"))
    return out.withColumn("p", f_upper(F.col("f"), F.col("dof_between"), F.col("dof_within")))

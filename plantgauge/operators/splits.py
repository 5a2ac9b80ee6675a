"""Reproducible splits, slices and samples, drawn by hash instead of by a generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantgauge import fixed_values as fv
from plantgauge.functions import draws
from plantgauge.operators.prefix import numbered, running


def by_hash(df: DataFrame, id_col: str, keys: Sequence[str], seed: int) -> DataFrame:
    """0-based position in hash order within each key (``row_index``) and ``total_rows``.

    The leading digits of the hash are the slices: they are even by nature, so a
    class that holds a third of the rows spreads like any other.
    """
    hashed = df.withColumn("_hash", draws.digest(F.col(id_col), seed))
    out = running(
        hashed, keys, ["_hash", id_col], {"rows": F.lit(1).cast("long")}, slice_by=F.substring("_hash", 1, 2)
    )
    return out.withColumnRenamed("before_rows", "row_index").drop("_hash")


def stratified_split(
    df: DataFrame, id_col: str, strata: str, seed: int = 42, train_pct: int = 60, val_pct: int = 20
) -> DataFrame:
    """Add ``split`` (train / val / test) with the given percents inside each stratum."""
    k, n = F.col("row_index") + 1, F.col("total_rows")
    split = (
        F.when(k * 100 <= n * train_pct, "train").when(k * 100 <= n * (train_pct + val_pct), "val").otherwise("test")
    )
    return by_hash(df, id_col, [strata], seed).withColumn("split", split).drop("row_index", "total_rows")


def group_folds(df: DataFrame, group: str, label: Column | None = None, folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, fold) of whole groups. Groups are ordered by their share of ``label``,
    then by hash, and dealt in turn to min(folds, groups) folds: every fold has
    a group, and shares of the label are spread over the folds."""
    share = F.round(F.avg(label.cast("double")), 9) if label is not None else F.lit(0.0)
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.coalesce(share, F.lit(0.0)).alias("_share"))
    hashed = sizes.withColumn("_hash", draws.digest(F.col(group), seed))
    placed = numbered(hashed, [], ["_share", "_hash", group])
    return placed.select(group, F.pmod("row_index", F.least(F.lit(folds), F.col("total_rows"))).cast("int").alias("fold"))


def group_split(
    df: DataFrame, group: str, id_col: str, label: Column | None = None, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``split``: fold 0 of the groups is held out, so the test part is never
    empty. Fewer than three groups: single rows are drawn by hash instead. Rows
    without a group are training rows."""
    few = df.select(group).where(F.col(group).isNotNull()).distinct().limit(3).count() < 3
    if few:
        fold = draws.index(F.lit(folds), F.col(id_col).cast("string"), seed)
        return df.withColumn("split", F.when(fold == 0, "test").otherwise("train"))
    dealt = group_folds(df, group, label, folds, seed).withColumnRenamed("fold", "_fold")
    rows = df.join(dealt, group, "left").withColumn("split", F.when(F.col("_fold") == 0, "test").otherwise("train"))
    return rows.select(*df.columns, "split")


def overlap(df: DataFrame, key: str, a: str = "train", b: str = "test") -> DataFrame:
    """Keys that occur in both splits; an honest split has none."""
    left = df.where(F.col("split") == a).select(key).distinct()
    right = df.where(F.col("split") == b).select(key).distinct()
    return left.intersect(right)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int | Column) -> DataFrame:
    """The first n rows of each key; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_n", F.row_number().over(w))
    return ranked.where(F.col("_n") <= n).drop("_n")


def split_table(df: DataFrame, path: str, category: str = "category", normal: str = fv.NORMAL_CLASS) -> DataFrame:
    """position, path, label, category, split: the split table in the order of (category, path).

    ``position`` counts from 0 over the whole order, which is taken slice by slice; rows come
    sorted within their slices. Rows that repeat a path are told apart by their split.
    """
    rows = df.select(
        F.col(path).alias("path"), F.when(F.col(category) == normal, "good").otherwise("defective").alias("label"),
        F.col(category).alias("category"), "split",
    )
    placed = numbered(rows, [], ["category", "path", "split"], "position").drop("total_rows")
    return placed.select("position", "path", "label", "category", "split").sortWithinPartitions("position")


DEV_ROWS = {"train": 240, "val": 80, "test": 80}


def dev_slice(df: DataFrame, id_col: str, category: str = "category", rows: dict[str, int] | None = None) -> DataFrame:
    """The first rows of each class and split, for quick rebuilds."""
    limits = rows or DEV_ROWS
    parts = [
        first_n(df.where(F.col("split") == s), [category, "split"], [id_col], n) for s, n in limits.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest hashes.

    Hashes are even, so a cut slightly above n of N leaves about n rows in all;
    only these meet in the final sort, not n from every task. Should the cut
    leave too few, everything is sorted.
    """
    hashed = draws.number(F.col(id_col), seed)
    rows = df.agg(F.count(F.lit(1))).first()[0]
    share = (n + 8 * n**0.5 + 16) / max(1, rows)
    if share < 1.0:
        cut = df.where(hashed < F.lit(int(share * 4294967296)))
        if cut.agg(F.count(F.lit(1))).first()[0] >= n:
            df = cut
    return df.orderBy(draws.digest(F.col(id_col), seed), F.col(id_col)).limit(n)

"""Splits, slices and samples of the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge.catalog.base import CTES, query
from plantgauge.catalog.batches import DEF
from plantgauge.operators import splits
from plantgauge.operators.batch import defect_flag

CTES["split_features"] = """
SELECT vec_id, embedding, label, category,
       CASE WHEN k * 100 <= n * 60 THEN 'train' WHEN k * 100 <= n * 80 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(vec_id || '|42'), vec_id) AS k,
             count(*) OVER (PARTITION BY category) AS n FROM features)"""
CTES["batch_folds"] = f"""
SELECT i.unit_id, i.batch_id, fold FROM inspection i LEFT JOIN (
  SELECT batch_id, (row_number() OVER (ORDER BY share, md5(batch_id || '|42'), batch_id) - 1) % least(5, count(*) OVER ()) AS fold
  FROM (SELECT batch_id, round(avg({DEF}), 9) AS share FROM inspection WHERE batch_id IS NOT NULL GROUP BY batch_id)) f
ON i.batch_id = f.batch_id"""


def batches_split(t):
    return splits.group_split(t.inspection, "batch_id", "unit_id", defect_flag(t.inspection))


def split_features(t):
    return splits.stratified_split(t.features, "vec_id", "category")


@query(oracle="SELECT vec_id, category, split FROM split_features")
def stratified_split(t):
    return split_features(t).select("vec_id", "category", "split")


@query(
    oracle="""SELECT batch_id, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n
              FROM batch_folds GROUP BY ALL"""
)
def group_split(t):
    return batches_split(t).groupBy("batch_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    oracle="""SELECT row_number() OVER (ORDER BY category, path) - 1 AS position, path, label, category, split
              FROM (SELECT category || '/' || vec_id || '.png' AS path, CASE WHEN category = 'normal' THEN 'good' ELSE 'defective' END AS label,
                           category, split FROM split_features)"""
)
def split_table(t):
    """The split file: every part by category and path."""
    rows = split_features(t).withColumn("path", F.concat("category", F.lit("/"), F.col("vec_id").cast("string"), F.lit(".png")))
    return splits.split_table(rows, "path")


@query(
    oracle="""SELECT 'vectors' AS kind, count(*) AS shared FROM (
                SELECT vec_id FROM split_features WHERE split = 'train' INTERSECT
                SELECT vec_id FROM split_features WHERE split = 'test')
              UNION ALL SELECT 'batches', count(*) FROM (
                SELECT batch_id FROM batch_folds WHERE fold <> 0 INTERSECT SELECT batch_id FROM batch_folds WHERE fold = 0)
              UNION ALL SELECT 'classes without training rows', count(*) FROM (
                SELECT category FROM split_features EXCEPT SELECT category FROM split_features WHERE split = 'train')"""
)
def split_overlap(t):
    feats = split_features(t)
    batches = batches_split(t)
    trained = feats.where(F.col("split") == "train").select("category").distinct()
    untrained = feats.select("category").distinct().join(trained, "category", "left_anti")
    parts = [
        ("vectors", splits.overlap(feats, "vec_id")),
        ("batches", splits.overlap(batches, "batch_id")),
        ("classes without training rows", untrained),
    ]
    rows = [df.agg(F.count(F.lit(1)).alias("shared")).select(F.lit(n).alias("kind"), "shared") for n, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    oracle="""SELECT vec_id, category, split FROM (
                SELECT *, row_number() OVER (PARTITION BY category, split ORDER BY vec_id) AS k FROM split_features)
              WHERE k <= CASE WHEN split = 'train' THEN 240 ELSE 80 END"""
)
def dev_slice(t):
    return splits.dev_slice(split_features(t), "vec_id").select("vec_id", "category", "split")


@query(
    oracle="""SELECT vec_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY vec_id) AS k
                FROM split_features WHERE split = 'test') WHERE k <= 2"""
)
def gallery_top2(t):
    held_out = split_features(t).where(F.col("split") == "test")
    return splits.first_n(held_out, ["category"], ["vec_id"], 2).select("vec_id", "category")


@query(
    oracle="""SELECT vec_id, category FROM split_features WHERE split = 'test' ORDER BY md5(vec_id || '|42'), vec_id LIMIT 4"""
)
def random_sample(t):
    return splits.hash_sample(split_features(t).where(F.col("split") == "test"), "vec_id", 4).select("vec_id", "category")


@query(
    oracle="""SELECT category, split, count(*) AS n FROM split_features GROUP BY ALL"""
)
def split_counts(t):
    """Train, val and test filtered apart and put together again."""
    feats = split_features(t)
    parts = [feats.where(F.col("split") == s) for s in ("train", "val", "test")]
    return (
        parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("category", "split").agg(F.count(F.lit(1)).alias("n"))
    )

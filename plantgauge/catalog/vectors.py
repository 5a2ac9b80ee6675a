"""Novelty, anomaly, projection and perturbation of the embeddings; tabular features."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge import fixed_values as fv
from plantgauge.catalog.base import CTES, query, u
from plantgauge.catalog.evaluation import sql_wilson
from plantgauge.catalog.splits import split_features
from plantgauge.functions.columns import wilson
from plantgauge.operators import features, neighbors
from plantgauge.operators.bounds import column_values
from plantgauge.operators.prefix import percentiles

BANK = fv.BANK_ROWS  # the operator's own bank size

CTES["pair_distances"] = """
SELECT q.vec_id AS id, q.split, q.category, b.category AS class, b.vec_id AS other,
       1.0 - list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
FROM split_features q, split_features b WHERE b.split = 'train' AND q.split <> 'train'"""
CTES["class_distances"] = """
SELECT id, split, category, class, avg(d) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY id, class ORDER BY d, other) AS k FROM pair_distances) WHERE k <= 5
GROUP BY ALL"""
CTES["novelty"] = """
SELECT id, split, category, min(distance) AS novelty_score, arg_min(class, round(distance, 9)) AS nearest_class
FROM class_distances GROUP BY ALL"""
CTES["novelty_limit"] = """
SELECT quantile_cont(novelty_score, 0.95) AS threshold, count(*) AS n, avg(novelty_score) AS mean, max(novelty_score) AS max
FROM novelty WHERE split = 'val'"""
CTES["held_novelty"] = """
SELECT h.held_out_class, id, split, category, min(distance) AS novelty_score
FROM class_distances d JOIN (SELECT DISTINCT category AS held_out_class FROM split_features WHERE category <> 'normal') h
  ON d.class <> h.held_out_class GROUP BY ALL"""
CTES["held_flags"] = """
SELECT h.held_out_class, category, CAST(novelty_score > threshold AS INTEGER) AS flag
FROM held_novelty h JOIN (SELECT held_out_class, quantile_cont(novelty_score, 0.95) AS threshold FROM held_novelty
                          WHERE split = 'val' AND category <> held_out_class GROUP BY held_out_class) l
  ON l.held_out_class = h.held_out_class WHERE split = 'test'"""
CTES["bank"] = f"""
SELECT vec_id, embedding FROM split_features WHERE split = 'train' AND category = 'normal'
ORDER BY md5(vec_id || '|42'), vec_id LIMIT {BANK}"""


def labelled(t):
    return split_features(t).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("category").alias("class"), "split")


def novelty(t):
    rows = labelled(t)
    bank = rows.where(F.col("split") == "train")
    asked = rows.where(F.col("split") != "train")
    scores = neighbors.novelty_scores(asked.select("id", "vec"), bank.select("id", "class", "vec"))
    return scores.join(asked.select("id", "split", F.col("class").alias("category")), "id")


@query(oracle="SELECT id, split, category, novelty_score, nearest_class FROM novelty", doubles="novelty_score")
def knn_novelty(t):
    return novelty(t)


@query(oracle="SELECT id, class, distance FROM class_distances", doubles="distance")
def knn_class_distances(t):
    rows = labelled(t)
    train = rows.where(F.col("split") == "train").select("id", "class", "vec")
    return neighbors.class_distances(rows.where(F.col("split") != "train").select("id", "vec"), train)


@query(oracle="SELECT id, class, distance FROM class_distances", doubles="distance")
def knn_class_distances_blocked(t):
    """The same through cells and blocks, as for a bank too large to send."""
    rows = labelled(t)
    train = rows.where(F.col("split") == "train").select("id", "class", "vec")
    asked = rows.where(F.col("split") != "train").select("id", "vec")
    return neighbors.class_distances(asked, train, force_blocks=True, block_rows=64)


@query(
    oracle="""SELECT q.vec_id AS id, q.category, min(list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS anomaly_score
              FROM split_features q, bank b WHERE q.split <> 'train' GROUP BY ALL""",
    doubles="anomaly_score",
)
def bank_anomaly(t):
    rows = labelled(t)
    normal = rows.where((F.col("split") == "train") & (F.col("class") == fv.NORMAL_CLASS)).select("id", "vec")
    asked = rows.where(F.col("split") != "train")
    scores = neighbors.bank_scores(asked.select("id", "vec"), neighbors.reference_bank(normal, BANK))
    worst = neighbors.unit_scores(scores, "id")
    return worst.join(asked.select("id", F.col("class").alias("category")), "id")


@query(oracle="SELECT * FROM novelty_limit", doubles="threshold mean max")
def threshold_p95(t):
    val = novelty(t).where(F.col("split") == "val")
    return neighbors.score_threshold(val, "novelty_score", fv.NOVELTY_PERCENTILE, fv.EMPTY_NOVELTY_THRESHOLD)


@query(
    oracle="""SELECT id, novelty_score, novelty_score > (SELECT threshold FROM novelty_limit) AS is_novel
              FROM novelty WHERE split = 'test'""",
    doubles="novelty_score",
)
def novelty_flags(t):
    scores = novelty(t)
    limit = neighbors.score_threshold(
        scores.where(F.col("split") == "val"), "novelty_score", fv.NOVELTY_PERCENTILE, fv.EMPTY_NOVELTY_THRESHOLD
    )
    flagged = neighbors.above_threshold(scores.where(F.col("split") == "test"), "novelty_score", limit, "is_novel")
    return flagged.select("id", "novelty_score", "is_novel")


W = sql_wilson("flagged", "n")


@query(
    oracle=f"""SELECT held_out_class, category, n, flagged, {W[0]} AS rate, {W[1]} AS low, {W[2]} AS high
               FROM (SELECT held_out_class, category, count(*) AS n, CAST(sum(flag) AS BIGINT) AS flagged FROM held_flags GROUP BY ALL)""",
    doubles="rate low high",
)
def false_novel_by_class(t):
    """Every defect class held out in turn: how often it is flagged, and the false flags of the others."""
    rows = labelled(t)
    asked = rows.where(F.col("split") != "train")
    bank = rows.where(F.col("split") == "train").select("id", "class", "vec")
    held = [c for c in column_values(rows, "class") if c != fv.NORMAL_CLASS]
    distances = neighbors.class_distances(asked.select("id", "vec"), bank)
    scores = neighbors.held_out_scores(distances, held).join(asked.select("id", "split", F.col("class").alias("category")), "id")
    known = scores.where((F.col("split") == "val") & (F.col("category") != F.col("held_out_class")))
    limits = percentiles(known, ["held_out_class"], "novelty_score", {"threshold": fv.NOVELTY_PERCENTILE})
    flagged = scores.where(F.col("split") == "test").join(F.broadcast(limits.drop("n")), "held_out_class")  # one row per class
    novel = F.col("novelty_score") > F.col("threshold")
    g = flagged.groupBy("held_out_class", "category").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(novel, 1)).alias("flagged"))
    w = wilson(F.col("flagged"), F.col("n"))
    return g.select("held_out_class", "category", "n", "flagged", *[w[k].alias(k) for k in ("rate", "low", "high")])


OUT = 16
CTES["projection"] = f"""
SELECT i, j, sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u("'42|' || i || '|' || j || '|a'")})) * cos(2.0::DOUBLE * pi() * {u("'42|' || i || '|' || j || '|b'")})
             / sqrt({OUT}::DOUBLE) AS w
FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range({OUT})) AS j)"""


@query(
    oracle="""SELECT vec_id, j, sum(x * w) AS value FROM (
                SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM features) f
              JOIN projection USING (i) GROUP BY vec_id, j""",
    doubles="value",
)
def random_projection(t):
    out = neighbors.random_projection(t.features.select("vec_id", "embedding"), "embedding", 64, OUT)
    return out.select("vec_id", F.posexplode("embedding").alias("j", "value")).withColumn("j", F.col("j").cast("long"))


def _sql_noise(tag: str, sigma: str) -> str:
    key = f"vec_id || '|' || (i - 1) || '|{tag}|"
    return (
        f"list_transform(v, lambda x, i: x + {sigma} * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u(key + chr(97) + chr(39))}))"
        f" * cos(2.0::DOUBLE * pi() * {u(key + chr(98) + chr(39))}))"
    )


def _sql_blur(radius: int) -> str:
    return f"list_transform(v, lambda x, i: list_avg(v[greatest(1, i - {radius}):least(len(v), i + {radius})]))"


CTES["perturbed"] = "\nUNION ALL ".join(
    f"SELECT vec_id, '{name}' AS condition, {expr} AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM features)"
    for name, expr in [
        ("baseline", "v"),
        ("bright_0.6", "list_transform(v, lambda x: x * 0.6::DOUBLE)"),
        ("bright_1.4", "list_transform(v, lambda x: x * 1.4::DOUBLE)"),
        ("contrast_0.6", "list_transform(v, lambda x: list_avg(v) + (x - list_avg(v)) * 0.6::DOUBLE)"),
        ("contrast_1.4", "list_transform(v, lambda x: list_avg(v) + (x - list_avg(v)) * 1.4::DOUBLE)"),
        ("rot_90", "list_concat(v[17:64], v[1:16])"),
        ("rot_180", "list_concat(v[33:64], v[1:32])"),
        ("hflip", "list_reverse(v)"),
        ("blur_1", _sql_blur(1)),
        ("blur_2", _sql_blur(2)),
        ("noise_10", _sql_noise("noise_10", "(10.0::DOUBLE / 255.0)")),
        ("noise_25", _sql_noise("noise_25", "(25.0::DOUBLE / 255.0)")),
    ]
)


@query(
    oracle="""SELECT vec_id, condition, list_sum(v) AS total, v[1] AS first, v[64] AS last,
                     list_sum(list_transform(v, lambda x, i: x * i)) AS moment FROM perturbed""",
    doubles="total first last moment",
)
def vector_perturb(t):
    from plantgauge.functions import vectors

    out = neighbors.perturbed(t.features.select("vec_id", "embedding"), "embedding", "vec_id")
    v = F.col("embedding")
    return out.select(
        "vec_id", "condition", vectors.total(v).alias("total"), v[0].alias("first"), F.element_at(v, -1).alias("last"),
        vectors.total(F.transform(v, lambda x, i: x * (i + 1))).alias("moment"),
    )


def _draw(tag: str) -> str:
    return u(f"vec_id || '|42|{tag}'")


CTES["aug_1"] = f"""
SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (0.6::DOUBLE + 0.8::DOUBLE * {_draw('bright')})) AS v,
       0.6::DOUBLE + 0.8::DOUBLE * {_draw('contrast')} AS f, CAST(floor({_draw('turn')} * 4) AS INTEGER) * 16 AS k
FROM split_features WHERE split = 'train'"""
CTES["aug_2"] = "SELECT vec_id, k, list_transform(v, lambda x: list_avg(v) + (x - list_avg(v)) * f) AS v FROM aug_1"
CTES["aug_3"] = """
SELECT vec_id, CASE WHEN k = 0 THEN v ELSE list_concat(v[k + 1:64], v[1:k]) END AS v FROM aug_2"""
CTES["aug_4"] = f"SELECT vec_id, CASE WHEN {_draw('flip')} > 0.5 THEN list_reverse(v) ELSE v END AS v FROM aug_3"
CTES["aug_5"] = f"SELECT vec_id, CASE WHEN {_draw('blur')} > 0.5 THEN {_sql_blur(1)} ELSE v END AS v FROM aug_4"
CTES["aug_6"] = f"""
SELECT vec_id, CASE WHEN {_draw('noisy')} > 0.5 THEN
  {_sql_noise('noise', f"((5.0::DOUBLE + 20.0::DOUBLE * {_draw('sigma')}) / 255.0)")} ELSE v END AS v FROM aug_5"""


@query(
    oracle="""SELECT vec_id, kind, list_sum(v) AS total, v[1] AS first,
                     list_sum(list_transform(v, lambda x, i: x * i)) AS moment
              FROM (SELECT vec_id, 'augmented' AS kind, v FROM aug_6
                    UNION ALL SELECT vec_id, 'original', embedding::DOUBLE[] FROM split_features WHERE split = 'train')""",
    doubles="total first moment",
)
def vector_augment(t):
    from plantgauge.functions import vectors

    train = split_features(t).where(F.col("split") == "train").select("vec_id", "embedding")
    copies = neighbors.augmented(train, "embedding", "vec_id").withColumn("kind", F.lit("augmented"))
    both = copies.unionByName(
        train.withColumns({"embedding": vectors.doubles(F.col("embedding")), "kind": F.lit("original")})
    )
    v = F.col("embedding")
    return both.select(
        "vec_id", "kind", vectors.total(v).alias("total"), v[0].alias("first"),
        vectors.total(F.transform(v, lambda x, i: x * (i + 1))).alias("moment"),
    )


CTES["joined_features"] = """
SELECT i.unit_id, i.variant, m.temperature, m.speed, m.pressure, m.vibration, roughness_ra, dimension_delta_mm, optical_score,
       TRY_CAST(regexp_extract(i.unit_id, '(\\d+)', 1) AS DOUBLE) AS seq
FROM inspection i LEFT JOIN telemetry_means m ON i.batch_id = m.batch_id"""
_NUM = fv.TELEMETRY + fv.MEASUREMENTS
CTES["tabular"] = (
    "SELECT unit_id, "
    + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM joined_features), 0.0::DOUBLE) AS {c}" for c in _NUM)
    + """, CAST(coalesce(lower(variant) LIKE '%alpha%', false) AS DOUBLE) AS variant_is_alpha,
       CAST(coalesce(lower(variant) LIKE '%beta%', false) AS DOUBLE) AS variant_is_beta,
       CAST(coalesce(lower(variant) LIKE '%gamma%', false) AS DOUBLE) AS variant_is_gamma,
       coalesce((seq - (SELECT min(seq) FROM joined_features)) /
         greatest(1.0::DOUBLE, (SELECT max(seq) - min(seq) FROM joined_features)), 0.0::DOUBLE) AS unit_seq_norm
FROM joined_features"""
)
_ALL = fv.TELEMETRY + ["variant_is_alpha", "variant_is_beta", "variant_is_gamma"] + fv.MEASUREMENTS + ["unit_seq_norm"]


@query(oracle="SELECT * FROM tabular", doubles=" ".join(_ALL))
def tabular_features(t):
    rows, names = features.tabular(t.inspection, t.process)
    return rows.select("unit_id", *names)


CTES["feature_scale"] = "SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) + 1e-5 AS s_{c}" for c in _ALL
) + " FROM tabular"


@query(
    oracle="SELECT unit_id, anomaly_z, anomaly_z > 2.8 AS is_novel FROM (SELECT unit_id, greatest("
    + ", ".join(f"abs(({c} - m_{c}) / s_{c})" for c in _ALL)
    + ") AS anomaly_z FROM tabular, feature_scale)",
    doubles="anomaly_z",
)
def zscore_novel(t):
    rows, names = features.tabular(t.inspection, t.process)
    scored = features.max_abs_z(rows, features.scale(rows, names))
    return scored.select("unit_id", "anomaly_z", (F.col("anomaly_z") > fv.NOVEL_Z).alias("is_novel"))

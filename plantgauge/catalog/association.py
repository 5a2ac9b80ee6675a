"""Factor ranking, false-discovery control and bootstrap ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge import fixed_values as fv
from plantgauge.catalog.base import CTES, pick, query, r
from plantgauge.catalog.batches import BRANDS, table
from plantgauge.operators import association, batch

N_BOOT = 1000

CTES["pairs"] = """
SELECT parameter, batch_id, round(x, 10) AS x, round(defect_rate, 10) AS y
FROM (UNPIVOT (SELECT batch_id, defect_rate, temperature, speed, pressure, vibration FROM batch_table)
      ON temperature, speed, pressure, vibration INTO NAME parameter VALUE x)"""
CTES["family_pairs"] = """
SELECT f.family, p.parameter, p.batch_id, x, round(coalesce(c.rate, 0.0::DOUBLE), 10) AS y
FROM pairs p CROSS JOIN (SELECT DISTINCT category AS family FROM category_rates) f
LEFT JOIN category_rates c ON c.batch_id = p.batch_id AND c.category = f.family"""


def _statistics(source: str, keys: str) -> str:
    k = ", ".join(keys.split())
    return f"""
SELECT {k}, n, rho, CASE WHEN rho = 0 THEN 0.0::DOUBLE ELSE rho * sqrt((n - 2) / (1.0 - rho * rho)) END AS t, median,
       n_high, n_low, high_mean, low_mean, high_mean - low_mean AS delta, rh - n_high * (n_high + 1) / 2.0::DOUBLE AS u,
       tie_term, mean, std
FROM (SELECT {k}, count(*) AS n, CASE WHEN stddev_pop(ry) > 0 THEN corr(rx, ry) ELSE 0.0::DOUBLE END AS rho,
             max(median) AS median, count(*) FILTER (WHERE x > median) AS n_high,
             count(*) FILTER (WHERE x <= median) AS n_low,
             coalesce(avg(y) FILTER (WHERE x > median), avg(y)) AS high_mean,
             coalesce(avg(y) FILTER (WHERE x <= median), avg(y)) AS low_mean,
             coalesce(sum(ry) FILTER (WHERE x > median), 0.0::DOUBLE) AS rh, sum(ty::DOUBLE * ty - 1.0) AS tie_term,
             avg(x) AS mean, stddev_pop(x) AS std
      FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY x) + (count(*) OVER (PARTITION BY {k}, x) - 1) / 2.0::DOUBLE AS rx,
                   rank() OVER (PARTITION BY {k} ORDER BY y) + (count(*) OVER (PARTITION BY {k}, y) - 1) / 2.0::DOUBLE AS ry,
                   count(*) OVER (PARTITION BY {k}, y) AS ty, median(x) OVER (PARTITION BY {k}) AS median
            FROM {source}) GROUP BY {k}) WHERE n >= 3 AND std > 0"""


CTES["factor_stats"] = _statistics("pairs", "parameter")
CTES["family_stats"] = _statistics("family_pairs", "family parameter")
CTES["rho_base"] = """
SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY batch_id) - 1 AS i, count(*) OVER (PARTITION BY parameter) AS n
FROM pairs"""
CTES["rho_draws"] = f"""
SELECT b.parameter, rep, b.x, b.y
FROM (SELECT parameter, rep, {pick("'42|' || rep || '|' || i", 'n')} AS i
      FROM rho_base, (SELECT unnest(range({N_BOOT})) AS rep)) d
JOIN rho_base b ON d.parameter = b.parameter AND d.i = b.i"""
CTES["rho_boot"] = """
SELECT parameter, rep, corr(rx, ry) AS rho
FROM (SELECT parameter, rep,
             rank() OVER (PARTITION BY parameter, rep ORDER BY x) + (count(*) OVER (PARTITION BY parameter, rep, x) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY parameter, rep ORDER BY y) + (count(*) OVER (PARTITION BY parameter, rep, y) - 1) / 2.0::DOUBLE AS ry
      FROM rho_draws) GROUP BY parameter, rep HAVING stddev_pop(rx) > 0 AND stddev_pop(ry) > 0"""
# a p-value needs a tail function; the adjustment itself is checked on this stand-in
CTES["pseudo_p"] = "SELECT family, parameter, 1.0 / (1.0 + t * t) AS p FROM family_stats"


def stats(t):
    return association.factor_statistics(association.overall_pairs(table(t), fv.TELEMETRY))


def family_pairs(t):
    return association.family_pairs(table(t), fv.TELEMETRY, batch.category_counts_by_batch(t.inspection))


def family_stats(t):
    return association.factor_statistics(family_pairs(t))


@query(oracle="SELECT parameter, n, rho FROM factor_stats", doubles="rho")
def spearman_factors(t):
    return stats(t).select("parameter", "n", "rho")


@query(oracle="SELECT parameter, n - 2 AS dof, t FROM factor_stats", doubles="t")
def spearman_t(t):
    return stats(t).select("parameter", (F.col("n") - 2).alias("dof"), "t")


@query(
    oracle=f"""SELECT b.parameter, any_value(s.n) AS n, {r('quantile_cont(b.rho, 0.025)', 3)} AS ci_low,
                      {r('quantile_cont(b.rho, 0.975)', 3)} AS ci_high
               FROM rho_boot b JOIN factor_stats s ON b.parameter = s.parameter GROUP BY b.parameter""",
    doubles="ci_low ci_high",
)
def bootstrap_rho_ci(t):
    return association.bootstrap_rho(association.overall_pairs(table(t), fv.TELEMETRY), N_BOOT)


@query(
    oracle=f"""SELECT count(*) AS n_batches, count(*) < {fv.SMALL_SAMPLE} AS small_sample,
                      CASE WHEN count(*) < 5 THEN 'very small' WHEN count(*) < 10 THEN 'small' ELSE 'enough' END AS caveat
               FROM batch_table"""
)
def sample_caveat(t):
    n = F.col("n_batches")
    return (
        table(t)
        .agg(F.count(F.lit(1)).alias("n_batches"))
        .select(
            "n_batches",
            (n < fv.SMALL_SAMPLE).alias("small_sample"),
            F.when(association.sample_warning(n).startswith("⚠️ Very"), "very small")
            .when(association.sample_warning(n).isNotNull(), "small")
            .otherwise("enough")
            .alias("caveat"),
        )
    )


@query(
    oracle="SELECT parameter, median, n_high, n_low, high_mean, low_mean, delta FROM factor_stats",
    doubles="median high_mean low_mean delta",
)
def median_split_delta(t):
    return stats(t).select("parameter", "median", "n_high", "n_low", "high_mean", "low_mean", "delta")


@query(oracle="SELECT parameter, n_high, n_low, u, tie_term FROM factor_stats", doubles="u tie_term")
def mann_whitney_u(t):
    return stats(t).select("parameter", "n_high", "n_low", "u", "tie_term")


@query(
    oracle="""SELECT family, parameter, p,
                     min(raw) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q
              FROM (SELECT *, least(1.0, p * m / k) AS raw
                    FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, parameter) AS k,
                                 count(*) OVER (PARTITION BY family) AS m FROM pseudo_p))""",
    doubles="p q",
)
def bh_adjust(t):
    p = family_stats(t).select("family", "parameter", (1.0 / (1.0 + F.col("t") * F.col("t"))).alias("p"))
    return association.benjamini_hochberg(p, "p", ["family"], ["parameter"])


@query(
    oracle="""SELECT parameter, 0.7 * abs(rho) + 0.3 * least(1.0, 3.0 * abs(delta)) AS effect_score,
                     row_number() OVER (ORDER BY round(0.7 * abs(rho) + 0.3 * least(1.0, 3.0 * abs(delta)), 9) DESC, parameter) AS rank
              FROM factor_stats""",
    doubles="effect_score",
)
def effect_rank(t):
    from pyspark.sql import Window

    scored = stats(t).select("parameter", association.effect_score(F.col("rho"), F.col("delta")).alias("effect_score"))
    order = Window.orderBy(F.desc(F.round("effect_score", 9)), "parameter")  # one row per parameter
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


@query(oracle="SELECT family, parameter, n, rho FROM family_stats", doubles="rho")
def family_matrix(t):
    return family_stats(t).select("family", "parameter", "n", "rho")


@query(
    oracle="""SELECT family, arg_min(parameter, k) AS parameter, arg_min(rho, k) AS rho
              FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(abs(rho), 9) DESC, parameter) AS k FROM family_stats)
              GROUP BY family""",
    doubles="rho",
)
def top_factor_per_family(t):
    return association.top_factor_per_family(family_stats(t))


@query(
    oracle=f"""SELECT parameter, {', '.join(f"max({r('rho', 3)}) FILTER (family = '{b}') AS \"{b}\"" for b in BRANDS)}
               FROM family_stats GROUP BY parameter"""
)
def family_matrix_wide(t):
    return association.correlation_matrix(family_stats(t), BRANDS)


# tail probabilities in SQL: Student's t with whole degrees of freedom is a finite series, the
# normal tail a series of positive terms
def t_p(t: str, dof: str) -> str:
    theta, c2 = f"atan(abs({t}) / sqrt({dof}))", f"(1.0 / (1.0 + {t} * {t} / {dof}))"
    even = f"list_sum(list_transform(range(0, ({dof}) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) - lgamma(0.5) + k * ln({c2}))))"
    odd = f"coalesce(list_sum(list_transform(range(0, ({dof} - 1) // 2), lambda k: exp(lgamma(0.5) - ln(2.0) + lgamma(k + 1.0) - lgamma(k + 1.5) + k * ln({c2})))), 0.0)"
    return f"""least(1.0, greatest(0.0, CASE WHEN {dof} <= 0 THEN 1.0 WHEN ({dof}) % 2 = 0 THEN 1.0 - sin({theta}) * {even}
        ELSE 1.0 - 2.0 / pi() * ({theta} + sin({theta}) * cos({theta}) * {odd}) END))"""


def normal_p(z: str) -> str:
    x = f"(({z}) / sqrt(2.0))"
    erf = f"list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln({x}) - lgamma(k + 1.5) - {x} * {x})))"
    return f"CASE WHEN ({z}) <= 0 THEN 1.0 WHEN ({z}) > 8 THEN 0.0 ELSE greatest(0.0, 1.0 - {erf}) END"


CTES["factor_p"] = f"""
SELECT s.*, {t_p('s.t', '(s.n - 2)')} AS p, {normal_p('z')} AS p_mwu FROM (
  SELECT *, (greatest(u, n_high * n_low - u) - n_high * n_low / 2.0 - 0.5)
            / sqrt(n_high * n_low / 12.0 * ((n + 1) - tie_term / (n * (n - 1.0)))) AS z FROM factor_stats) s"""
CTES["factor_q"] = """
SELECT *, min(raw) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q
FROM (SELECT *, least(1.0, p * m / k) AS raw FROM (
  SELECT *, row_number() OVER (ORDER BY p, parameter) AS k, count(*) OVER () AS m FROM factor_p))"""
CTES["factor_labels"] = f"""
SELECT *, CASE WHEN (abs(rho) >= 0.6 AND p < 0.05) OR (abs(delta) >= 0.08 AND p_mwu < 0.1) THEN 'Strong'
               WHEN (abs(rho) >= 0.35 AND p < 0.15) OR abs(delta) >= 0.04 THEN 'Moderate' ELSE 'Weak' END AS raw_label,
       q < {fv.SIGNIFICANCE} AS is_significant, 0.7 * abs(rho) + 0.3 * least(1.0, 3.0 * abs(delta)) AS effect_score FROM factor_q"""


@query(
    oracle="""SELECT parameter, p AS p_value, q AS p_adjusted, is_significant, CASE WHEN is_significant THEN raw_label ELSE 'not significant' END AS evidence,
                     row_number() OVER (ORDER BY round(effect_score, 9) DESC, parameter)::INTEGER AS rank FROM factor_labels""",
    doubles="p_value p_adjusted",
)
def factor_evidence(t):
    """Rank correlation p-values, their adjustment, and what is left of each association."""
    ranked = association.ranked_factors(association.overall_pairs(table(t), fv.TELEMETRY))
    return ranked.select(
        "parameter", F.col("p_spearman").alias("p_value"), F.col("q").alias("p_adjusted"), "is_significant",
        F.col("evidence_label").alias("evidence"), "rank",
    )


@query(
    oracle="""SELECT p.parameter, p.batch_id, p.x, p.y, mean - 2.0 * std AS lower, mean + 2.0 * std AS upper
              FROM pairs p JOIN factor_stats s ON s.parameter = p.parameter WHERE abs(x - mean) > 2.0 * std""",
    doubles="x y lower upper",
)
def factor_affected_batches(t):
    return association.affected_batches(association.overall_pairs(table(t), fv.TELEMETRY))


@query(
    oracle=f"""SELECT parameter, family, {r('rho', 3)} AS rho FROM family_stats
               WHERE family IN (SELECT family FROM family_pairs GROUP BY family HAVING stddev_pop(y) > 0)""",
    doubles="rho",
)
def factor_category_correlations(t):
    return association.category_correlations(family_pairs(t))


@query()
def factor_report(t):
    return association.analyze_factors(table(t), fv.TELEMETRY, n_boot=N_BOOT)


@query()
def family_report(t):
    rates = batch.category_counts_by_batch(t.inspection)
    return association.analyze_families(table(t), fv.TELEMETRY, n_boot=N_BOOT, rates=rates)

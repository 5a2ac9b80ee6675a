"""Drift between periods and tests of differing groups."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plantgauge import fixed_values as fv
from plantgauge.catalog.base import CTES, query
from plantgauge.catalog.cleaning import sql_category
from plantgauge.operators import drift, samples
from plantgauge.session import fresh_folder
from plantgauge.sources.sinks import stored_or_computed

MEASURES = ["roughness_ra", "dimension_delta_mm", "optical_score"]

CTES["period_values"] = f"""
SELECT parameter, date_trunc('week', timestamp)::TIMESTAMP AS period, round(x, {drift.VALUE_DIGITS}) AS x
FROM (UNPIVOT (SELECT timestamp, {', '.join(fv.TELEMETRY)} FROM process) ON {', '.join(fv.TELEMETRY)} INTO NAME parameter VALUE x)
WHERE timestamp IS NOT NULL"""
CTES["period_steps"] = """
SELECT parameter, period AS earlier, lead(period) OVER (PARTITION BY parameter ORDER BY period) AS later
FROM (SELECT DISTINCT parameter, period FROM period_values) QUALIFY later IS NOT NULL"""
CTES["period_gaps"] = """
SELECT parameter, earlier, later, x, sum(a) OVER t AS n_a, sum(b) OVER t AS n_b,
       sum(a) OVER w / sum(a) OVER t::DOUBLE AS fa, sum(b) OVER w / sum(b) OVER t::DOUBLE AS fb
FROM (SELECT s.parameter, earlier, later, x, count(*) FILTER (period = earlier) AS a, count(*) FILTER (period = later) AS b
      FROM period_steps s JOIN period_values v ON v.parameter = s.parameter AND v.period IN (s.earlier, s.later) GROUP BY ALL)
WINDOW t AS (PARTITION BY parameter, earlier), w AS (PARTITION BY parameter, earlier ORDER BY x)"""
CTES["period_ks"] = """
SELECT parameter, earlier, later, max(n_a)::BIGINT AS n_a, max(n_b)::BIGINT AS n_b, max(abs(fa - fb)) AS gap,
       arg_min(x, (-round(abs(fa - fb), 12), x)) AS widest_at
FROM period_gaps GROUP BY parameter, earlier, later"""
CTES["period_lambda"] = """
SELECT *, (sqrt(n_a::DOUBLE * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a::DOUBLE * n_b / (n_a + n_b))) * gap AS lam FROM period_ks"""

# a profile of the first period, used on all later ones
CTES["profile"] = f"""
SELECT parameter, n, list_sort(list_distinct(list_transform(q, lambda e: round(e, {drift.VALUE_DIGITS})))) AS edges
FROM (SELECT v.parameter, count(*) AS n, quantile_cont(x, [{', '.join(f'{i / drift.BINS}' for i in range(1, drift.BINS))}]) AS q
      FROM period_values v JOIN (SELECT parameter, min(period) AS first FROM period_values GROUP BY parameter) f
        ON v.parameter = f.parameter AND period = first GROUP BY v.parameter)"""
CTES["period_bins"] = """
SELECT v.parameter, period, len(list_filter(edges, lambda e: e < x)) AS bin, count(*) AS k
FROM period_values v JOIN profile p ON v.parameter = p.parameter GROUP BY ALL"""
CTES["period_shares"] = f"""
SELECT g.parameter, g.period, g.bin, bins, greatest(coalesce(k, 0) / total::DOUBLE, {drift.LEAST_SHARE}) AS share, k IS NULL AS none, total
FROM (SELECT parameter, period, len(edges) + 1 AS bins, total, unnest(range(0, len(edges) + 1)) AS bin
      FROM profile JOIN (SELECT parameter, period, sum(k) AS total FROM period_bins GROUP BY ALL) USING (parameter)) g
LEFT JOIN period_bins b ON b.parameter = g.parameter AND b.period = g.period AND b.bin = g.bin"""

CTES["variant_cells"] = f"""
SELECT trim(defect_category) AS category, variant, count(*) AS n FROM inspection
WHERE variant IS NOT NULL AND {sql_category('defect_category')} GROUP BY ALL"""
CTES["variant_table"] = """
SELECT a.category, b.variant, coalesce(n, 0) AS n, row_n, column_n, (sum(row_n) OVER (PARTITION BY b.variant))::DOUBLE AS total,
       row_n * (column_n / (sum(row_n) OVER (PARTITION BY b.variant))::DOUBLE) AS expected
FROM (SELECT category, sum(n) AS row_n FROM variant_cells GROUP BY category) a
CROSS JOIN (SELECT variant, sum(n) AS column_n FROM variant_cells GROUP BY variant) b
LEFT JOIN variant_cells c ON c.category = a.category AND c.variant = b.variant"""

CTES["measured"] = f"""
SELECT parameter, category, x
FROM (UNPIVOT (SELECT trim(defect_category) AS category, {', '.join(MEASURES)} FROM inspection WHERE {sql_category('defect_category')})
      ON {', '.join(MEASURES)} INTO NAME parameter VALUE x)"""


def values(t):
    return drift.period_values(t.process, fv.TELEMETRY)


def measured(t):
    from plantgauge.functions.columns import has_category

    rows = t.inspection.where(has_category("defect_category"))
    return rows.select(F.trim("defect_category").alias("category"), *MEASURES).unpivot(["category"], MEASURES, "parameter", "x")


def day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query(
    oracle=f"""SELECT parameter, strftime(earlier, '%Y-%m-%d') AS earlier, strftime(later, '%Y-%m-%d') AS later, n_a, n_b, gap, widest_at,
                      least(1.0, greatest(0.0, CASE WHEN lam <= 0 THEN 1.0
                        WHEN lam < 1.18 THEN 1.0 - sqrt({2 * math.pi}) / lam * list_sum(list_transform(range(1, 61), lambda j: exp(-((2 * j - 1) * (2 * j - 1)) * {math.pi**2 / 8} / (lam * lam))))
                        ELSE list_sum(list_transform(range(1, 61), lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END::DOUBLE * exp(-2.0 * lam * lam * j * j))) END)) AS p
               FROM period_lambda""",
    doubles="gap widest_at p",
)
def ks_drift(t):
    out = drift.ks_between_periods(values(t), ["parameter"])
    return out.select("parameter", day("earlier"), day("later"), "n_a", "n_b", "gap", "widest_at", "p")


def first_profile(t):
    """The profile of the first period, stored and read back as later runs would."""
    rows = values(t)
    first = rows.groupBy("parameter").agg(F.min("period").alias("period"))
    path = fresh_folder(t.spark, "profile")
    return stored_or_computed(
        t.spark, path, lambda: drift.distribution_profile(rows.join(F.broadcast(first), ["parameter", "period"]), ["parameter"])
    )


@query(
    oracle="""SELECT q.parameter, strftime(q.period, '%Y-%m-%d') AS period, max(q.total)::BIGINT AS n, max(q.bins)::INTEGER AS bins,
                     (count(*) FILTER (q.none))::INTEGER AS empty_bins, sum((q.share - p.share) * ln(q.share / p.share)) AS psi
              FROM period_shares q
              JOIN (SELECT parameter, min(period) AS first FROM period_values GROUP BY parameter) f ON f.parameter = q.parameter
              JOIN period_shares p ON p.parameter = q.parameter AND p.bin = q.bin AND p.period = first GROUP BY ALL""",
    doubles="psi",
)
def psi_drift(t):
    out = drift.stability_index(first_profile(t), values(t), ["parameter"], ["period"])
    return out.select("parameter", day("period"), "n", "bins", "empty_bins", "psi")


@query(
    oracle="""SELECT parameter, n::BIGINT AS n, unnest(range(0, len(edges) + 1))::INTEGER AS bin, unnest(list_append(edges, NULL)) AS upper,
                     unnest(list_transform(range(0, len(edges) + 1), lambda b: len(list_filter(xs, lambda x: len(list_filter(edges, lambda e: e < x)) = b)) / n::DOUBLE)) AS share
              FROM profile JOIN (SELECT v.parameter, list(x) AS xs FROM period_values v JOIN (SELECT parameter, min(period) AS first FROM period_values GROUP BY parameter) f
                                 ON v.parameter = f.parameter AND period = first GROUP BY v.parameter) USING (parameter)""",
    doubles="upper share",
)
def drift_profile_bins(t):
    rows = first_profile(t).select("parameter", "n", "edges", F.posexplode("shares").alias("bin", "share"))
    return rows.select("parameter", "n", "bin", F.get("edges", F.col("bin")).alias("upper"), "share")


@query(
    oracle="""SELECT max(total)::BIGINT AS n, count(DISTINCT category) AS rows, count(DISTINCT variant) AS columns,
                     sum((n - expected) * (n - expected) / expected) AS statistic,
                     (count(DISTINCT category) - 1) * (count(DISTINCT variant) - 1) AS dof,
                     sqrt(sum((n - expected) * (n - expected) / expected) / (max(total) * (least(count(DISTINCT category), count(DISTINCT variant)) - 1))) AS cramers_v
              FROM variant_table""",
    doubles="statistic cramers_v",
)
def chi_square_categories(t):
    return samples.chi_square(_categories(t), "category", "variant").drop("p")


def _categories(t):
    from plantgauge.functions.columns import has_category

    return t.inspection.where(has_category("defect_category")).select(F.trim("defect_category").alias("category"), "variant")


@query(
    oracle="""SELECT category, variant, n, row_n::BIGINT AS row_n, column_n::BIGINT AS column_n, total::BIGINT AS total, expected,
                     (n - expected) / sqrt(expected) AS residual FROM variant_table WHERE n > 0""",
    doubles="expected residual",
)
def contingency_residuals(t):
    return samples.contingency_cells(_categories(t), "category", "variant")


@query(
    oracle="""SELECT parameter, n, groups, 12.0 / (n * (n + 1.0)) * s / (1.0 - ties / (n * (n * n - 1.0))) AS h, groups - 1 AS dof
              FROM (SELECT parameter, sum(k)::BIGINT AS n, count(*) AS groups, sum(k * (r / k - (total + 1) / 2.0::DOUBLE) * (r / k - (total + 1) / 2.0::DOUBLE)) AS s, any_value(ties) AS ties
                    FROM (SELECT parameter, category, count(*)::DOUBLE AS k, sum(rx) AS r, any_value(total) AS total
                          FROM (SELECT parameter, category, count(*) OVER (PARTITION BY parameter) AS total,
                                       rank() OVER (PARTITION BY parameter ORDER BY x) + (count(*) OVER (PARTITION BY parameter, x) - 1) / 2.0::DOUBLE AS rx FROM measured)
                          GROUP BY ALL)
                    JOIN (SELECT parameter, sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT parameter, x, count(*) AS c FROM measured GROUP BY ALL) GROUP BY parameter) USING (parameter)
                    GROUP BY parameter)""",
    doubles="h",
)
def kruskal_factors(t):
    return samples.kruskal_wallis(measured(t), ["parameter"], "category", "x").drop("p")


@query(
    oracle="""SELECT parameter, n, groups, between_ AS between, within_ AS within, groups - 1 AS dof_between, n - groups AS dof_within,
                     (between_ / (groups - 1)) / (within_ / (n - groups)) AS f, between_ / (between_ + within_) AS eta_squared
              FROM (SELECT parameter, sum(k)::BIGINT AS n, count(*) AS groups, sum(k * (m - centre) * (m - centre)) AS between_, sum(w) AS within_
                    FROM (SELECT parameter, category, count(*) AS k, avg(x) AS m, var_pop(x) * count(*) AS w FROM measured GROUP BY ALL)
                    JOIN (SELECT parameter, avg(x) AS centre FROM measured GROUP BY parameter) USING (parameter) GROUP BY parameter)""",
    doubles="between within f eta_squared",
)
def anova_factors(t):
    return samples.anova(measured(t), ["parameter"], "category", "x").drop("p")

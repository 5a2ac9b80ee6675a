"""Findings, impact chain and recommendations over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge import fixed_values as fv
from plantgauge.catalog import association, economics  # noqa: F401  (register subqueries used below)
from plantgauge.catalog.base import CTES, query, r
from plantgauge.catalog.batches import DEF
from plantgauge.catalog.cleaning import sql_category
from plantgauge.catalog.evaluation import scored
from plantgauge.operators import batch, insights
from plantgauge.plans.plant_report import PlantReport

CTES["family_counts"] = f"""
SELECT defect_category AS family, count(*) AS n FROM inspection
WHERE {DEF} = 1 AND {sql_category('defect_category')} GROUP BY ALL"""
CTES["top_family"] = """
SELECT family, n AS family_count, n / (SELECT sum(n) FROM family_counts)::DOUBLE AS family_share
FROM family_counts ORDER BY n DESC, family LIMIT 1"""
CTES["top_factor"] = """
SELECT *, CASE WHEN is_significant THEN raw_label ELSE 'not significant' END AS evidence
FROM factor_labels ORDER BY round(effect_score, 9) DESC, parameter LIMIT 1"""
CTES["facts"] = """
SELECT f.*, t.parameter, t.rho, t.p AS p_value, t.evidence, t.n AS n_batches_used, (SELECT count(*) FROM batch_table) AS n_batches, t.high_mean, t.low_mean,
       l.bottleneck_station AS station, l.utilization, l.wip, l.rework_rate, l.throughput_lost_due_to_rework AS lost_uph,
       p.line_throughput, p.cost_of_poor_quality AS copq, p.scrap_cost, p.rework_cost, p.downtime_cost, p.margin, p.revenue,
       p.cost, p.profit, (tp + tn) / (tn + fp + fn + tp)::DOUBLE AS accuracy, fp / (tn + fp)::DOUBLE AS frr,
       fn / (tp + fn)::DOUBLE AS far, (SELECT count(*) FROM scored WHERE confidence < 0.7) AS uncertain_count,
       (SELECT avg(CAST(confidence < 0.7 AS INTEGER)) FROM scored) AS uncertain_fraction
FROM top_family f, top_factor t, line_summary l, plant_pnl p, counts"""


def report(t) -> PlantReport:
    return PlantReport(
        t.inspection, t.process, t.production, t.economic, scored=scored(t),
        units=t.production.agg(F.sum("units_in").alias("total_units")),
        parameters=fv.TELEMETRY, categories=(), hours_per_batch=8.0,
    )


@query(oracle="SELECT * FROM top_family", doubles="family_share")
def top_defect_family(t):
    return insights.top_defect_family(t.inspection)


@query(
    oracle=f"""SELECT batch_id, defect_category AS family, n AS family_count, n / total::DOUBLE AS family_share FROM (
                 SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, defect_category) AS k,
                        sum(n) OVER (PARTITION BY batch_id) AS total
                 FROM (SELECT batch_id, defect_category, count(*) AS n FROM inspection
                       WHERE {DEF} = 1 AND {sql_category('defect_category')} GROUP BY ALL)) WHERE k = 1""",
    doubles="family_share",
)
def top_family_by_batch(t):
    return insights.top_defect_family(t.inspection, by=["batch_id"])


@query(oracle=f"""SELECT defect_category AS category, count(*) AS count FROM inspection
                  WHERE {DEF} = 1 AND {sql_category('defect_category')} GROUP BY ALL""")
def category_counts(t):
    return batch.category_counts(t.inspection)


NUMBERS = {
    "Bottleneck & Flow": {
        "utilization_pct": r("utilization * 100.0", 1), "wip": "wip::DOUBLE", "rework_load_pct": r("rework_rate * 100.0", 1),
        "throughput_lost_uph": r("lost_uph", 1),
    },
    "Root-Cause Attribution": {
        "spearman_rho": r("rho", 3), "n_batches": "n_batches::DOUBLE", "high_defect_mean_pct": r("high_mean * 100.0", 2),
        "low_defect_mean_pct": r("low_mean * 100.0", 2),
        "delta_points": r(r("high_mean * 100.0", 2) + " - " + r("low_mean * 100.0", 2), 1),
    },
    "Plant Economics": {
        "copq": r("copq", 2), "scrap_cost": r("scrap_cost", 2), "rework_cost": r("rework_cost", 2),
        "downtime_cost": r("downtime_cost", 2), "gross_margin_pct": r("margin * 100.0", 2),
        "margin_penalty_points": r("copq / revenue * 100.0", 2),
    },
    "Quality AI & Triage": {
        "test_accuracy_pct": r("accuracy * 100.0", 1), "false_reject_rate_pct": r("frr * 100.0", 1),
        "false_accept_rate_pct": r("far * 100.0", 1), "uncertain_count": "uncertain_count::DOUBLE",
        "uncertain_pct": r("uncertain_fraction * 100.0", 1),
    },
}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def money(expr: str, digits: int) -> str:
    return f"format('{{:,.{digits}f}}', {expr})"


LOSS = "copq / revenue * 100.0"
STATEMENTS = {
    "flow": (f"printf({text(fv.FLOW_FINDING)}, station, utilization * 100.0, wip, rework_rate * 100.0, lost_uph)", "'High'"),
    "factor": (
        f"printf({text(fv.FACTOR_FINDING)}, parameter, rho, p_value, n_batches, parameter, high_mean * 100.0, low_mean * 100.0)", "evidence"
    ),
    "cost": (
        f"printf({text(fv.COST_FINDING)}, {money('copq', 2)}, {money('scrap_cost', 2)}, {money('rework_cost', 2)}, {money('downtime_cost', 2)}, {LOSS})",
        "'High'",
    ),
    "quality": (
        f"printf({text(fv.QUALITY_FINDING)}, accuracy * 100.0, frr * 100.0, far * 100.0, uncertain_count, uncertain_fraction * 100.0)", "'High'"
    ),
}
NUMBERS["Root-Cause Attribution"]["p_value"] = r("p_value", 4)


def _findings() -> str:
    rows = []
    for kind, (statement, confidence) in STATEMENTS.items():
        category, of = fv.FINDING_CATEGORIES[kind]
        shown = f"printf({text(of)}, evidence)" if "%s" in of else text(of)
        rows += [
            f"SELECT {text(category)} AS category, {statement} AS statement, {confidence} AS confidence, {shown} AS evidence_type, '{n}' AS name, {e} AS value FROM facts"
            for n, e in NUMBERS[category].items()
        ]
    return "\nUNION ALL ".join(rows)


@query(oracle=_findings(), doubles="value")
def computed_insights(t):
    """Every finding with its text and each of its named numbers."""
    rows = report(t).insights()
    return rows.select("category", "statement", "confidence", "evidence_type", F.explode("evidence").alias("name", "value"))


# name, metric and detail of the six stages
SHOWN = [
    ("family", "printf('%.1f%% of defects', family_share * 100)", "printf('%d units flagged', family_count)"),
    ("parameter", "printf('Spearman rho = %+.2f', rho)",
     "printf('p=%.4f (%s evidence, +%.1f%% pts in high batches)', p_value, evidence, (high_mean - low_mean) * 100.0)"),
    ("station", "printf('%.1f%% Utilization', utilization * 100)", "printf('WIP: %d | Rework adds +%.1f%% load', wip, rework_rate * 100.0)"),
    ("printf('%.1f UPH Lost', lost_uph)", "printf('-%.1f UPH', lost_uph)", "'Lost due to rework looping back into bottleneck'"),
    (f"'$' || {money('copq', 2)}", f"'$' || {money('copq', 0)} || ' COPQ'",
     f"printf('$%s scrap, $%s rework, $%s dt', {money('scrap_cost', 0)}, {money('rework_cost', 0)}, {money('downtime_cost', 0)})"),
    ("printf('%.1f%% Margin', margin * 100)", "printf('%.1f%% Operating Margin', margin * 100)", f"printf('-%.1f%% pts lost to poor quality', {LOSS})"),
]


@query(
    oracle="\nUNION ALL ".join(
        f"SELECT {i + 1} AS stage, {text(title)} AS title, {name} AS name, {metric} AS metric, {detail} AS detail, true AS is_available FROM facts"
        for i, (title, (name, metric, detail)) in enumerate(zip(fv.STAGES, SHOWN))
    )
)
def impact_chain(t):
    return report(t).impact_chain()


GAIN, POINTS = f"copq * {fv.COPQ_RECOVERY}::DOUBLE", f"copq * {fv.COPQ_RECOVERY}::DOUBLE / revenue * 100.0"
ADVICE = [  # title, evidence, action, impact, gain, points
    ("parameter", f"printf('Likely contributing factor: %s (%s, %s)', parameter, {SHOWN[1][1]}, {SHOWN[1][2]})",
     f"printf({text(fv.ADVICE_ACTIONS[0])}, parameter, parameter, family, {SHOWN[1][2]})",
     f"printf({text(fv.ADVICE_IMPACTS[0])}, parameter, family, lost_uph)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    ("station", f"printf('Bottleneck station: %s (%s, %s)', station, {SHOWN[2][1]}, {SHOWN[2][2]})",
     f"printf({text(fv.ADVICE_ACTIONS[1])}, station, {SHOWN[2][2]})", f"printf({text(fv.ADVICE_IMPACTS[1])}, station, {SHOWN[3][0]})",
     "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    (SHOWN[4][0], f"printf('Total Cost of Poor Quality: %s (%s, %s)', {SHOWN[4][0]}, {SHOWN[4][2]}, {SHOWN[5][2]})",
     text(fv.ADVICE_ACTIONS[2]), f"printf({text(fv.ADVICE_IMPACTS[2])}, {money(GAIN, 0)}, {POINTS})", GAIN, POINTS),
]


@query(
    oracle="\nUNION ALL ".join(
        f"""SELECT {text(fv.ADVICE_CATEGORIES[i])} AS category, printf({text(fv.ADVICE_TITLES[i])}, {subject}) AS title, {evidence} AS evidence,
                   {action} AS recommended_action, {impact} AS projected_impact, {gain} AS projected_profit_gain, {points} AS projected_margin_points,
                   {text(fv.ADVICE_CONFIDENCE[i])} AS confidence_level, {text(fv.ADVISORY_STATUS)} AS status FROM facts"""
        for i, (subject, evidence, action, impact, gain, points) in enumerate(ADVICE)
    ),
    doubles="projected_profit_gain projected_margin_points",
)
def advisories(t):
    return report(t).advisories()


@query(
    oracle=f"""SELECT (SELECT count(*) FROM inspection) AS units, (SELECT CAST(sum({DEF}) AS BIGINT) FROM inspection) AS defects,
                      (SELECT avg({DEF}) * 100.0 FROM inspection) AS defect_rate_pct, line_throughput, station AS bottleneck,
                      utilization * 100.0 AS bottleneck_utilization_pct, revenue, cost, profit, margin * 100.0 AS margin_pct FROM facts""",
    doubles="defect_rate_pct line_throughput bottleneck_utilization_pct revenue cost profit margin_pct",
)
def kpi_row(t):
    return report(t).kpis()


@query(
    oracle=f"""SELECT printf('Top defect family is <b>%s</b> (%.1f%% of defects). statistically associated with process parameter <b>%s</b> (rho=%+.2f, p=%.4f). cycling rework into primary bottleneck <b>%s</b> (%.1f%% utilization). causing an avoidable throughput loss of <b>%.1f UPH</b>. and driving <b>$%s</b> in Cost of Poor Quality (COPQ). depressing plant operating margin by <b>%.1f%% points</b> to <b>%.1f%%</b>.',
                             family, family_share * 100.0, parameter, rho, p_value, station, utilization * 100.0, lost_uph, {money('copq', 2)}, {LOSS}, margin * 100.0) AS narrative,
                      true AS all_available FROM facts"""
)
def impact_narrative(t):
    return report(t).narrative()

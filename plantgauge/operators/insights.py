"""Findings, the impact chain and recommendations.

All facts of a plant (or of each ``by`` group) are brought into one row; every
finding is then an expression over that row, kept if its facts are there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plantgauge import fixed_values as fv
from plantgauge.functions.columns import has_category, rounded
from plantgauge.operators.batch import category_column, defect_flag

# fact column -> type; a part that is not given leaves its facts null
FACTS = {
    "quality_family": {"family": "string", "family_count": "bigint", "family_share": "double"},
    "factor": {
        "parameter": "string", "rho": "double", "p_value": "double", "n_batches": "bigint", "high_mean": "double",
        "low_mean": "double", "evidence": "string",
    },
    "flow": {
        "station": "string", "utilization": "double", "wip": "bigint", "rework_rate": "double", "lost_uph": "double",
        "line_throughput": "double",
    },
    "economics": {
        "copq": "double", "scrap_cost": "double", "rework_cost": "double", "downtime_cost": "double", "margin": "double",
        "revenue": "double", "cost": "double", "profit": "double",
    },
    "quality": {
        "accuracy": "double", "frr": "double", "far": "double", "uncertain_count": "bigint", "uncertain_fraction": "double",
    },
}


def top_defect_family(inspection: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The most frequent category among the categorised defective units, and its share."""
    cat = category_column(inspection)
    bad = inspection.where((defect_flag(inspection) == 1) & has_category(cat))
    counts = bad.groupBy(*by, F.col(cat).alias("family")).agg(F.count(F.lit(1)).alias("family_count"))
    best = F.min_by(F.struct("family", "family_count"), F.struct(-F.col("family_count"), F.col("family")))
    return counts.groupBy(*by).agg(best.alias("b"), F.sum("family_count").alias("_n")).select(
        *by, F.col("b.family").alias("family"), F.col("b.family_count").alias("family_count"),
        (F.col("b.family_count") / F.greatest(F.lit(1), F.col("_n"))).alias("family_share"),
    )


def top_factor(ranked: DataFrame) -> DataFrame:
    """First row of the ranked factors, as facts."""
    return ranked.where(F.col("rank") == 1).select(
        "parameter", F.col("rho"), F.col("p_spearman").alias("p_value"), F.col("sample_size").cast("bigint").alias("n_batches"),
        "high_mean", "low_mean", F.col("evidence_label").alias("evidence"),
    )


def flow_facts(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return summary.select(
        *by, F.col("bottleneck_station").alias("station"), "utilization", "wip", "rework_rate",
        F.col("throughput_lost_due_to_rework").alias("lost_uph"), "line_throughput",
    )


def economics_facts(pnl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pnl.select(
        *by, F.col("cost_of_poor_quality").alias("copq"), "scrap_cost", "rework_cost", "downtime_cost", "margin", "revenue",
        "cost", "profit",
    )


def quality_facts(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rates.select(*by, "accuracy", "frr", "far", "uncertain_count", "uncertain_fraction")


def gather(spark, by: Sequence[str] = (), **parts: DataFrame) -> DataFrame:
    """All facts in one row per group. ``parts`` are named as in FACTS; each has at
    most one row per group. Without ``by`` a part is a scalar; with it, parts are
    full-joined on the keys."""
    unknown = set(parts) - set(FACTS)
    if unknown:
        raise ValueError(f"unknown facts: {sorted(unknown)}")
    if by:
        names = list(parts)
        out = parts[names[0]]
        for name in names[1:]:
            out = out.join(parts[name], list(by), "full")
    else:
        out = spark.range(1).select()
        for part in parts.values():
            row = part.select(F.struct("*")).limit(1).scalar()
            out = out.withColumns({c: row[c] for c in part.columns})
    missing = {c: F.lit(None).cast(t) for n, cols in FACTS.items() if n not in parts for c, t in cols.items()}
    return out.withColumns(missing)


def margin_loss_points(copq: Column, revenue: Column) -> Column:
    """Cost of poor quality in percentage points of revenue, 0 without revenue."""
    return F.when(revenue > 0, copq / F.greatest(F.lit(1.0), revenue) * 100.0).otherwise(0.0)


def _money(c: Column, digits: int) -> Column:
    return F.format_number(c, digits)


def _flow_known() -> Column:
    return F.col("station").isNotNull() & (F.col("utilization") > 0)


def _rows(facts: DataFrame, by: Sequence[str], items: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One row per item whose condition holds."""
    kept = [F.when(cond, item) for cond, item in items]
    rows = facts.select(*by, F.explode(F.array(*kept)).alias("_i")).where(F.col("_i").isNotNull())
    return rows.select(*by, "_i.*")


def computed_insights(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """category, statement, evidence (named numbers), confidence, evidence_type."""
    util, rework = F.col("utilization") * 100.0, F.col("rework_rate") * 100.0
    loss = margin_loss_points(F.col("copq"), F.col("revenue"))

    def finding(kind: str, statement: Column, confidence: Column, kind_text: Column | None = None, **numbers: Column) -> Column:
        category, text = fv.FINDING_CATEGORIES[kind]
        pairs = [x for n, c in numbers.items() for x in (F.lit(n), c.cast("double"))]
        evidence = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        return F.struct(
            F.lit(category).alias("category"), statement.alias("statement"),
            evidence.cast("map<string,double>").alias("evidence"), confidence.alias("confidence"),
            (kind_text if kind_text is not None else F.lit(text)).alias("evidence_type"),
        )

    c = F.col
    has_factor = c("parameter").isNotNull()
    high, low = c("high_mean") * 100.0, c("low_mean") * 100.0
    items = [
        (
            _flow_known(),
            finding(
                "flow", F.format_string(fv.FLOW_FINDING, c("station"), util, c("wip"), rework, c("lost_uph")), F.lit("High"),
                utilization_pct=rounded(util, 1), wip=c("wip"), rework_load_pct=rounded(rework, 1),
                throughput_lost_uph=rounded(c("lost_uph"), 1),
            ),
        ),
        (
            has_factor,
            finding(
                "factor",
                F.format_string(
                    fv.FACTOR_FINDING, c("parameter"), c("rho"), c("p_value"), c("n_batches"), c("parameter"), high, low
                ),
                c("evidence"), F.format_string(fv.FINDING_CATEGORIES["factor"][1], c("evidence")),
                spearman_rho=rounded(c("rho"), 3), p_value=rounded(c("p_value"), 4), n_batches=c("n_batches"),
                high_defect_mean_pct=rounded(high, 2), low_defect_mean_pct=rounded(low, 2),
                delta_points=rounded(rounded(high, 2) - rounded(low, 2), 1),
            ),
        ),
        (~has_factor, finding("no factor", F.lit(fv.NO_FACTOR_FINDING), F.lit("Low"))),
        (
            c("copq") > 0,
            finding(
                "cost",
                F.format_string(
                    fv.COST_FINDING, _money(c("copq"), 2), _money(c("scrap_cost"), 2), _money(c("rework_cost"), 2),
                    _money(c("downtime_cost"), 2), loss,
                ),
                F.lit("High"),
                copq=rounded(c("copq"), 2), scrap_cost=rounded(c("scrap_cost"), 2), rework_cost=rounded(c("rework_cost"), 2),
                downtime_cost=rounded(c("downtime_cost"), 2), gross_margin_pct=rounded(c("margin") * 100.0, 2),
                margin_penalty_points=rounded(loss, 2),
            ),
        ),
        (
            c("accuracy").isNotNull(),
            finding(
                "quality",
                F.format_string(
                    fv.QUALITY_FINDING, c("accuracy") * 100.0, c("frr") * 100.0, c("far") * 100.0, c("uncertain_count"),
                    c("uncertain_fraction") * 100.0,
                ),
                F.lit("High"),
                test_accuracy_pct=rounded(c("accuracy") * 100.0, 1), false_reject_rate_pct=rounded(c("frr") * 100.0, 1),
                false_accept_rate_pct=rounded(c("far") * 100.0, 1), uncertain_count=c("uncertain_count"),
                uncertain_pct=rounded(c("uncertain_fraction") * 100.0, 1),
            ),
        ),
    ]
    return _rows(facts, by, items)


def _stages() -> list[dict[str, Column]]:
    """name, metric, detail and availability of the six stages."""
    c, text = F.col, F.format_string
    loss = F.when(c("copq") >= 0, margin_loss_points(c("copq"), c("revenue"))).otherwise(0.0)
    delta = (c("high_mean") - c("low_mean")) * 100.0
    margin = c("margin") * 100.0
    return [
        {
            "ok": c("family").isNotNull(), "name": c("family"),
            "metric": text("%.1f%% of defects", c("family_share") * 100.0), "detail": text("%d units flagged", c("family_count")),
        },
        {
            "ok": c("parameter").isNotNull(), "name": c("parameter"), "metric": text("Spearman rho = %+.2f", c("rho")),
            "detail": text("p=%.4f (%s evidence, +%.1f%% pts in high batches)", c("p_value"), c("evidence"), delta),
        },
        {
            "ok": _flow_known(), "name": c("station"), "metric": text("%.1f%% Utilization", c("utilization") * 100.0),
            "detail": text("WIP: %d | Rework adds +%.1f%% load", c("wip"), c("rework_rate") * 100.0),
        },
        {
            "ok": c("lost_uph") >= 0, "name": text("%.1f UPH Lost", c("lost_uph")), "metric": text("-%.1f UPH", c("lost_uph")),
            "detail": F.lit("Lost due to rework looping back into bottleneck"),
        },
        {
            "ok": c("copq") >= 0, "name": text("$%s", _money(c("copq"), 2)), "metric": text("$%s COPQ", _money(c("copq"), 0)),
            "detail": text(
                "$%s scrap, $%s rework, $%s dt", _money(c("scrap_cost"), 0), _money(c("rework_cost"), 0), _money(c("downtime_cost"), 0)
            ),
        },
        {
            "ok": c("margin").isNotNull(), "name": text("%.1f%% Margin", margin), "metric": text("%.1f%% Operating Margin", margin),
            "detail": text("-%.1f%% pts lost to poor quality", loss),
        },
    ]


def impact_chain(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """stage, title, name, metric, detail, is_available: six rows per group."""
    items = []
    for i, (title, s) in enumerate(zip(fv.STAGES, _stages())):
        ok = F.coalesce(s["ok"], F.lit(False))
        shown = {k: F.when(ok, s[k]).otherwise(fv.INSUFFICIENT) for k in ("name", "metric", "detail")}
        items.append(
            (
                F.lit(True),
                F.struct(
                    F.lit(i + 1).alias("stage"), F.lit(title).alias("title"), *[shown[k].alias(k) for k in shown],
                    ok.alias("is_available"),
                ),
            )
        )
    return _rows(facts, by, items)


def impact_narrative(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One sentence chain per group, from the stages that are available."""
    c, text = F.col, F.format_string
    ok = [F.coalesce(s["ok"], F.lit(False)) for s in _stages()]
    loss = F.when(c("copq") >= 0, margin_loss_points(c("copq"), c("revenue"))).otherwise(0.0)
    parts = [
        text("Top defect family is <b>%s</b> (%.1f%% of defects)", c("family"), c("family_share") * 100.0),
        text("statistically associated with process parameter <b>%s</b> (rho=%+.2f, p=%.4f)", c("parameter"), c("rho"), c("p_value")),
        text("cycling rework into primary bottleneck <b>%s</b> (%.1f%% utilization)", c("station"), c("utilization") * 100.0),
        text("causing an avoidable throughput loss of <b>%.1f UPH</b>", c("lost_uph")),
        text("and driving <b>$%s</b> in Cost of Poor Quality (COPQ)", _money(c("copq"), 2)),
        text("depressing plant operating margin by <b>%.1f%% points</b> to <b>%.1f%%</b>", loss, c("margin") * 100.0),
    ]
    told = F.concat_ws(". ", *[F.when(o, p) for o, p in zip(ok, parts)])
    return facts.select(
        *by,
        F.when(told == "", "Insufficient data across stages to form complete narrative.").otherwise(F.concat(told, F.lit("."))).alias("narrative"),
        F.array_min(F.array(*ok)).alias("all_available"),
    )


def advisories(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Up to three recommendations per group, with the gain of recovering part of the COPQ."""
    s = _stages()
    c, text = F.col, F.format_string
    family = F.coalesce(c("family"), F.lit(fv.INSUFFICIENT))
    gain = c("copq") * fv.COPQ_RECOVERY
    points = gain / F.greatest(F.lit(1.0), c("revenue")) * 100.0
    lost = F.coalesce(c("lost_uph"), F.lit(0.0))
    lost_name = F.when(s[3]["ok"], s[3]["name"]).otherwise(fv.INSUFFICIENT)
    margin_detail = F.when(s[5]["ok"], s[5]["detail"]).otherwise(fv.INSUFFICIENT)
    none = F.lit(None).cast("double")
    drafts = [
        (
            s[1]["ok"], c("parameter"),
            text("Likely contributing factor: %s (%s, %s)", c("parameter"), s[1]["metric"], s[1]["detail"]),
            text(fv.ADVICE_ACTIONS[0], c("parameter"), c("parameter"), family, s[1]["detail"]),
            text(fv.ADVICE_IMPACTS[0], c("parameter"), family, lost), none, none,
        ),
        (
            s[2]["ok"], c("station"), text("Bottleneck station: %s (%s, %s)", c("station"), s[2]["metric"], s[2]["detail"]),
            text(fv.ADVICE_ACTIONS[1], c("station"), s[2]["detail"]), text(fv.ADVICE_IMPACTS[1], c("station"), lost_name), none, none,
        ),
        (
            s[4]["ok"], s[4]["name"],
            text("Total Cost of Poor Quality: %s (%s, %s)", s[4]["name"], s[4]["detail"], margin_detail),
            F.lit(fv.ADVICE_ACTIONS[2]), text(fv.ADVICE_IMPACTS[2], _money(gain, 0), points), gain, points,
        ),
    ]
    items = []
    for i, (ok, subject, evidence, action, impact, money, pts) in enumerate(drafts):
        items.append(
            (
                F.coalesce(ok, F.lit(False)),
                F.struct(
                    F.lit(fv.ADVICE_CATEGORIES[i]).alias("category"), text(fv.ADVICE_TITLES[i], subject).alias("title"),
                    evidence.alias("evidence"), action.alias("recommended_action"), impact.alias("projected_impact"),
                    money.alias("projected_profit_gain"), pts.alias("projected_margin_points"),
                    F.lit(fv.ADVICE_CONFIDENCE[i]).alias("confidence_level"), F.lit(fv.ADVISORY_STATUS).alias("status"),
                ),
            )
        )
    return _rows(facts, by, items)


def kpi_row(facts: DataFrame, inspection: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Units, defect rate, throughput, bottleneck and the money figures; one row per group."""
    units = inspection.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.sum(defect_flag(inspection)).alias("defects"))
    if by:
        rows = facts.join(units, list(by), "left")
    else:
        row = units.select(F.struct("*")).scalar()
        rows = facts.withColumns({c: row[c] for c in ("units", "defects")})
    return rows.select(
        *by, "units", "defects", (F.col("defects") / F.greatest(F.lit(1), F.col("units")) * 100.0).alias("defect_rate_pct"),
        "line_throughput", F.col("station").alias("bottleneck"), (F.col("utilization") * 100.0).alias("bottleneck_utilization_pct"),
        "revenue", "cost", "profit", (F.col("margin") * 100.0).alias("margin_pct"),
    )

"""Profit and loss, what-if scenarios and their bootstrap range, at any grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantgauge import fixed_values as fv
from plantgauge.functions import draws
from plantgauge.functions.columns import ratio, rounded
from plantgauge.operators.bounds import row_count, small_side
from plantgauge.operators.prefix import numbered
from plantgauge.session import cut_lineage

COSTS = ["material_cost", "labor_cost", "overhead_cost", "scrap_cost", "rework_cost", "downtime_cost"]
# bootstrap draws of one task, some seconds of hashing
TASK_DRAWS = 4_000_000


def economic_params(economic: DataFrame | None) -> dict[str, Column]:
    """The first row of the parameter table, with defaults; read once, as a scalar."""
    if economic is None:
        return {k: F.lit(v) for k, v in fv.ECONOMIC_DEFAULTS.items()}
    present = [k for k in fv.ECONOMIC_DEFAULTS if k in economic.columns]
    row = economic.select(F.struct(*[F.col(k).cast("double").alias(k) for k in present])).limit(1).scalar()
    return {
        k: F.coalesce(row[k], F.lit(v)) if k in present else F.lit(v) for k, v in fv.ECONOMIC_DEFAULTS.items()
    }


def calculate_economics(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """P&L of rows holding good_units, unit_price and the six period costs."""
    good = F.col("good_units").cast("double")
    priced = df.withColumns(
        {
            "_revenue": good * F.col("unit_price"),
            "_cost": sum((F.col(c).cast("double") for c in COSTS[1:]), F.col(COSTS[0]).cast("double")),
            "_copq": F.col("scrap_cost") + F.col("rework_cost") + F.col("downtime_cost"),
        }
    )
    profit = F.col("_revenue") - F.col("_cost")
    return priced.select(
        *keep,
        F.col("good_units").cast("long").alias("good_units"),
        rounded(F.col("unit_price"), 2).alias("unit_price"),
        rounded(F.col("_revenue"), 2).alias("revenue"),
        *[rounded(F.col(c), 2).alias(c) for c in COSTS],
        rounded(F.col("_cost"), 2).alias("cost"),
        rounded(profit, 2).alias("profit"),
        rounded(ratio(profit, F.col("_revenue")), 4).alias("margin"),
        rounded(ratio(F.col("_cost"), good), 2).alias("cost_per_good_unit"),
        rounded(F.col("_copq"), 2).alias("cost_of_poor_quality"),
    )


def calculate_pnl(
    totals: DataFrame,
    economic: DataFrame | None,
    keep: Sequence[str] = (),
    shift_hours: float | str = fv.SHIFT_HOURS,
    workers: int | str = fv.DEFAULT_WORKERS,
) -> DataFrame:
    """P&L of rows holding total_units, scrap_units, rework_units, downtime_minutes.

    ``workers`` and ``shift_hours`` are numbers or names of columns; labor and
    overhead are paid for these hours.
    """
    p = economic_params(economic)
    crew = F.col(workers) if isinstance(workers, str) else F.lit(workers)
    hours = F.col(shift_hours) if isinstance(shift_hours, str) else F.lit(float(shift_hours))
    units, scrap, rework = F.col("total_units"), F.col("scrap_units"), F.col("rework_units")
    rolled = totals.select(
        *keep,
        units.alias("total_units_produced"),
        scrap.alias("scrapped"),
        rework.alias("reworked"),
        F.col("downtime_minutes"),
        F.greatest(F.lit(0), units - scrap).alias("good_units"),
        p["unit_price"].alias("unit_price"),
        (units * p["material_cost"]).alias("material_cost"),
        (hours * crew * p["labor_cost"]).alias("labor_cost"),
        (hours * p["overhead_cost"]).alias("overhead_cost"),
        (scrap * p["scrap_cost"]).alias("scrap_cost"),
        (rework * p["rework_cost"]).alias("rework_cost"),
        (F.col("downtime_minutes") / 60.0 * p["downtime_cost_per_hour"]).alias("downtime_cost"),
    )
    carried = [*keep, "total_units_produced", "scrapped", "reworked", "downtime_minutes"]
    return (
        calculate_economics(rolled, carried)
        .withColumn("downtime_minutes", rounded(F.col("downtime_minutes"), 1))
        .withColumn("gross_margin_pct", rounded(F.col("margin") * 100.0, 2))
    )


def plant_pnl(line_summary: DataFrame, units: DataFrame, economic: DataFrame | None) -> DataFrame:
    """P&L of the whole plant: inspected units, and scrap, rework and downtime of its
    stations; two workers per station, paid for the hours the line's sums belong to.
    ``units`` is one row with total_units."""
    crew = F.when(F.col("stations") > 0, F.col("stations") * 2).otherwise(F.lit(fv.DEFAULT_WORKERS))
    totals = line_summary.select(
        units.select("total_units").scalar().alias("total_units"),
        F.col("total_scrap").alias("scrap_units"),
        F.col("total_rework").alias("rework_units"),
        (F.coalesce(F.col("downtime_hours"), F.lit(0.0)) * 60.0).alias("downtime_minutes"),
        crew.alias("workers"),
        F.coalesce("hours", F.lit(float(fv.SHIFT_HOURS))).alias("hours"),
        "line_throughput",
    )
    return calculate_pnl(totals, economic, keep=["line_throughput"], shift_hours="hours", workers="workers")


WATERFALL = [  # row name, column, sign
    ("Gross Revenue", "revenue", 1.0),
    ("Material", "material_cost", -1.0),
    ("Labor", "labor_cost", -1.0),
    ("Overhead", "overhead_cost", -1.0),
    ("Scrap Cost", "scrap_cost", -1.0),
    ("Rework Cost", "rework_cost", -1.0),
    ("Downtime Cost", "downtime_cost", -1.0),
    ("Operating Profit", "profit", 1.0),
]
COPQ = [("Scrap Waste", "scrap_cost"), ("Rework Labor/Parts", "rework_cost"), ("Downtime Penalties", "downtime_cost")]


def _rows(pnl: DataFrame, entries, keep: Sequence[str], name: str, value: str) -> DataFrame:
    structs = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias(name), c.alias(value)) for i, (n, c) in enumerate(entries)
    ]
    return pnl.select(*keep, F.explode(F.array(*structs)).alias("e")).select(*keep, "e.*")


def waterfall(pnl: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _rows(pnl, [(n, F.col(c) * s) for n, c, s in WATERFALL], keep, "step", "amount")


def copq_breakdown(pnl: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    rows = _rows(pnl, [(n, F.col(c)) for n, c in COPQ], keep, "disruption", "cost")
    whole = sum((F.col(c) for _, c in COPQ[1:]), F.col(COPQ[0][1]))
    shares = pnl.select(*keep, *[ratio(F.col(c), whole).alias(c) for _, c in COPQ])
    share_rows = _rows(shares, [(n, F.col(c)) for n, c in COPQ], keep, "disruption", "share").drop("position")
    return rows.join(share_rows, [*keep, "disruption"])


def scenarios(rows: Sequence[tuple[float, float, float]]) -> Column:
    """Array literal of (defect reduction, capacity boost, downtime reduction) percents."""
    names = ("defect_reduction_pct", "capacity_boost_pct", "downtime_reduction_pct")
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, r)]) for r in rows])


def what_if(base: DataFrame, rows: Sequence[tuple[float, float, float]], keep: Sequence[str] = ()) -> DataFrame:
    """Every baseline row under every scenario: simulated figures and deltas.

    ``base`` holds line_throughput and the columns of :func:`calculate_economics`.
    """
    s = base.withColumn("_s", F.explode(scenarios(rows))).select("*", "_s.*").drop("_s")
    less_defects = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("defect_reduction_pct") / 100.0)
    more_capacity = F.lit(1.0) + F.col("capacity_boost_pct") / 100.0
    less_downtime = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("downtime_reduction_pct") / 100.0)
    availability = F.lit(1.0) + F.col("downtime_reduction_pct") / 100.0 * 0.10
    tp, good, scrap = F.col("line_throughput"), F.col("good_units"), F.col("scrap_cost")
    per_good_scrap = F.greatest(F.lit(1.0), scrap / F.greatest(F.lit(1), good))
    s = s.withColumns(
        {
            "sim_throughput": rounded(tp * more_capacity * availability, 2),
            "_saved": F.when(good > 0, scrap * (F.lit(1.0) - less_defects) / per_good_scrap).otherwise(0.0),
            "_scrap": rounded(scrap * less_defects, 2),
            "_rework": rounded(F.col("rework_cost") * less_defects, 2),
            "_down": rounded(F.col("downtime_cost") * less_downtime, 2),
        }
    )
    s = s.withColumn("_ratio", F.when(tp > 0, F.col("sim_throughput") / tp).otherwise(1.0))
    s = s.withColumns(
        {
            "sim_good_units": rounded(good * F.col("_ratio") + F.col("_saved") * 0.5, 0).cast("long"),
            "_mat": rounded(F.col("material_cost") * F.col("_ratio"), 2),
        }
    )
    s = s.withColumns(
        {
            "sim_revenue": rounded(F.col("sim_good_units") * F.col("unit_price"), 2),
            "sim_copq": rounded(F.col("_scrap") + F.col("_rework") + F.col("_down"), 2),
            "sim_cost": rounded(
                F.col("_mat") + F.col("labor_cost") + F.col("overhead_cost")
                + F.col("_scrap") + F.col("_rework") + F.col("_down"),
                2,
            ),
        }
    )
    s = s.withColumn("sim_profit", rounded(F.col("sim_revenue") - F.col("sim_cost"), 2))
    s = s.withColumns(
        {
            "sim_margin": rounded(ratio(F.col("sim_profit"), F.col("sim_revenue")), 4),
            "sim_cost_per_good_unit": rounded(ratio(F.col("sim_cost"), F.col("sim_good_units")), 2),
        }
    )
    return s.select(
        *keep,
        "defect_reduction_pct",
        "capacity_boost_pct",
        "downtime_reduction_pct",
        tp.alias("throughput"),
        "good_units",
        "revenue",
        "cost",
        "profit",
        "margin",
        F.col("cost_of_poor_quality").alias("copq"),
        "sim_throughput",
        "sim_good_units",
        "sim_revenue",
        "sim_cost",
        "sim_profit",
        "sim_margin",
        "sim_cost_per_good_unit",
        "sim_copq",
        rounded(F.col("sim_throughput") - tp, 2).alias("throughput_delta"),
        (F.col("sim_good_units") - good).alias("good_units_delta"),
        rounded(F.col("sim_revenue") - F.col("revenue"), 2).alias("revenue_delta"),
        rounded(F.col("sim_cost") - F.col("cost"), 2).alias("cost_delta"),
        rounded(F.col("sim_profit") - F.col("profit"), 2).alias("profit_delta"),
        rounded(F.col("sim_margin") - F.col("margin"), 4).alias("margin_delta"),
        rounded(F.col("sim_copq") - F.col("cost_of_poor_quality"), 2).alias("copq_delta"),
        F.lit(fv.SIMULATED).alias("label"),
    )


def margin_recovery(
    pnl: DataFrame, rows: Sequence[tuple[float, float]], keep: Sequence[str] = ()
) -> DataFrame:
    """What-if preset for (defect reduction, throughput increase) percents: downtime
    falls by half the defect reduction, throughput is good units per shift hour."""
    base = pnl.withColumn("line_throughput", F.col("good_units") / F.lit(fv.SHIFT_HOURS))
    sim = what_if(base, [(d, t, d * 0.5) for d, t in rows], keep)
    return sim.select(
        *keep,
        "defect_reduction_pct",
        F.col("capacity_boost_pct").alias("throughput_increase_pct"),
        F.col("profit").alias("baseline_profit"),
        F.col("sim_profit").alias("simulated_profit"),
        F.col("profit_delta").alias("profit_gain"),
        rounded(F.col("margin") * 100.0, 2).alias("baseline_margin"),
        rounded(F.col("sim_margin") * 100.0, 2).alias("simulated_margin"),
        rounded(F.col("margin_delta") * 100.0, 2).alias("margin_gain_points"),
        rounded(-F.col("cost_delta"), 2).alias("cost_savings"),
        "label",
    )


def numbered_draws(spark: SparkSession, n: int, n_boot: int, seed: int) -> DataFrame:
    """(rep, row_index): n draws from n rows in each repetition, in even tasks."""
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-n * n_boot // TASK_DRAWS))
    whole = max(1, n)
    every = spark.range(0, n * n_boot, 1, tasks).select(
        F.expr(f"cast(id div {whole} as int)").alias("rep"), (F.col("id") % whole).alias("_j")
    )
    return every.select("rep", draws.index(F.lit(whole), seed, F.col("rep"), F.col("_j")).alias("row_index"))


def resampled_sums(
    table: DataFrame, columns: Sequence[str], order: Sequence[str], n_boot: int, seed: int
) -> DataFrame:
    """Bootstrap sums: per repetition, n rows drawn with replacement from n.

    Draw j of repetition b is md5(seed|b|j) mod n. The draws are numbered and cut into even
    tasks of at most ``TASK_DRAWS``, however few partitions the table has; the narrow row table
    is looked up by broadcast while small and by a shuffled join otherwise.
    """
    rows = cut_lineage(numbered(table.select(*order, *columns), [], list(order)))
    n = row_count(rows)
    picks = numbered_draws(table.sparkSession, n, n_boot, seed)
    looked_up = picks.join(small_side(rows.select("row_index", *columns), n), "row_index")
    return looked_up.groupBy("rep").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in columns])


def bootstrap_what_if_margin(
    table: DataFrame,
    baseline: DataFrame,
    scenario: tuple[float, float, float],
    n_boot: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Median and 10-90 % range of the what-if margin over resampled batches.

    ``table`` is the batch table, ``baseline`` one row of
    :func:`calculate_economics`. Without batches the range is the base margin.
    """
    names = set(table.columns)
    half_defects = F.col("defect_count") * 0.5 if "defect_count" in names else F.lit(0.0)
    spread = {"scrap_units": half_defects, "rework_units": half_defects, "downtime_hours": F.lit(1.0)}
    counted = [c for c in spread if c in names]
    narrow = cut_lineage(
        table.select(
            "batch_id",
            F.col("total_inspected").cast("double").alias("total"),
            F.col("conforming_count").cast("double").alias("good"),
            *[F.col(c).cast("double").alias(c) for c in counted],
            *[other.cast("double").alias(f"_else_{c}") for c, other in spread.items()],
        )
    )
    # two single rows: the measures that occur at all, and the baseline
    used = narrow.agg(F.lit(0.0).alias("_"), *[F.sum(c).alias(c) for c in counted]).first()
    base = baseline.first()
    per_batch = narrow.select(
        "batch_id",
        "total",
        "good",
        *[F.col(c if c in counted and (used[c] or 0.0) > 0 else f"_else_{c}").alias(c) for c in spread],
    )
    measures = ["total", "good", *spread]
    whole = per_batch.agg(*[F.sum(c).alias(c) for c in measures]).first()

    def rate(cost: str, measure: str) -> float:
        return base[cost] / max(1.0, whole[measure] or 0.0)

    reps = resampled_sums(per_batch, measures, ["batch_id"], n_boot, seed)
    costed = reps.select(
        "rep",
        F.greatest(F.lit(0.0), F.col("good")).alias("good_units"),
        F.lit(base["unit_price"]).alias("unit_price"),
        (F.col("total") * rate("material_cost", "total")).alias("material_cost"),
        F.lit(base["labor_cost"]).alias("labor_cost"),
        F.lit(base["overhead_cost"]).alias("overhead_cost"),
        (F.col("scrap_units") * rate("scrap_cost", "scrap_units")).alias("scrap_cost"),
        (F.col("rework_units") * rate("rework_cost", "rework_units")).alias("rework_cost"),
        (F.col("downtime_hours") * rate("downtime_cost", "downtime_hours")).alias("downtime_cost"),
    )
    pnl = calculate_economics(costed, ["rep"]).withColumn(
        "line_throughput", F.col("good_units") / F.lit(fv.SHIFT_HOURS)
    )
    margins = what_if(pnl, [scenario], ["rep"]).select((F.col("sim_margin") * 100.0).alias("m"))
    # one value per repetition, so the exact aggregate holds n_boot values at most
    levels = {"median": 0.5, "p10": 0.10, "p90": 0.90}
    fallback = margins.agg(
        *[F.coalesce(F.percentile("m", p), F.lit(base["margin"] * 100.0)).alias(c) for c, p in levels.items()]
    )
    return fallback.select(
        rounded(F.col("median"), 2).alias("median_margin_pct"),
        rounded(F.col("p10"), 2).alias("p10_margin_pct"),
        rounded(F.col("p90"), 2).alias("p90_margin_pct"),
        F.format_string("[%.1f%%, %.1f%%]", "p10", "p90").alias("range_str"),
        F.lit(fv.SIMULATED).alias("label"),
    )

"""P&L at plant and batch grain, scenarios and the bootstrap range."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantgauge.catalog.base import CTES, pick, query, r
from plantgauge.catalog.batches import table
from plantgauge.catalog.flow import stations
from plantgauge.operators import batch, economics, flow

N_BOOT = 1000
GRID = [(d, c, w) for d in (0.0, 10.0, 20.0, 50.0) for c in (0.0, 10.0) for w in (0.0, 15.0)]


def _pnl(source: str, keys: str) -> str:
    """``source`` gives units, scrap, rework, minutes, crew, hrs (and the keys)."""
    return f"""
SELECT {keys} units AS total_units_produced, scrap AS scrapped, rework AS reworked,
       {r('minutes', 1)} AS downtime_minutes, good AS good_units, unit_price,
       {r('good * unit_price', 2)} AS revenue, {r('mat', 2)} AS material_cost, {r('lab', 2)} AS labor_cost,
       {r('ovh', 2)} AS overhead_cost, {r('scr', 2)} AS scrap_cost, {r('rwk', 2)} AS rework_cost,
       {r('dwn', 2)} AS downtime_cost, {r('cost', 2)} AS cost, {r('good * unit_price - cost', 2)} AS profit,
       {r('CASE WHEN good * unit_price > 0 THEN (good * unit_price - cost) / (good * unit_price) ELSE 0.0::DOUBLE END', 4)} AS margin,
       {r('CASE WHEN good > 0 THEN cost / good ELSE 0.0::DOUBLE END', 2)} AS cost_per_good_unit,
       {r('scr + rwk + dwn', 2)} AS cost_of_poor_quality,
       {r(r('CASE WHEN good * unit_price > 0 THEN (good * unit_price - cost) / (good * unit_price) ELSE 0.0::DOUBLE END', 4) + ' * 100.0', 2)} AS gross_margin_pct
FROM (SELECT *, lab + mat + ovh + scr + rwk + dwn AS cost FROM (
        SELECT s.*, e.unit_price, greatest(0, units - scrap) AS good, units * e.material_cost AS mat,
               hrs * crew * e.labor_cost AS lab, hrs * e.overhead_cost AS ovh,
               scrap * e.scrap_cost AS scr, rework * e.rework_cost AS rwk,
               minutes / 60.0 * e.downtime_cost_per_hour AS dwn
        FROM ({source}) s, economic e))"""


def _plant(line: str, units: str) -> str:
    return _pnl(
        f"""SELECT ({units}) AS units, total_scrap AS scrap, total_rework AS rework,
                   downtime_hours * 60.0 AS minutes, CASE WHEN stations > 0 THEN stations * 2 ELSE 10 END AS crew,
                   hours AS hrs, line_throughput FROM {line}""",
        "line_throughput,",
    )


# scrap and rework of the view count pieces, and so do the units of most queries
CTES["plant_pnl"] = _plant("line_summary", "SELECT CAST(sum(units_in) AS BIGINT) FROM production")
CTES["plant_pnl_shift"] = _plant("line_summary_shift", "SELECT count(*) FROM inspection")
CTES["batch_pnl"] = _pnl(
    """SELECT batch_id, CAST(sum(units_in) AS BIGINT) AS units, CAST(sum(scrap_units) AS BIGINT) AS scrap,
              CAST(sum(rework_units) AS BIGINT) AS rework, sum(downtime_hours) * 60.0 AS minutes, 10 AS crew, 8.0::DOUBLE AS hrs
       FROM production GROUP BY batch_id""",
    "batch_id,",
)
PNL_DOUBLES = (
    "downtime_minutes unit_price revenue material_cost labor_cost overhead_cost scrap_cost rework_cost downtime_cost cost"
    " profit margin cost_per_good_unit cost_of_poor_quality gross_margin_pct"
)


def _what_if(source: str, keys: str) -> str:
    """``source`` gives the P&L columns, line_throughput and d, c, w in percent."""
    return f"""
SELECT {keys} d AS defect_reduction_pct, c AS capacity_boost_pct, w AS downtime_reduction_pct,
       line_throughput AS throughput, good_units, revenue, cost, profit, margin, cost_of_poor_quality AS copq,
       stp AS sim_throughput, sg AS sim_good_units, srev AS sim_revenue, scost AS sim_cost,
       {r('srev - scost', 2)} AS sim_profit,
       {r('CASE WHEN srev > 0 THEN ' + r('srev - scost', 2) + ' / srev ELSE 0.0::DOUBLE END', 4)} AS sim_margin,
       {r('CASE WHEN sg > 0 THEN scost / sg ELSE 0.0::DOUBLE END', 2)} AS sim_cost_per_good_unit,
       scopq AS sim_copq, {r('stp - line_throughput', 2)} AS throughput_delta, sg - good_units AS good_units_delta,
       {r('srev - revenue', 2)} AS revenue_delta, {r('scost - cost', 2)} AS cost_delta,
       {r(r('srev - scost', 2) + ' - profit', 2)} AS profit_delta,
       {r(r('CASE WHEN srev > 0 THEN ' + r('srev - scost', 2) + ' / srev ELSE 0.0::DOUBLE END', 4) + ' - margin', 4)} AS margin_delta,
       {r('scopq - cost_of_poor_quality', 2)} AS copq_delta, 'Simulated / advisory' AS label
FROM (SELECT *, {r('sg * unit_price', 2)} AS srev,
             {r('smat + labor_cost + overhead_cost + sscr + srwk + sdwn', 2)} AS scost, {r('sscr + srwk + sdwn', 2)} AS scopq
      FROM (SELECT *, CAST({r('good_units * ratio + saved * 0.5', 0)} AS BIGINT) AS sg, {r('material_cost * ratio', 2)} AS smat
            FROM (SELECT *, CASE WHEN line_throughput > 0 THEN stp / line_throughput ELSE 1.0::DOUBLE END AS ratio
                  FROM (SELECT *, {r('line_throughput * (1.0::DOUBLE + c / 100.0) * (1.0::DOUBLE + w / 100.0 * 0.10)', 2)} AS stp,
                               CASE WHEN good_units > 0 THEN scrap_cost * (1.0 - greatest(0.0::DOUBLE, 1.0 - d / 100.0)) /
                                    greatest(1.0::DOUBLE, scrap_cost / greatest(1, good_units)) ELSE 0.0::DOUBLE END AS saved,
                               {r('scrap_cost * greatest(0.0::DOUBLE, 1.0 - d / 100.0)', 2)} AS sscr,
                               {r('rework_cost * greatest(0.0::DOUBLE, 1.0 - d / 100.0)', 2)} AS srwk,
                               {r('downtime_cost * greatest(0.0::DOUBLE, 1.0 - w / 100.0)', 2)} AS sdwn
                        FROM ({source})))))"""


SCENARIOS = "(VALUES " + ", ".join(f"({d}::DOUBLE, {c}::DOUBLE, {w}::DOUBLE)" for d, c, w in GRID) + ") AS g(d, c, w)"
CTES["what_if"] = _what_if(f"SELECT p.*, g.* FROM plant_pnl p, {SCENARIOS}", "")
WHAT_IF_DOUBLES = (
    "defect_reduction_pct capacity_boost_pct downtime_reduction_pct throughput revenue cost profit margin copq"
    " sim_throughput sim_revenue sim_cost sim_profit sim_margin sim_cost_per_good_unit sim_copq throughput_delta"
    " revenue_delta cost_delta profit_delta margin_delta copq_delta"
)
RECOVERY = [(10.0, 0.0), (20.0, 5.0), (50.0, 10.0)]
CTES["recovery"] = _what_if(
    "SELECT p.* REPLACE (good_units / 8.0::DOUBLE AS line_throughput), g.d, g.c, g.d * 0.5 AS w FROM plant_pnl p, (VALUES "
    + ", ".join(f"({d}::DOUBLE, {c}::DOUBLE)" for d, c in RECOVERY)
    + ") AS g(d, c)",
    "",
)
CTES["boot_rows"] = """
SELECT row_number() OVER (ORDER BY batch_id) - 1 AS i, total_inspected::DOUBLE AS total, conforming_count::DOUBLE AS good,
       scrap_units::DOUBLE AS scrap, rework_units::DOUBLE AS rework, downtime_hours AS down FROM batch_table"""
CTES["boot_sums"] = f"""
SELECT rep, sum(total) AS total, sum(good) AS good, sum(scrap) AS scrap, sum(rework) AS rework, sum(down) AS down
FROM (SELECT rep, {pick("'42|' || rep || '|' || i", '(SELECT count(*) FROM boot_rows)')} AS i
      FROM boot_rows, (SELECT unnest(range({N_BOOT})) AS rep)) d JOIN boot_rows b ON d.i = b.i GROUP BY rep"""
CTES["boot_pnl"] = f"""
SELECT rep, CAST(good AS BIGINT) AS good_units, unit_price, CAST(good AS BIGINT) / 8.0::DOUBLE AS line_throughput,
       {r('good * unit_price', 2)} AS revenue, {r('mat', 2)} AS material_cost, labor_cost, overhead_cost,
       {r('scr', 2)} AS scrap_cost, {r('rwk', 2)} AS rework_cost, {r('dwn', 2)} AS downtime_cost, {r('cost', 2)} AS cost,
       {r('good * unit_price - cost', 2)} AS profit,
       {r('CASE WHEN good * unit_price > 0 THEN (good * unit_price - cost) / (good * unit_price) ELSE 0.0::DOUBLE END', 4)} AS margin,
       {r('scr + rwk + dwn', 2)} AS cost_of_poor_quality, 20.0::DOUBLE AS d, 10.0::DOUBLE AS c, 15.0::DOUBLE AS w
FROM (SELECT *, mat + labor_cost + overhead_cost + scr + rwk + dwn AS cost
      FROM (SELECT s.rep, s.good, p.unit_price, p.labor_cost, p.overhead_cost,
                   s.total * (p.material_cost / greatest(1.0::DOUBLE, a.total)) AS mat,
                   s.scrap * (p.scrap_cost / greatest(1.0::DOUBLE, a.scrap)) AS scr,
                   s.rework * (p.rework_cost / greatest(1.0::DOUBLE, a.rework)) AS rwk,
                   s.down * (p.downtime_cost / greatest(1.0::DOUBLE, a.down)) AS dwn
            FROM boot_sums s, plant_pnl p,
                 (SELECT sum(total) AS total, sum(scrap) AS scrap, sum(rework) AS rework, sum(down) AS down FROM boot_rows) a))"""
CTES["boot_margins"] = _what_if("SELECT * FROM boot_pnl", "rep,")


def plant(t):
    units = t.production.agg(F.sum("units_in").alias("total_units"))
    return economics.plant_pnl(flow.line_summary(stations(t)), units, t.economic)


@query(oracle="SELECT * FROM plant_pnl", doubles="line_throughput " + PNL_DOUBLES)
def pnl(t):
    return plant(t)


@query(oracle="SELECT * FROM plant_pnl_shift", doubles="line_throughput " + PNL_DOUBLES)
def pnl_reference_hours(t):
    """One shift of eight hours against the sums of all batches, on inspected units."""
    units = t.inspection.agg(F.count(F.lit(1)).alias("total_units"))
    return economics.plant_pnl(flow.line_summary(stations(t, None)), units, t.economic)


@query(oracle="SELECT * FROM batch_pnl", doubles=PNL_DOUBLES)
def pnl_by_batch(t):
    names = {"units_in": "total_units", "scrap_units": "scrap_units", "rework_units": "rework_units", "downtime_hours": "_h"}
    rows = batch.production_sums(t.production, names).withColumn("downtime_minutes", F.col("_h") * 60.0)
    return economics.calculate_pnl(rows, t.economic, ["batch_id"])


@query(
    oracle="""SELECT position, disruption, cost, cost / NULLIF(sum(cost) OVER (), 0) AS share
              FROM (SELECT unnest([0, 1, 2]) AS position,
                           unnest(['Scrap Waste', 'Rework Labor/Parts', 'Downtime Penalties']) AS disruption,
                           unnest([scrap_cost, rework_cost, downtime_cost]) AS cost FROM plant_pnl)""",
    doubles="cost share",
)
def copq_breakdown(t):
    return economics.copq_breakdown(plant(t))


@query(
    oracle="""SELECT unnest(range(8))::INTEGER AS position,
                     unnest(['Gross Revenue', 'Material', 'Labor', 'Overhead', 'Scrap Cost', 'Rework Cost', 'Downtime Cost',
                             'Operating Profit']) AS step,
                     unnest([revenue, -material_cost, -labor_cost, -overhead_cost, -scrap_cost, -rework_cost,
                             -downtime_cost, profit]) AS amount FROM plant_pnl""",
    doubles="amount",
)
def pnl_waterfall(t):
    return economics.waterfall(plant(t))


@query(oracle="SELECT * FROM what_if", doubles=WHAT_IF_DOUBLES)
def what_if_grid(t):
    return economics.what_if(plant(t), GRID)


@query(
    oracle=f"""SELECT defect_reduction_pct, capacity_boost_pct AS throughput_increase_pct, profit AS baseline_profit,
                      sim_profit AS simulated_profit, profit_delta AS profit_gain, {r('margin * 100.0', 2)} AS baseline_margin,
                      {r('sim_margin * 100.0', 2)} AS simulated_margin, {r('margin_delta * 100.0', 2)} AS margin_gain_points,
                      {r('-cost_delta', 2)} AS cost_savings, label FROM recovery""",
    doubles="defect_reduction_pct throughput_increase_pct baseline_profit simulated_profit profit_gain baseline_margin"
    " simulated_margin margin_gain_points cost_savings",
)
def margin_recovery(t):
    return economics.margin_recovery(plant(t), RECOVERY)


@query(
    oracle=f"""SELECT {r('quantile_cont(sim_margin * 100.0, 0.5)', 2)} AS median_margin_pct,
                      {r('quantile_cont(sim_margin * 100.0, 0.1)', 2)} AS p10_margin_pct,
                      {r('quantile_cont(sim_margin * 100.0, 0.9)', 2)} AS p90_margin_pct,
                      printf('[%.1f%%, %.1f%%]', quantile_cont(sim_margin * 100.0, 0.1),
                             quantile_cont(sim_margin * 100.0, 0.9)) AS range_str,
                      'Simulated / advisory' AS label FROM boot_margins""",
    doubles="median_margin_pct p10_margin_pct p90_margin_pct",
)
def bootstrap_margin(t):
    return economics.bootstrap_what_if_margin(table(t), plant(t), (20.0, 10.0, 15.0), N_BOOT)

"""Stations, bottleneck and line figures."""

from __future__ import annotations

from plantgauge.catalog.base import CTES, query, r
from plantgauge.operators import flow

# per batch and station (one shift each), and per station over all shifts of the line
CTES["rolled"] = """
SELECT station, avg(cycle_time) AS cycle_time, sum(downtime_hours) AS downtime_hours, sum(units_in) AS units_in,
       sum(units_out) AS units_out, sum(rework_units) AS rework_units, sum(scrap_units) AS scrap_units, avg(wip) AS wip,
       8.0::DOUBLE * (SELECT count(DISTINCT batch_id) FROM production) AS hours
FROM production GROUP BY station"""


def _metrics(source: str, keys: str, hours: str) -> str:
    return f"""
SELECT {keys} station, hours, {r('ct', 4)} AS cycle_time, {r('dt', 4)} AS downtime_fraction,
       {r('cap', 2)} AS effective_capacity, CAST(uin AS BIGINT) AS units_in, CAST(uout AS BIGINT) AS units_out,
       CAST(rw AS BIGINT) AS rework_units, CAST(sc AS BIGINT) AS scrap_units, {r('rr', 4)} AS rework_rate,
       {r('uin * (1.0 + rr)', 2)} AS effective_load,
       {r('CASE WHEN cap * hours > 0 THEN uin * (1.0 + rr) / (cap * hours) ELSE 0.0::DOUBLE END', 4)} AS utilization,
       CAST(floor(wip) AS BIGINT) AS wip
FROM (SELECT *, (60.0::DOUBLE / ct) * (1.0 - dt) AS cap, CASE WHEN uout > 0 THEN rw / uout ELSE 0.0::DOUBLE END AS rr
      FROM (SELECT {keys} station, {hours} AS hours,
                   CASE WHEN cycle_time > 10 THEN cycle_time / 60.0 ELSE greatest(cycle_time, 1e-4) END AS ct,
                   least(1.0::DOUBLE, greatest(0.0::DOUBLE, downtime_hours / greatest({hours}, 1e-4))) AS dt,
                   CAST(units_in AS DOUBLE) AS uin, CAST(units_out AS DOUBLE) AS uout,
                   CAST(rework_units AS DOUBLE) AS rw, CAST(scrap_units AS DOUBLE) AS sc, wip
            FROM {source}))"""


CTES["station_metrics"] = _metrics("rolled", "", "hours")
CTES["station_metrics_shift"] = _metrics("rolled", "", "8.0::DOUBLE")
CTES["batch_station_metrics"] = _metrics("production", "batch_id,", "8.0::DOUBLE")
WORST = "row_number() OVER (%s ORDER BY utilization DESC, wip DESC, cycle_time DESC, station)"
CTES["worst_station"] = f"SELECT * EXCLUDE (k) FROM (SELECT *, {WORST % ''} AS k FROM station_metrics) WHERE k = 1"
CTES["worst_station_shift"] = CTES["worst_station"].replace("station_metrics", "station_metrics_shift")
CTES["worst_by_batch"] = (
    f"SELECT * EXCLUDE (k) FROM (SELECT *, {WORST % 'PARTITION BY batch_id'} AS k FROM batch_station_metrics) WHERE k = 1"
)
CTES["line_summary"] = f"""
SELECT b.station AS bottleneck_station, b.utilization, b.wip, b.rework_rate,
       printf('%s: utilization %.0f%%, WIP %d, rework adds %.0f%% extra load',
              b.station, b.utilization * 100.0, b.wip, b.rework_rate * 100.0) AS bottleneck_evidence,
       effective_capacity AS line_throughput, effective_capacity AS throughput_without_rework,
       {r('effective_capacity / (1.0 + b.rework_rate)', 2)} AS throughput_with_rework,
       {r('effective_capacity - effective_capacity / (1.0 + b.rework_rate)', 2)} AS throughput_lost_due_to_rework,
       total_wip, total_scrap, total_rework, stations, t.hours, t.downtime_hours, total_line_cycle_time_sec
FROM worst_station b,
     (SELECT CAST(sum(wip) AS BIGINT) AS total_wip, CAST(sum(scrap_units) AS BIGINT) AS total_scrap,
             CAST(sum(rework_units) AS BIGINT) AS total_rework, count(*) AS stations,
             sum(downtime_fraction * hours) AS downtime_hours, max(hours) AS hours,
             sum({r('cycle_time * 60.0', 1)}) AS total_line_cycle_time_sec FROM station_metrics) t"""

CTES["line_summary_shift"] = CTES["line_summary"].replace("worst_station", "worst_station_shift").replace("station_metrics", "station_metrics_shift")

METRIC_DOUBLES = "hours cycle_time downtime_fraction effective_capacity rework_rate effective_load utilization"


def stations(t, hours_per_batch=8.0):
    return flow.station_metrics(flow.station_rollup(t.production, hours_per_batch=hours_per_batch))


@query(oracle="SELECT * FROM station_metrics_shift", doubles=METRIC_DOUBLES)
def station_metrics_reference_hours(t):
    """One shift of eight hours against the sums of all batches."""
    return stations(t, None)


@query(oracle="SELECT * FROM station_metrics", doubles=METRIC_DOUBLES)
def station_metrics(t):
    return stations(t)


@query(oracle="SELECT * FROM batch_station_metrics", doubles=METRIC_DOUBLES)
def station_metrics_by_batch(t):
    return flow.station_metrics(t.production, by=["batch_id"])


@query(
    oracle="SELECT * FROM worst_station",
    doubles=METRIC_DOUBLES,
)
def bottleneck(t):
    return flow.bottleneck(stations(t))


@query(
    oracle="SELECT * FROM worst_by_batch",
    doubles=METRIC_DOUBLES,
)
def bottleneck_by_batch(t):
    return flow.bottleneck(flow.station_metrics(t.production, by=["batch_id"]), by=["batch_id"])


@query(
    oracle="SELECT * FROM line_summary",
    doubles="utilization rework_rate line_throughput throughput_without_rework throughput_with_rework"
    " throughput_lost_due_to_rework hours downtime_hours total_line_cycle_time_sec",
)
def line_summary(t):
    return flow.line_summary(stations(t))


@query(
    oracle=f"""SELECT line_throughput, {r('total_line_cycle_time_sec', 1)} AS total_line_cycle_time_sec,
                      total_wip AS total_actual_wip,
                      {r('line_throughput * (total_line_cycle_time_sec / 3600.0)', 1)} AS littles_law_expected_wip,
                      {r('total_wip - line_throughput * (total_line_cycle_time_sec / 3600.0)', 1)} AS wip_sanity_delta
               FROM line_summary""",
    doubles="line_throughput total_line_cycle_time_sec littles_law_expected_wip wip_sanity_delta",
)
def littles_law(t):
    return flow.littles_law(flow.line_summary(stations(t)))


@query(
    oracle=f"""SELECT station, {r('utilization * 100.0 / (1.0 + rework_rate)', 1)} AS nominal_utilization_pct,
                      {r('utilization * 100.0 - utilization * 100.0 / (1.0 + rework_rate)', 1)} AS rework_utilization_pct
               FROM station_metrics""",
    doubles="nominal_utilization_pct rework_utilization_pct",
)
def utilization_split(t):
    return flow.utilization_split(stations(t))


@query(
    oracle=f"""SELECT s.station, {r('60.0::DOUBLE / greatest(1e-4, s.cycle_time)', 1)} AS nominal_capacity_uph,
                      s.effective_capacity AS effective_capacity_uph, {r('s.cycle_time * 60.0', 1)} AS cycle_time_sec,
                      s.wip AS wip_count, {r('s.downtime_fraction * s.hours * 60.0', 1)} AS downtime_min,
                      s.rework_units AS rework_count,
                      {r('least(100.0::DOUBLE, s.units_in / greatest(1.0::DOUBLE, s.effective_capacity * s.hours) * 100.0)', 1)}
                        AS nominal_utilization_pct,
                      {r('s.rework_rate * 100.0', 1)} AS rework_utilization_add,
                      {r('s.utilization * 100.0', 1)} AS total_effective_utilization_pct,
                      greatest(0.0::DOUBLE, {r('s.effective_capacity - s.effective_load / s.hours', 1)}) AS headroom_uph,
                      s.station = w.station AS is_bottleneck
               FROM station_metrics s, worst_station w""",
    doubles="nominal_capacity_uph effective_capacity_uph cycle_time_sec downtime_min nominal_utilization_pct"
    " rework_utilization_add total_effective_utilization_pct headroom_uph",
)
def station_kpis(t):
    return flow.station_kpis(stations(t))

"""The whole plant in one run: batches, stations, money, factors, findings.

Results that several others need (stations, line, P&L, batch table) are settled
once in the shared folder; the rest is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from plantgauge import fixed_values as fv
from plantgauge.operators import association, batch, economics, evaluation, flow, insights
from plantgauge.session import cut_lineage


@dataclass
class PlantReport:
    """``scored`` is an optional frame with actual, predicted, confidence, correct.

    ``units`` is one row with total_units; without it the inspected units count.
    """

    inspection: DataFrame
    process: DataFrame
    production: DataFrame
    economic: DataFrame | None = None
    scored: DataFrame | None = None
    units: DataFrame | None = None
    parameters: Sequence[str] | None = None
    categories: Sequence[str] | None = None
    hours: float = fv.SHIFT_HOURS
    hours_per_batch: float | None = None

    @cached_property
    def stations(self) -> DataFrame:
        rolled = flow.station_rollup(self.production, hours=self.hours, hours_per_batch=self.hours_per_batch)
        return cut_lineage(flow.station_metrics(rolled))

    @cached_property
    def line(self) -> DataFrame:
        return cut_lineage(flow.line_summary(self.stations))

    @cached_property
    def pnl(self) -> DataFrame:
        units = self.units
        if units is None:
            units = self.inspection.agg(F.count(F.lit(1)).alias("total_units"))
        return cut_lineage(economics.plant_pnl(self.line, units, self.economic))

    @cached_property
    def batches(self) -> DataFrame:
        return cut_lineage(batch.batch_table(self.inspection, self.process, self.production, self.categories))

    @cached_property
    def ranked(self) -> DataFrame:
        return association.ranked_factors(association.overall_pairs(self.batches, self.parameters))

    def factors(self, n_boot: int = 1000) -> DataFrame:
        return association.analyze_factors(self.batches, self.parameters, n_boot)

    def families(self, n_boot: int = 1000) -> DataFrame:
        rates = batch.category_counts_by_batch(self.inspection) if batch.category_column(self.inspection) else None
        return association.analyze_families(self.batches, self.parameters, n_boot, rates)

    def affected_batches(self) -> DataFrame:
        return association.affected_batches(association.overall_pairs(self.batches, self.parameters))

    def category_correlations(self) -> DataFrame:
        rates = batch.category_counts_by_batch(self.inspection)
        return association.category_correlations(association.family_pairs(self.batches, self.parameters, rates))

    def what_if(self, scenarios: Sequence[tuple[float, float, float]]) -> DataFrame:
        return economics.what_if(self.pnl, scenarios)

    def what_if_range(self, scenario: tuple[float, float, float], n_boot: int = 1000, seed: int = 42) -> DataFrame:
        return economics.bootstrap_what_if_margin(self.batches, self.pnl, scenario, n_boot, seed)

    @cached_property
    def quality(self) -> DataFrame | None:
        if self.scored is None:
            return None
        rates = evaluation.binary_rates(evaluation.confusion_counts(self.scored))
        sure = evaluation.selective_metrics(self.scored).select("uncertain_count", "uncertain_fraction")
        row = sure.select(F.struct("*")).scalar()
        return rates.withColumns({c: row[c] for c in sure.columns})

    @cached_property
    def facts(self) -> DataFrame:
        parts = {
            "quality_family": insights.top_defect_family(self.inspection),
            "factor": insights.top_factor(self.ranked),
            "flow": insights.flow_facts(self.line),
            "economics": insights.economics_facts(self.pnl),
        }
        if self.quality is not None:
            parts["quality"] = insights.quality_facts(self.quality)
        return cut_lineage(insights.gather(self.inspection.sparkSession, **parts))

    def insights(self) -> DataFrame:
        return insights.computed_insights(self.facts)

    def impact_chain(self) -> DataFrame:
        return insights.impact_chain(self.facts)

    def narrative(self) -> DataFrame:
        return insights.impact_narrative(self.facts)

    def advisories(self) -> DataFrame:
        return insights.advisories(self.facts)

    def kpis(self) -> DataFrame:
        known = insights.gather(
            self.inspection.sparkSession, flow=insights.flow_facts(self.line), economics=insights.economics_facts(self.pnl)
        )
        return insights.kpi_row(known, self.inspection)

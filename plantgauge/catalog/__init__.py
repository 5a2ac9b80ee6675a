"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from plantgauge.catalog.base import ORACLES, QUERIES
from plantgauge.catalog import (  # noqa: F401  (importing registers)
    association,
    batches,
    cleaning,
    economics,
    evaluation,
    flow,
    hypothesis,
    insights,
    margins,
    messy,
    models,
    routing,
    splits,
    timeline,
    vectors,
    conditions,
)

__all__ = ["ORACLES", "QUERIES"]

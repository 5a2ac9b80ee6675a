"""Time the headline queries: one warm-up, then the median of three runs.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and threads,
BENCH_QUERIES a comma-separated subset, BENCH_RUNS the number of timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plantgauge.catalog import QUERIES  # noqa: E402
from plantgauge.session import local_session  # noqa: E402

HEADLINE = [
    "schema_remap_clean", "impute_median", "batch_quality", "batch_table", "batch_replay", "drift_profile",
    "source_stats_process", "station_kpis", "line_summary", "pnl", "what_if_grid", "bootstrap_margin",
    "spearman_factors", "mann_whitney_u", "bootstrap_rho_ci", "family_matrix", "roc_auc", "ece_bins", "cost_threshold",
    "coverage_curve", "condition_eval", "stratified_split", "knn_novelty", "bank_anomaly", "vector_perturb",
    "tabular_features", "triage_counts", "impact_chain", "kpi_row", "logreg_embeddings", "stream_running_defects",
]


def run(spark, name: str, folder: str) -> float:
    """Seconds until every column of every row has been produced."""
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    times: dict[str, float] = {}
    for name in names:
        run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()

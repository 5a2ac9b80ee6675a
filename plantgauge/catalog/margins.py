"""The margin model: leave-one-batch-out validation and attributions."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from plantgauge.catalog.base import CTES, query
from plantgauge.operators import attribution, margin_model
from plantgauge.operators.economics import economic_params
from plantgauge.operators.margin_model import FEATURES, RIDGE

CTES["unit_margins"] = """
SELECT station, p.batch_id, cycle_time, wip / units_in::DOUBLE AS wip_share, rework_units / units_in::DOUBLE AS rework_share, temperature,
       (units_out * unit_price - units_in * material_cost - scrap_units * scrap_cost - rework_units * e.rework_cost
        - downtime_hours * downtime_cost_per_hour) / units_in::DOUBLE AS margin
FROM production p JOIN (SELECT batch_id, avg(temperature) AS temperature FROM process GROUP BY batch_id HAVING avg(temperature) IS NOT NULL) t
     ON p.batch_id = t.batch_id, economic e WHERE units_in > 0"""

# the fits of all folds in SQL: sums of products about the means, all less one, and the
# elimination of the unknowns one after the other
_P = len(FEATURES)
_NAMES = [*FEATURES, "margin"]
_PAIRS = [(i, j) for i in range(_P + 1) for j in range(i, _P + 1)]


def _pair(i: int, j: int) -> str:
    return f"{min(i, j)}_{max(i, j)}"


CTES["fold_rows"] = "SELECT batch_id, " + ", ".join(f"{n} - avg({n}) OVER () AS z{i}" for i, n in enumerate(_NAMES)) + ", avg(margin) OVER () AS centre FROM unit_margins"
CTES["fold_own"] = (
    "SELECT batch_id, any_value(centre) AS centre, count(*)::DOUBLE AS n, "
    + ", ".join(f"sum(z{i}) AS s{i}" for i in range(_P + 1)) + ", "
    + ", ".join(f"sum(z{i} * z{j}) AS q{i}_{j}" for i, j in _PAIRS) + " FROM fold_rows GROUP BY batch_id"
)
CTES["fold_rest"] = (
    "SELECT *, sum(n) OVER () - n AS m, " + ", ".join(f"sum(s{i}) OVER () - s{i} AS rs{i}" for i in range(_P + 1)) + ", "
    + ", ".join(f"sum(q{i}_{j}) OVER () - q{i}_{j} AS rq{i}_{j}" for i, j in _PAIRS) + " FROM fold_own"
)
CTES["fold_spread"] = "SELECT *, " + ", ".join(f"sqrt(rq{i}_{i} / m - rs{i} / m * rs{i} / m) AS d{i}" for i in range(_P)) + " FROM fold_rest"
CTES["fold_a0"] = (
    "SELECT *, " + ", ".join(
        f"(rq{_pair(i, j)} / m - rs{i} / m * rs{j} / m) / d{i} / d{j} + {RIDGE if i == j else 0.0} AS a{i}_{j}" for i in range(_P) for j in range(_P)
    ) + ", " + ", ".join(f"(rq{i}_{_P} / m - rs{i} / m * rs{_P} / m) / d{i} AS a{i}_{_P}" for i in range(_P)) + " FROM fold_spread"
)
for _k in range(_P):
    _swaps = [f"a{i}_{j} - a{i}_{_k} * a{_k}_{j} / a{_k}_{_k} AS a{i}_{j}" for i in range(_P) if i != _k for j in range(_k, _P + 1)]
    CTES[f"fold_a{_k + 1}"] = f"SELECT * REPLACE ({', '.join(_swaps)}) FROM fold_a{_k}"
CTES["fold_fit"] = "SELECT *, " + ", ".join(f"a{i}_{_P} / a{i}_{i} / d{i} AS w{i}" for i in range(_P)) + f" FROM fold_a{_P}"
CTES["fold_line"] = f"SELECT *, rs{_P} / m - ({' + '.join(f'w{i} * rs{i} / m' for i in range(_P))}) AS c FROM fold_fit"
_LINEAR = " + ".join(f"w{i} * s{i}" for i in range(_P))
_SSE = (
    f"q{_P}_{_P} + c * c * n - 2 * c * s{_P} + 2 * c * ({_LINEAR}) - 2 * ({' + '.join(f'w{i} * q{i}_{_P}' for i in range(_P))}) + "
    + " + ".join(f"w{i} * w{j} * q{_pair(i, j)}" for i in range(_P) for j in range(_P))
)
CTES["folds"] = f"""
SELECT batch_id, n::BIGINT AS n, {', '.join(f'w{i} AS w_{f}' for i, f in enumerate(FEATURES))}, s{_P} / n + centre AS actual,
       c + ({_LINEAR}) / n + centre AS predicted, {_SSE} AS sse, q{_P}_{_P} AS sst FROM fold_line"""


def rows(t):
    return margin_model.unit_margins(t.production, t.process, economic_params(t.economic))


def folds(t):
    return margin_model.leave_one_out(rows(t), "batch_id", FEATURES, "margin")


@query(
    oracle="SELECT * EXCLUDE (sse, sst), sqrt(greatest(0.0, sse) / n) AS rmse FROM folds",
    doubles=" ".join(f"w_{f}" for f in FEATURES) + " actual predicted rmse",
)
def lobo_margin(t):
    """Every batch judged by the fit on all others."""
    weights = [F.get("weights", F.lit(i)).alias(f"w_{f}") for i, f in enumerate(FEATURES)]
    return folds(t).select("batch_id", "n", *weights, "actual", "predicted", "rmse")


@query(
    oracle="""SELECT count(*) AS folds, sum(n)::BIGINT AS n, sqrt(sum(sse) / sum(n)) AS rmse, avg(abs(actual - predicted)) AS mean_gap,
                     1.0 - sum(sse) / sum(sst) AS r_squared FROM folds""",
    doubles="rmse mean_gap r_squared",
)
def lobo_summary(t):
    return margin_model.fold_summary(folds(t))


@query(oracle=f"SELECT station, batch_id, {_P} AS n_attributions, 0.0::DOUBLE AS gap FROM unit_margins", doubles="gap")
def margin_attribution(t):
    """What a boosted margin model owes to each feature of every station run: base and
    attributions add up to the prediction."""
    data = rows(t).select("station", "batch_id", *FEATURES, "margin")
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data)
    model = GBTRegressor(featuresCol="features", labelCol="margin", maxDepth=4, maxIter=20, stepSize=0.2, seed=7).fit(assembled)
    scored = attribution.attributed(model.transform(assembled), FEATURES, model)
    total = F.aggregate("attributions", F.col("base"), lambda a, b: a + b)
    gap = F.round(F.abs(total - F.col("prediction")) / (1.0 + F.abs(F.col("prediction"))), 6)
    return scored.select("station", "batch_id", F.size("attributions").alias("n_attributions"), gap.alias("gap"))

"""Ridge regression of the margin, validated by leaving one batch out at a time.

One pass adds up the products of all features per batch. Every fold is the sum of all batches
less one, so all fits and their errors follow from these tables: no row is read again,
and what travels has one row per batch and one number per pair of features.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

RIDGE = 0.1


def unit_margins(production: DataFrame, process: DataFrame, economic: dict[str, Column], telemetry: str = "temperature") -> DataFrame:
    """station, batch_id, four features and the margin per piece of every station run.

    Rows without pieces, or whose batch has no reading, are left out.
    """
    pieces = F.col("units_in").cast("double")
    means = process.groupBy("batch_id").agg(F.avg(telemetry).alias(telemetry)).where(F.col(telemetry).isNotNull())
    margin = (
        F.col("units_out") * economic["unit_price"]
        - pieces * economic["material_cost"]
        - F.col("scrap_units") * economic["scrap_cost"]
        - F.col("rework_units") * economic["rework_cost"]
        - F.col("downtime_hours") * economic["downtime_cost_per_hour"]
    ) / pieces
    rows = production.where(F.col("units_in") > 0).join(means, "batch_id")
    return rows.select(
        "station", "batch_id", "cycle_time", (F.col("wip") / pieces).alias("wip_share"),
        (F.col("rework_units") / pieces).alias("rework_share"), telemetry, margin.alias("margin"),
    )


FEATURES = ["cycle_time", "wip_share", "rework_share", "temperature"]


def product_sums(df: DataFrame, key: str, features: Sequence[str], target: str) -> DataFrame:
    """key, gram: sums of products of (1, features, target) about their overall means, as the
    upper triangle by rows. Rows with a null among them are left out."""
    names = [*features, target]
    whole = df.where(F.col(key).isNotNull())
    for n in names:
        whole = whole.where(F.col(n).isNotNull())
    centre = whole.select(F.struct(*[F.avg(n).alias(n) for n in names])).scalar()
    z = [F.lit(1.0), *[F.col(n).cast("double") - centre[n] for n in names]]
    moved = whole.select(key, *[c.alias(f"_z{i}") for i, c in enumerate(z)])
    sums = [F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")) for i in range(len(z)) for j in range(i, len(z))]
    return moved.groupBy(key).agg(F.array(*sums).alias("gram"))


def _folds(p: int, ridge: float):
    width = p + 2

    @F.pandas_udf("n long, intercept double, weights array<double>, actual double, predicted double, sse double")
    def solve(own: pd.Series, total: pd.Series) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        upper = np.triu_indices(width)

        def square(column):
            out = np.zeros((len(column), width, width))
            out[:, upper[0], upper[1]] = np.stack(column.to_numpy())
            return out + np.triu(out, 1).transpose(0, 2, 1)

        mine = square(own)
        rest = square(total) - mine
        n = np.round(rest[:, 0, 0])
        some = n > 0
        safe = np.where(some, n, 1.0)[:, None]
        mean = rest[:, 0, 1:] / safe
        cov = rest[:, 1:, 1:] / safe[:, :, None] - mean[:, :, None] * mean[:, None, :]
        scale = np.sqrt(np.maximum(cov[:, range(p), range(p)], 0.0))
        scale[scale <= 1e-12 * (1.0 + np.abs(mean[:, :p]))] = np.inf  # a constant feature has no weight
        left = cov[:, :p, :p] / scale[:, :, None] / scale[:, None, :] + ridge * np.eye(p)
        weights = np.linalg.solve(left, (cov[:, :p, p] / scale)[:, :, None])[:, :, 0] / scale
        intercept = mean[:, p] - (weights * mean[:, :p]).sum(axis=1)
        w = np.concatenate([-intercept[:, None], -weights, np.ones((len(n), 1))], axis=1)
        sse = np.maximum(0.0, np.einsum("bi,bij,bj->b", w, mine, w))
        count = mine[:, 0, 0]
        actual = mine[:, 0, p + 1] / count
        predicted = actual - np.einsum("bj,bj->b", w, mine[:, 0, :]) / count
        blank = lambda v: np.where(some, v, np.nan)
        return pd.DataFrame(
            {
                "n": np.round(count).astype("int64"), "intercept": blank(intercept),
                "weights": [list(v) if ok else None for v, ok in zip(weights, some)],
                "actual": actual, "predicted": blank(predicted), "sse": blank(sse),
            }
        )

    return solve


def leave_one_out(df: DataFrame, key: str, features: Sequence[str], target: str, ridge: float = RIDGE) -> DataFrame:
    """Every key judged by the ridge fit on all others: key, n, weights, actual and predicted mean,
    rmse, and the sums sse and sst (about the mean of all rows).

    Features are scaled by their spread in the fold; one that is constant there has weight 0.
    A single key has nothing to be fitted on: its prediction is null. An empty table gives no
    row.
    """
    grams = product_sums(df, key, features, target)
    width = len(features) + 2
    cells = width * (width + 1) // 2
    total = grams.select(F.array(*[F.sum(F.get("gram", F.lit(i))) for i in range(cells)])).scalar()
    names = [*features, target]
    centre = df.where(F.col(key).isNotNull())
    for n in names:
        centre = centre.where(F.col(n).isNotNull())
    mean = centre.select(F.avg(target)).scalar()
    fit = _folds(len(features), ridge)(F.col("gram"), total)
    out = grams.withColumn("fit", fit)
    ok = ~F.isnan("fit.sse")
    return out.select(
        key,
        F.col("fit.n").alias("n"),
        F.col("fit.weights").alias("weights"),
        (F.col("fit.actual") + mean).alias("actual"),
        F.when(ok, F.col("fit.predicted") + mean).alias("predicted"),
        F.when(ok, F.sqrt(F.col("fit.sse") / F.col("fit.n"))).alias("rmse"),
        F.when(ok, F.col("fit.sse")).alias("sse"),
        F.get("gram", F.lit(cells - 1)).alias("sst"),
    )


def fold_summary(folds: DataFrame) -> DataFrame:
    """One row: keys, rows, rmse, mean absolute error of the keys' means and R squared over all folds."""
    sse, sst = F.sum("sse"), F.sum("sst")
    out = folds.where(F.col("sse").isNotNull()).agg(
        F.count(F.lit(1)).alias("folds"), F.sum("n").alias("n"), F.sqrt(sse / F.sum("n")).alias("rmse"),
        F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mean_gap"),
        F.when(sst > 0, 1.0 - sse / sst).alias("r_squared"),
    )
    return out.where(F.col("folds") > 0)

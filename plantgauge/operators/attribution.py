"""What a forest or boosted model owes to each feature: exact path-dependent Shapley values.

A leaf is a box: per feature on its path an interval, and the share of training rows that
passed the splits on that feature. With the features of a set S known, the leaf is reached
with the product of (inside the interval) over S and of the shares over the rest. Shapley
values of one leaf then need only its own features, and a model's are the sums over leaves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.base import Model
from pyspark.sql import DataFrame, functions as F, types as T

from plantgauge.session import fresh_folder


@dataclass
class Leaf:
    value: float
    # feature -> (above, up to and including, share of training rows)
    sides: dict[int, tuple[float, float, float]]


def model_leaves(spark, model: Model) -> list[Leaf]:
    """The weighted leaves of a saved tree model, read from its stored nodes.

    The model, not the data, bounds what the driver holds. Splits must be on continuous
    features.
    """
    path = fresh_folder(spark, "trees")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    if "nodeData" not in stored.columns:  # a single tree
        stored = stored.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    trees: dict[int, dict[int, T.Row]] = defaultdict(dict)
    for r in stored.select("treeID", "nodeData").collect():
        trees[r["treeID"]][r["nodeData"]["id"]] = r["nodeData"]
    weights = list(getattr(model, "treeWeights", [1.0]))
    if type(model).__name__.startswith("RandomForest"):
        weights = [1.0 / len(trees)] * len(trees)
    out: list[Leaf] = []
    for tree in sorted(trees):
        nodes = trees[tree]
        todo = [(0, {})]
        while todo:
            at, sides = todo.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                out.append(Leaf(weights[tree] * node["prediction"], sides))
                continue
            split = node["split"]
            if split["numCategories"] != -1:
                raise ValueError("splits on categories are not supported")
            feature, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high, share = sides.get(feature, (-math.inf, math.inf, 1.0))
            for child, bounds in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
                part = nodes[child]["rawCount"] / node["rawCount"]
                todo.append((child, {**sides, feature: (*bounds, share * part)}))
    return out


def expected_value(leaves: Sequence[Leaf]) -> float:
    """The model's output with no feature known."""
    return sum(leaf.value * math.prod(s[2] for s in leaf.sides.values()) for leaf in leaves)


def shapley_of(leaves: Sequence[Leaf]):
    """A function from an array (rows by features) to attributions of the same shape.

    The sizes of the sets S are the powers of a polynomial with the factors (share + inside * t)
    of the other features of the leaf. The function is a closure over plain numbers, so
    executors need no copy of this package.
    """
    table = [(leaf.value, [(f, *s) for f, s in leaf.sides.items()]) for leaf in leaves]
    sizes = {len(sides) for _, sides in table}
    weights = {m: [1.0 / (m * math.comb(m - 1, k)) for k in range(m)] for m in sizes}

    def shapley(x):
        import numpy as np

        out = np.zeros(x.shape)
        for value, sides in table:
            m = len(sides)
            inside = [((x[:, f] > a) & (x[:, f] <= b)).astype(float) for f, a, b, _ in sides]
            for j, (feature, _, _, share) in enumerate(sides):
                sets = [np.ones(len(x))] + [np.zeros(len(x)) for _ in range(m - 1)]
                for i, (_, _, _, other) in enumerate(sides):
                    if i != j:
                        for k in range(m - 1, 0, -1):
                            sets[k] = sets[k] * other + sets[k - 1] * inside[i]
                        sets[0] = sets[0] * other
                reached = sum(w * s for w, s in zip(weights[m], sets))
                out[:, feature] += value * (inside[j] - share) * reached
        return out

    return shapley


def attributed(df: DataFrame, features: Sequence[str], model: Model, name: str = "attributions") -> DataFrame:
    """``df`` with ``base`` (output with nothing known) and one attribution per feature; base and
    attributions add up to the prediction. A column called ``name`` or base is replaced; rows
    with a null feature have null attributions.
    """
    leaves = model_leaves(df.sparkSession, model)
    shapley = shapley_of(leaves)

    @F.pandas_udf("array<double>")
    def values(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        import numpy as np
        import pandas as pd

        for batch in columns:
            x = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in batch], axis=1)
            blank = np.isnan(x).any(axis=1)
            yield pd.Series([None if b else list(r) for r, b in zip(shapley(x), blank)], dtype=object)

    columns = [F.col(f).cast("double") for f in features]
    return df.withColumns({"base": F.lit(expected_value(leaves)), name: values(*columns)})

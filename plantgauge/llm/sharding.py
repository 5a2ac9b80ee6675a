"""Sharding by a hypergeometric communication matrix.

Every source partition permutes its rows locally, sends each shard an exact
number of them, and every shard permutes what it received. The counts of
partition p to shard s are drawn from the multivariate hypergeometric law of a
uniform permutation cut at the shard bounds, so the whole is a uniform shuffle,
and each shard ends with exactly its share: sizes differ by one row at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from plantgauge.llm.common import keeps_names, stored

# rows of one block of a shard, permuted in one task
BLOCK_ROWS = 200_000
OWN = ("_hg_part", "_hg_rank", "_hg_draw", "_hg_block")


def shard_sizes(rows: int, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Exact rows per shard; which shards take the odd rows is drawn."""
    sizes = np.full(shards, rows // shards, dtype=np.int64)
    sizes[rng.permutation(shards)[: rows % shards]] += 1
    return sizes


def communication_matrix(parts: list[int], shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that partition p sends to shard s, and the shard sizes. Row sums are
    ``parts``, column sums the sizes."""
    rng = np.random.default_rng(seed)
    sizes = shard_sizes(int(sum(parts)), shards, rng)
    left = sizes.copy()
    matrix = np.zeros((len(parts), shards), dtype=np.int64)
    for p, rows in enumerate(parts):
        matrix[p] = rng.multivariate_hypergeometric(left, rows, method="marginals") if rows else 0
        left -= matrix[p]
    return matrix, sizes


@keeps_names("_hg_")
def hypergeometric_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in
    each shard), uniform over all assignments with exact shard sizes.

    The driver sees one count per source partition. Rows are moved once by
    (shard, block of the shard), a block holding about ``BLOCK_ROWS`` rows, so no
    key and no shard is a task of its own. Columns named shard or slot are
    replaced. Nulls, repeated rows and empty texts are rows like others; an empty
    table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.drop("shard", "slot")
    local = (
        rows.withColumn(OWN[2], F.rand(seed))
        .sortWithinPartitions(OWN[2])
        .withColumn(OWN[0], F.spark_partition_id())
        .withColumn(OWN[1], F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .withColumn(OWN[2], F.rand(seed + 1))
    )
    local = stored(local, "shards")
    counted = sorted((r[0], r[1]) for r in local.groupBy(OWN[0]).count().collect())
    matrix, sizes = communication_matrix([n for _, n in counted], shards, seed)
    bounds = spark.createDataFrame(
        [(p, np.cumsum(row).tolist()) for (p, _), row in zip(counted, matrix)], f"{OWN[0]} int, _hg_bounds array<long>"
    )
    blocks = max(1, -(-int(sizes.max(initial=0)) // BLOCK_ROWS))
    dealt = (
        local.join(F.broadcast(bounds), OWN[0])  # one row per source partition
        .withColumn("shard", F.size(F.filter("_hg_bounds", lambda b: b <= F.col(OWN[1]))))
        .withColumn(OWN[3], F.floor(F.col(OWN[2]) * blocks).cast("int"))
        .drop("_hg_bounds")
    )
    in_block = W.partitionBy("shard", OWN[3]).orderBy(OWN[2], OWN[0], OWN[1])
    if blocks == 1:
        return dealt.withColumn("slot", (F.row_number().over(in_block) - 1).cast("long")).drop(*OWN)
    before = W.partitionBy("shard").orderBy(OWN[3]).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", OWN[3]).agg(F.count(F.lit(1)).alias("_hg_n"))
        .select("shard", OWN[3], F.coalesce(F.sum("_hg_n").over(before), F.lit(0)).alias("_hg_before"))
    )
    return (
        dealt.withColumn("_hg_in", F.row_number().over(in_block) - 1)
        .join(offsets, ["shard", OWN[3]])
        .withColumn("slot", (F.col("_hg_before") + F.col("_hg_in")).cast("long"))
        .drop("_hg_before", "_hg_in", *OWN)
    )

"""Merkle roots over chain order, 1,024 nodes per reduction step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.functions.crypto import leaf_hash, node_hash

FAN_IN_LEVELS = 10
FAN_IN = 1 << FAN_IN_LEVELS


def _fold_block(nodes: Column, levels: Column) -> Column:
    """Hash a block pairwise, ``levels`` times; an odd tail pairs with itself.

    Blocks start at multiples of 1,024, so whether a level's last node is odd
    shows inside the last block alone and blocks never look at each other.
    """

    def up(level: Column, _: Column) -> Column:
        count = F.size(level)
        left = F.transform(
            F.sequence(F.lit(0), F.floor((count - 1) / 2).cast("int")),
            lambda i: node_hash(
                F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.get(level, i * 2))
            ),
        )
        return left

    return F.aggregate(F.sequence(F.lit(1), levels), nodes, up)


def merkle_roots(df: DataFrame, by: str, pos: str, mac: str) -> DataFrame:
    """(by, leaf_count, root) with leaves in ``pos`` order (dense per group).

    log₁₀₂₄(n) rounds; each group of one round is at most 1,024 nodes, so the
    size of a single archive or chain never decides how big a task gets.
    """
    nodes = df.select(
        F.col(by).alias("_by"), F.col(pos).alias("_i"), leaf_hash(F.col(mac)).alias("_h")
    )
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    remaining = int(largest)
    counts = sizes.withColumnRenamed("_n", "leaf_count")
    width = F.col("leaf_count")
    nodes = nodes.join(counts, "_by")
    first = True
    while first or remaining > 1:
        first = False
        # Level count left for this group: none once its width is one.
        need = F.ceil(F.log2(width.cast("double"))).cast("int")
        levels = F.least(F.lit(FAN_IN_LEVELS), F.greatest(need, F.lit(0)))
        grouped = nodes.groupBy(
            "_by", "leaf_count", F.floor(F.col("_i") / FAN_IN).alias("_block")
        ).agg(F.array_sort(F.collect_list(F.struct("_i", "_h"))).alias("_nodes"))
        hashes = F.transform("_nodes", lambda n: n["_h"])
        folded = F.when(levels > 0, _fold_block(hashes, F.greatest(levels, F.lit(1)))).otherwise(
            hashes
        )
        nodes = grouped.select(
            "_by", "leaf_count", F.col("_block").alias("_i"), F.get(folded, 0).alias("_h")
        )
        width = F.ceil(width / FAN_IN)
        remaining = -(-remaining // FAN_IN)
    return nodes.select(F.col("_by").alias(by), "leaf_count", F.col("_h").alias("root"))

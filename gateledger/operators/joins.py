"""Look-ups as joins: as-of, traces, escalations, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.operators.ordered import carry_last, dense_position, range_chunks


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    value: str,
    row_id: str,
    name: str = "asof_value",
) -> DataFrame:
    """For each left row the latest right ``value`` at or before its time.

    Both sides go through one range-partitioned sort on (key, time), which may
    cut inside a key, so a hot key is spread over tasks; the value that crosses
    a cut travels in one summary row.  Right rows with equal time come first.
    """
    side_left = left.select(
        F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
        F.col(row_id).cast("string").alias("_id"), F.lit(None).cast(right.schema[value].dataType).alias("_v"),
        F.struct(*left.columns).alias("_row"),
    )
    side_right = right.select(
        F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"),
        F.xxhash64(*right.columns).cast("string").alias("_id"), F.col(value).alias("_v"),
    )
    both = side_left.unionByName(side_right, allowMissingColumns=True)
    order = ["_t", "_side", "_id"]
    chunks = range_chunks(both, ["_k", *order])
    carried = carry_last(chunks, ["_k"], order, "_v", name)
    return carried.where("_side = 1").select("_row.*", name)


def request_trace(df: DataFrame, fingerprint: str, order: str, bucket: Column) -> DataFrame:
    """Every decision with its place and the size of its request's trace.

    No group is collected: places come from per-bucket counts, so a fingerprint
    shared by most rows is numbered by many tasks.
    """
    placed = dense_position(df, [order], bucket, "trace_pos", [fingerprint])
    sizes = df.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("trace_size"))
    return placed.join(sizes, fingerprint)


def escalations_open(
    decisions: DataFrame, key: str, ts: str, order: str = "seq"
) -> DataFrame:
    """Escalations with no later allow on the same key.

    The latest approval per key is one row, so the join is against a summary
    rather than pairs of rows.
    """
    approved = (
        decisions.where("decision = 'allow'")
        .groupBy(key)
        .agg(F.max(order).alias("_approved"))
    )
    return (
        decisions.where("decision = 'escalate'")
        .join(approved, key, "left")
        .where(F.col("_approved").isNull() | (F.col("_approved") < F.col(order)))
        .drop("_approved")
    )


def newly_present(current: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    return current.join(prior.select(key).distinct(), key, "left_anti")


def name_differences(expected: DataFrame, installed: DataFrame, key: str) -> DataFrame:
    """(key, side) with side 'missing' or 'extra'."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    i = installed.select(key).distinct().withColumn("_i", F.lit(True))
    both = e.join(i, key, "full")
    side = F.when(F.col("_i").isNull(), "missing").when(F.col("_e").isNull(), "extra")
    return both.withColumn("side", side).where("side is not null").select(key, "side")


def shadow_join(decisions: DataFrame, shadow: DataFrame) -> DataFrame:
    """Real and would-have-been counts side by side per (check, stage, decision)."""
    keys = ["check_name", "stage", "decision"]
    real = decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("decisions"))
    dark = shadow.groupBy(*keys).agg(F.count(F.lit(1)).alias("shadowed"))
    return real.join(dark, keys, "full").na.fill(0, ["decisions", "shadowed"])

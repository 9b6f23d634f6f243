"""Order-dependent work on keys of any size.

A key (one chain, one owner, one response) may hold a large share of all rows,
so nothing here gives a whole key to one task.  Three tools cover the needs:

* ``dense_position`` – row numbers from per-bucket counts and offsets;
* ``halo_blocks`` / ``running_sum`` – windows over bounded blocks of a dense
  position, with the neighbouring rows or the block offset brought in;
* ``ordered_fold`` – a state machine over range-sorted chunks, repeated only
  for chunks that lie inside one key and are reached by another state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger.session import durable, durable_table

BLOCK_ROWS = 65_536


def dense_position(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    name: str = "pos",
    by: Sequence[str] = (),
) -> DataFrame:
    """0-based dense position in ``order`` (within ``by``).

    ``bucket`` must be monotone in the order and bound its own row count, for
    example an id divided by a constant, or a file split.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_bucket") if not by else Window.partitionBy(*by).orderBy("_bucket")
    offsets = counts.select(
        *by,
        "_bucket",
        F.coalesce(
            F.sum("_rows").over(before.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return (
        keyed.join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def halo_blocks(
    df: DataFrame, pos: str, halo: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cut a dense position into blocks, repeating ``halo`` rows as context.

    Adds ``_block`` and ``_context``; windows over (keys, ``_block``) then see
    ``halo`` preceding rows, and context rows are filtered out afterwards.
    """
    if halo > block_rows:
        raise ValueError("the halo cannot exceed the block")
    block = F.floor(F.col(pos) / block_rows)
    near_end = F.pmod(F.col(pos), F.lit(block_rows)) >= block_rows - halo
    blocks = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    return (
        df.withColumn("_home", block)
        .withColumn("_block", F.explode(blocks))
        .withColumn("_context", F.col("_block") != F.col("_home"))
        .drop("_home")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: Column,
    name: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inclusive running total per key, built from block totals."""
    keyed = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(pos) / block_rows))
    totals = keyed.groupBy(*keys, "_block").agg(F.sum("_v").alias("_total"))
    before = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        keyed.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_base") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_v", "_block", "_base")
    )


def range_chunks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sorted, balanced, durable chunks of the total order (``_chunk``).

    The order must end in a unique column: the range partitioner can then cut
    inside one key, so a hot key spreads over many chunks.
    """
    return durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_chunk", F.spark_partition_id())
    )


State = tuple | None
Step = Callable[[State, Any], tuple[State, tuple]]
Fresh = Callable[[Any, Any], bool]


def _walk_chunks(batches: Iterator[pd.DataFrame], keys: Sequence[str], step: Step, fresh: Fresh | None):
    """Walk sorted batches; yields (batch, outputs, None), and (None, None, edge) behind each chunk.

    An edge is chunk, first and last key, state at the end, the state it began
    with, and whether the end depends on that: one key, and no fresh start.
    """
    chunk = first = key = state = began = last_row = None
    depends = True

    def edge() -> tuple:
        return int(chunk), repr(first), repr(key), repr(state), began, depends

    for batch in batches:
        columns = list(batch.columns)
        at = [columns.index(k) for k in keys]
        chunk_at, in_at = columns.index("_chunk"), columns.index("_in")
        outputs = []
        for row in batch.itertuples(index=False):
            row_key = tuple(row[i] for i in at)
            if row[chunk_at] != chunk:
                if chunk is not None:
                    yield None, None, edge()
                chunk, first, key, depends = row[chunk_at], row_key, row_key, True
                began = row[in_at]
                state = _parse_state(began) if began is not None else None
            elif row_key != key or fresh is not None and fresh(last_row, row):
                key, state, depends = row_key, None, False
            state, out = step(state, row)
            last_row = row
            outputs.append(out)
        yield batch, outputs, None
    if chunk is not None:
        yield None, None, edge()


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    outputs: Sequence[T.StructField],
    fresh: Fresh | None = None,
) -> DataFrame:
    """Run ``step(state, row) -> (state, outputs)`` over each key in order.

    ``state`` is None at a key's first row, and otherwise a tuple of ints,
    strings or booleans.  ``fresh(before, row)`` may tell that a row's state does
    not depend on earlier rows of its key (as if it were the first), so that the
    chunk's end is known in one pass.  Only chunks of a single key without such a
    row depend on their predecessor's end state; these are walked again while the
    state that reaches them changes.  That is exact: the first such chunk is right
    at once, and each round fixes at least the next.  States stay in tables of one
    row per chunk; the driver only asks whether any is left to walk.
    """
    chunks = durable(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_chunk", F.spark_partition_id())
        # the lower 33 bits count the rows of a partition
        .withColumn("_first", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0)
    )
    edge_fields = ["chunk", "first", "last", "state", "began", "depends"]

    def walk(batches):
        found = [edge for _, _, edge in _walk_chunks(batches, keys, step, fresh) if edge]
        yield pd.DataFrame(found, columns=edge_fields)

    def edges_of(rows: DataFrame) -> DataFrame:
        return rows.mapInPandas(walk, "chunk int, first string, last string, state string, began string, depends boolean")

    def entered(rows: DataFrame, states: DataFrame) -> DataFrame:
        """Chunks in order again, with the state that reaches them on their first row."""
        coming = states.select(F.col("chunk").alias("_chunk"), F.lit(True).alias("_first"), F.col("coming").alias("_in"))
        return rows.join(coming, ["_chunk", "_first"], "left").repartition("_chunk").sortWithinPartitions(
            "_chunk", *keys, *order, F.col("_first").desc())

    untouched = chunks.withColumn("_in", F.lit(None).cast("string"))
    edges = durable_table(edges_of(untouched))
    before = Window.orderBy("chunk")  # one row per chunk
    while True:
        same = F.lag("last").over(before) == F.col("first")
        linked = durable_table(edges.withColumn("coming", F.when(same, F.lag("state").over(before))))
        stale = linked.where(F.col("depends") & ~F.col("coming").eqNullSafe(F.col("began"))).select("chunk", "coming")
        if stale.isEmpty():
            break
        there = chunks.join(stale.select(F.col("chunk").alias("_chunk")), "_chunk", "left_semi")
        edges = durable_table(
            linked.select(edge_fields).join(stale, "chunk", "left_anti").unionByName(edges_of(entered(there, stale))))

    states = linked.where("coming is not null")
    ready = untouched if states.isEmpty() else entered(chunks, states)
    own = ["_chunk", "_first", "_in"]
    source = [f for f in df.schema.fields]
    schema = T.StructType([*source, *outputs])
    names = [f.name for f in outputs]

    def emit(batches):
        for batch, results, _ in _walk_chunks(batches, keys, step, fresh):
            if batch is not None:
                extra = pd.DataFrame(results, columns=names, index=batch.index, dtype=object)
                yield pd.concat([batch.drop(columns=own), extra], axis=1)

    return ready.select(*df.columns, *own).mapInPandas(emit, schema)


def _parse_state(text: str) -> State:
    import ast

    return ast.literal_eval(text)


def carry_last(
    chunks: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Latest non-null ``value`` at or before each row, over ``range_chunks``.

    Windows stay inside one chunk; what a key brings along from earlier chunks
    comes from one summary row per (chunk, key).
    """
    inside = (
        Window.partitionBy("_chunk", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ends = chunks.groupBy("_chunk", *keys).agg(
        F.max_by(
            F.when(F.col(value).isNotNull(), F.col(value)),
            F.when(F.col(value).isNotNull(), F.struct(*order)),
        ).alias("_end")
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(
        "_chunk", *keys, F.last("_end", ignorenulls=True).over(earlier).alias("_carried")
    )
    return (
        chunks.join(carried, ["_chunk", *keys], "left")
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried")))
        .drop("_carried")
    )


def carry_sum(
    chunks: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Inclusive running total per key over ``range_chunks``."""
    keyed = chunks.withColumn("_v", value)
    inside = (
        Window.partitionBy("_chunk", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        keyed.groupBy("_chunk", *keys)
        .agg(F.sum("_v").alias("_total"))
        .select("_chunk", *keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    )
    return (
        keyed.join(carried, ["_chunk", *keys])
        .withColumn(name, F.col("_base") + F.sum("_v").over(inside))
        .drop("_v", "_base")
    )

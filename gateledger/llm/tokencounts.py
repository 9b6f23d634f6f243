"""Token counts by scanning flat token files for end-of-document ids.

A flat file is a run of unsigned ids without an index; it is kept as fixed-size
blocks, which documents cross freely.  A scan looks at each block alone: one
vectorised search gives the separators, and with them the lengths between
separators, the ids before the first and after the last.  What crosses block
borders is stitched by a prefix scan over one small row per block: ids and
separators before a block, and the end of the last document before it.  The
scan has two levels (spans of blocks, then spans), so a file of any size is
never summed up by a single task.

Defined results: null and empty texts count one id, the separator; repeated
rows are separate documents; ids after the last separator form one document
that is marked as not terminated; no rows give no counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateledger.llm import encode
from gateledger.llm.common import slices, slim, table
from gateledger.session import durable_table, fresh_path

BLOCK_BYTES = 1 << 17
SPAN = 1024  # blocks in a span of the prefix scan
SCHEMA = "file int, block long, ids binary, doc_ids array<long>"  # name rows: block is the first doc_no


def write_flat(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write ids as unsigned 16-bit integers, each document followed by ``end_id``.

    A task's file also gets rows that name its documents in order; the scan does
    not read them.
    """
    if end_id >= 1 << 16:
        raise ValueError("ids must fit 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encode.shared(tokenizer, special=False)  # the separator stays unique
        file, block, seen, held = TaskContext.get().partitionId(), 0, 0, bytearray()
        end = np.array([end_id], "<u2").tobytes()

        def row(number, ids, named):
            return pa.RecordBatch.from_arrays([
                pa.array([file], pa.int32()), pa.array([number], pa.int64()),
                pa.array([ids], pa.binary()), pa.array([named], pa.list_(pa.int64()))], names)

        for batch in batches:
            for part in slices(batch):
                for text in part.column(1).to_pylist():
                    held += np.frombuffer(encoder.encode(text), "<u4").astype("<u2").tobytes() + end
                    while len(held) >= block_bytes:
                        yield row(block, bytes(held[:block_bytes]), None)
                        block += 1
                        del held[:block_bytes]
                yield row(seen, None, part.column(0).to_pylist())
                seen += part.num_rows
        if held:
            yield row(block, bytes(held), None)

    names = ["file", "block", "ids", "doc_ids"]
    slim(docs, id_col, text_col).mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def separators(blocks: DataFrame, end_id: int) -> DataFrame:
    """Per block: ids, separators, ids after the last one, lengths that end in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, tail, at = [], [], [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                ends = np.flatnonzero(ids == end_id) + 1
                n.append(len(ids))
                found.append(len(ends))
                tail.append(len(ids) - (int(ends[-1]) if len(ends) else 0))
                at.append(ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(found, pa.int64()),
                 pa.array(tail, pa.int64()), pa.array(at, pa.list_(pa.int64()))],
                ["file", "block", "n", "seps", "tail", "ends"])

    return blocks.select("file", "block", "ids").mapInArrow(
        run, "file int, block long, n long, seps long, tail long, ends array<long>")


def stitch(scanned: DataFrame, span: int = SPAN) -> DataFrame:
    """Add what lies before each block: its start, documents ended, end of the last one."""
    inner = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # slim rows first: the places stay out of the scan
    slim_rows = scanned.select("file", "block", "n", "seps", "tail").withColumn(
        "span", F.floor(F.col("block") / span))
    local = slim_rows.withColumn("local_start", F.coalesce(F.sum("n").over(inner), zero)).withColumn(
        "local_docs", F.coalesce(F.sum("seps").over(inner), zero))
    local = local.withColumn(
        "own_end", F.when(F.col("seps") > 0, F.col("local_start") + F.col("n") - F.col("tail"))
    ).withColumn("local_end", F.max("own_end").over(inner))
    spans = local.groupBy("file", "span").agg(
        F.sum("n").alias("span_n"), F.sum("seps").alias("span_docs"), F.max("own_end").alias("span_end"))
    spans = spans.withColumn("base", F.coalesce(F.sum("span_n").over(outer), zero)).withColumn(
        "docs_before", F.coalesce(F.sum("span_docs").over(outer), zero))
    spans = spans.withColumn("end_before", F.max(F.col("base") + F.col("span_end")).over(outer))
    return local.join(spans.select("file", "span", "base", "docs_before", "end_before"), ["file", "span"]).select(
        "file", "block", "n", "seps", "tail",
        (F.col("base") + F.col("local_start")).alias("start"),
        (F.col("docs_before") + F.col("local_docs")).alias("first_doc"),
        F.coalesce(F.col("base") + F.col("local_end"), F.col("end_before"), zero).alias("last_end"),
    )


def count_tokens(files: DataFrame, end_id: int, span: int = SPAN) -> DataFrame:
    """Lengths of all documents of flat files: file, doc_no, start, n_tokens, terminated."""
    # Small next to the ids, and read several times below.
    scanned = durable_table(separators(files.where(F.col("ids").isNotNull()), end_id))
    placed = stitch(scanned, span)
    docs = placed.where(F.col("seps") > 0).join(scanned.select("file", "block", "ends"), ["file", "block"]).select(
        "file", "first_doc", "last_end", F.col("start").alias("block_start"),
        F.col("ends"), F.posexplode("ends").alias("at", "end"))
    start = F.when(F.col("at") == 0, F.col("last_end")).otherwise(
        F.col("block_start") + F.element_at("ends", F.greatest(F.col("at"), F.lit(1))))
    ended = docs.withColumn("start", start).select(
        "file", (F.col("first_doc") + F.col("at")).alias("doc_no"), "start",
        (F.col("block_start") + F.col("end") - F.col("start")).alias("n_tokens"),
        F.lit(True).alias("terminated"))
    totals = placed.groupBy("file").agg(
        F.max(F.col("start") + F.col("n")).alias("size"), F.max(F.col("first_doc") + F.col("seps")).alias("doc_no"),
        F.max(F.when(F.col("seps") > 0, F.col("start") + F.col("n") - F.col("tail"))).alias("end"))
    rest = totals.withColumn("start", F.coalesce("end", F.lit(0))).where(F.col("size") > F.col("start")).select(
        "file", "doc_no", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(rest)


def named(files: DataFrame) -> DataFrame:
    """The document of each (file, doc_no), from the rows that name them."""
    return (
        files.where(F.col("doc_ids").isNotNull())
        .select("file", "block", F.posexplode("doc_ids").alias("at", "doc_id"))
        .select("file", (F.col("block") + F.col("at")).alias("doc_no"), "doc_id")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    write_flat(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=50256)
    files = spark.read.schema(SCHEMA).parquet(path)
    counts = count_tokens(files, 50256)
    return counts.join(named(files), ["file", "doc_no"]).select("doc_id", "n_tokens", "file", "start")

"""Token ids in range-coded files, written in document order and read back.

A file is what one task writes: blocks of ids, each coded and checksummed on its
own (``rangecoder``), with the ids and lengths of its documents beside it.
Files are the Parquet files of one table, so a lost task writes its file again
and nothing half-written is ever seen.  A block takes whole documents until it
is full; longer documents run over several blocks.  Readers decode each block
alone, so reading needs no order; only one small row per document part is
shuffled to join parts and to add up positions.

Defined results: null and empty texts are an end id alone; repeated rows are
separate documents; a null document id sorts first; no rows make no blocks.  A
block that does not match its checksum raises ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateledger.llm import encode, rangecoder
from gateledger.llm.common import slices, slim, table
from gateledger.session import fresh_path

BLOCK_IDS = 1 << 19
SLICE_BYTES = 1 << 20  # of text encoded at a time; a worker's arrays are some ten times that
SCHEMA = (
    "file int, block int, first_doc long, n_ids long, doc_ids array<long>, lengths array<long>, "
    "continues boolean, payload binary"
)


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode documents and write their ids to ``path`` in ascending order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encode.shared(tokenizer)
        size = max(encoder.library.get_vocab_size(), end_id + 1)
        end = np.array([end_id], "<u4").tobytes()
        file, block, seen = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        n, continues = 0, False

        def flush():
            nonlocal block, held, n, continues
            ids = np.frombuffer(b"".join(h[1] for h in held), "<u4")
            row = pa.RecordBatch.from_arrays([
                pa.array([file], pa.int32()), pa.array([block], pa.int32()),
                pa.array([seen - len(held)], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([[h[0] for h in held]], pa.list_(pa.int64())),
                pa.array([[len(h[1]) // 4 for h in held]], pa.list_(pa.int64())),
                pa.array([continues], pa.bool_()),
                pa.array([rangecoder.pack_ids(ids, size)], pa.binary()),
            ], names)
            block, held, n, continues = block + 1, [], 0, False
            return row

        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode_all(part.column(1)), strict=True):
                    ids += end
                    seen += 1
                    while ids:
                        room = 4 * (block_ids - n)
                        if len(ids) > room and n and len(ids) <= 4 * block_ids:
                            seen -= 1  # the document opens the next block
                            yield flush()
                            seen += 1
                            continue
                        held.append((doc, ids[:room]))
                        n, ids = n + len(ids[:room]) // 4, ids[room:]
                        if n >= block_ids:
                            yield flush()
                            continues = bool(ids)
        if held:
            yield flush()

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    # Range partitions keep the order of ids from file to file.
    ordered = slim(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def read_parts(files: DataFrame) -> DataFrame:
    """Each document's ids in each block: place, number and checksum of the decoded ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = memoryview(rangecoder.unpack_ids(row["payload"]).tobytes())
                sizes = np.array(row["lengths"], np.int64)
                at = np.cumsum(sizes) - sizes
                k = len(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["file"]] * k, pa.int32()), pa.array([row["block"]] * k, pa.int32()),
                    pa.array(range(row["first_doc"], row["first_doc"] + k), pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(at), pa.array(sizes),
                    pa.array([zlib.crc32(ids[4 * a: 4 * (a + s)]) for a, s in zip(at, sizes, strict=True)], pa.int64()),
                ], ["file", "block", "doc_no", "doc_id", "at", "n", "crc"])

    return files.select("file", "block", "first_doc", "doc_ids", "lengths", "payload").mapInArrow(
        run, "file int, block int, doc_no long, doc_id long, at long, n long, crc long")


def block_starts(files: DataFrame) -> DataFrame:
    """Ids before each block: sums over files, then over the blocks of a file."""
    blocks = files.select("file", "block", "n_ids")
    totals = blocks.groupBy("file").agg(F.sum("n_ids").alias("total"))
    # One row per file: small next to the blocks, let alone the ids.
    before_file = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before_block = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.join(
        totals.select("file", F.coalesce(F.sum("total").over(before_file), F.lit(0)).alias("base")), "file",
    ).select(
        "file", "block",
        (F.col("base") + F.coalesce(F.sum("n_ids").over(before_block), F.lit(0))).alias("before"),
    )


def crc_join(parts: list[tuple[int, int]]) -> int:
    """The crc32 of joined byte strings from their (crc32, length) pairs."""

    def times(matrix, vector):
        total, i = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[i]
            vector >>= 1
            i += 1
        return total

    def square(matrix):
        return [times(matrix, m) for m in matrix]

    crc, _ = parts[0]
    for other, size in parts[1:]:
        matrix = square(square(square([0xEDB88320] + [1 << i for i in range(31)])))  # one zero byte
        while size:
            if size & 1:
                crc = times(matrix, crc)
            matrix = square(matrix)
            size >>= 1
        crc ^= other
    return crc


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document from decoded files: start, n_tokens, ids_crc32."""

    @F.pandas_udf("long")
    def joined(parts):
        import pandas as pd

        return pd.Series([
            p[0]["crc"] if len(p) == 1 else crc_join([(x["crc"], 4 * x["n"]) for x in sorted(p, key=lambda x: x["block"])])
            for p in parts])

    parts = read_parts(files).join(block_starts(files), ["file", "block"])
    return (
        # A document runs over as many blocks as its length needs, so the list is short.
        parts.groupBy("file", "doc_no").agg(
            F.first("doc_id").alias("doc_id"),
            F.min(F.col("before") + F.col("at")).alias("start"),
            F.sum("n").alias("n_tokens"),
            F.collect_list(F.struct("block", "n", "crc")).alias("parts"))
        .select("doc_id", "start", "n_tokens", joined("parts").alias("ids_crc32"))
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark.read.schema(SCHEMA).parquet(path))

"""Pack documents into fixed-length sequences by their length histogram.

Each document is encoded, an end id is added, and it is cut into full-length
pieces and a rest.  Lengths are then placed longest first, each into the
least-filled pack that still has room, on counts of equal packs (patterns), so
the work depends on the number of lengths and not of documents.  Documents find
their place by rank: the k-th piece of a length takes the k-th slot of that
length.  Ranks come from counts per (length, salt), so a length that holds a
third of all pieces is numbered by many tasks.

Only the histogram (at most ``length`` rows) reaches the driver, and the slot
table it makes is bounded by the number of lengths, not by the data.

Defined results: null and empty texts become one piece with the end id;
repeated rows are packed each on its own; no documents give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateledger.llm import encode
from gateledger.llm.common import slices, slim, table
from gateledger.session import durable_table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(
    docs: DataFrame, path: str, end_id: int, length: int, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encoded pieces of at most ``length`` ids; the ids stay in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encode.shared(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = memoryview(encoder.encode(text) + end)
                    n = len(ids) // 4
                    for at in range(0, n, length):
                        size = min(length, n - at)
                        rows.append((doc, at, size, zlib.crc32(ids[4 * at: 4 * (at + size)]), n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encoder.rest()

    return slim(docs, id_col, text_col).mapInArrow(run, PIECES)


def place(histogram: dict[int, int], length: int) -> list[tuple[int, list[int]]]:
    """Packing patterns (count, lengths): longest first into the shortest open pack."""
    open_: dict[int, list[list]] = {}  # room left -> [count, lengths]
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max((r for r in open_ if r >= size), default=None)
            if room is None:
                open_.setdefault(length - size, []).append([left, [size]])
                break
            pack = open_[room][-1]
            # several of this size may share a pack; fill evenly before the next round
            took = min(left, pack[0])
            pack[0] -= took
            if not pack[0]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
            open_.setdefault(room - size, []).append([took, [*pack[1], size]])
            left -= took
    return [(count, sizes) for packs in open_.values() for count, sizes in packs]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of each pattern's places."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for count, sizes in sorted(patterns, key=lambda p: (p[1], p[0])):
        offset = 0
        for size in sizes:
            first = used.get(size, 0)
            used[size] = first + count
            out.append((size, first, first + count, sequence, offset))
            offset += size
        sequence += count
    return out


def pack(cut: DataFrame, length: int = 2048, salt: int = 64) -> DataFrame:
    """Give each piece (columns of PIECES) its sequence and offset."""
    spark = cut.sparkSession
    cut = durable_table(cut)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salt)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = spark.createDataFrame(
        slots(place(histogram, length)) or [],
        "length long, first long, last long, sequence long, offset long")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = salted.withColumn("row", F.row_number().over(order) - 1).join(
        bases.select("length", "salt", "base"), ["length", "salt"])
    rank = F.col("base") + F.col("row")
    # Bounded by the number of lengths: a few slots for each of at most ``length`` of them.
    return ranked.withColumn("rank", rank).alias("p").join(
        F.broadcast(placed).alias("s"),
        (F.col("p.length") == F.col("s.length"))
        & (F.col("p.rank") >= F.col("s.first")) & (F.col("p.rank") < F.col("s.last")),
    ).select(
        "p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens",
        (F.col("s.sequence") + F.col("p.rank") - F.col("s.first")).alias("sequence_id"),
        F.col("s.offset").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, path: str | None = None, end_id: int = 1, length: int = 2048,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return pack(pieces(docs, path, end_id, length, id_col, text_col), length)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

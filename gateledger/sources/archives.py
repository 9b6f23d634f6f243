"""Archived ranges: import of single-file archives, and archive tables."""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.sources.decisions import validate_decisions

MAGIC = b"GATELEDGER-ARCHIVE-V"

_PART = (
    "archive_path string, error string, header string, stored_root string, "
    "leaf_count long, line_number long, raw_line string"
)


def pairwise_root(leaves: list[bytes]) -> str:
    """Root of the leaf digests kept inside one archive file."""
    level = leaves
    while len(level) > 1:
        level = [
            hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest()
            for i in range(0, len(level), 2)
        ]
    return level[0].hex()


def _section(raw: bytes, at: int, start: bytes, end: bytes) -> tuple[bytes, int]:
    if not raw.startswith(start, at):
        raise ValueError(f"expected {start!r}")
    stop = raw.find(end, at + len(start))
    if stop < 0:
        raise ValueError(f"{end.strip()!r} not found")
    return raw[at + len(start) : stop], stop + len(end)


def _tree(block: bytes) -> tuple[str, int]:
    """(stored root, leaf count) of the tree section, root recomputed."""
    intro = b"MERKLE-V1\n"
    if not block.startswith(intro):
        raise ValueError("tree section has no version line")
    at = len(intro)

    def number() -> int:
        nonlocal at
        if at + 4 > len(block):
            raise ValueError("tree section is cut short")
        at += 4
        return int.from_bytes(block[at - 4 : at], "big")

    count, width = number(), number()
    body = block[at : at + count * width]
    if len(body) != count * width or not count:
        raise ValueError("tree section is cut short")
    at += count * width
    size = number()
    root = block[at : at + size].decode("ascii")
    leaves = [bytes.fromhex(body[i : i + width].decode("ascii")) for i in range(0, len(body), width)]
    if pairwise_root(leaves) != root:
        raise ValueError("stored root does not match its leaves")
    return root, count


def parse_archive(raw: bytes, magic: bytes) -> tuple[dict, str, int, list[str]]:
    """(header, stored root, leaf count, lines) of one archive file."""
    first = raw.find(b"\n")
    second = raw.find(b"\n", first + 1)
    if first < 0 or not raw.startswith(magic):
        raise ValueError("missing magic prefix")
    version = raw[len(magic) : first].decode("ascii", "replace")
    if version != "1":
        raise ValueError(f"unsupported format version {version!r}")
    if second < 0:
        raise ValueError("header line is not terminated")
    header = json.loads(raw[first + 1 : second].decode("utf-8"))
    for name in ("archive_format_version", "range_start", "range_end", "entry_count", "merkle_root"):
        if name not in header:
            raise ValueError(f"header lacks {name}")
    block, at = _section(raw, second + 1, b"MERKLE-START\n", b"\nMERKLE-END\n")
    root, leaves = _tree(block)
    body, _ = _section(raw, at, b"ENTRIES-START\n", b"\nENTRIES-END\n")
    try:
        text = gzip.decompress(body).decode("utf-8")
    except (OSError, EOFError, zlib.error, UnicodeDecodeError) as exc:
        raise ValueError(f"entries section is corrupt: {exc}") from exc
    lines = [line for line in text.split("\n") if line.strip()]
    if len(lines) != int(header["entry_count"]):
        raise ValueError(f"header claims {header['entry_count']} entries, file holds {len(lines)}")
    return header, root, leaves, lines


def read_archives(
    spark: SparkSession, folder: str, magic: bytes = MAGIC
) -> tuple[DataFrame, DataFrame]:
    """Single-file archives → (headers, entries).

    One file is one task's row and becomes many rows; a bad file becomes one
    header row with ``error`` set.  ``entries`` is validated like a log.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    parse = parse_archive

    def unpack(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    header, root, leaves, lines = parse(bytes(content), magic)
                    rows.append((path, None, json.dumps(header), root, leaves, None, None))
                    rows += [(path, None, None, None, None, i, x) for i, x in enumerate(lines)]
                except (ValueError, KeyError, TypeError) as exc:
                    rows.append((path, str(exc), None, None, None, None, None))
                for at in range(0, len(rows), 50_000):
                    frame = pd.DataFrame(
                        rows[at : at + 50_000],
                        columns=["archive_path", "error", "header", "stored_root", "leaf_count",
                                 "line_number", "raw_line"],
                    )
                    yield frame.astype({"leaf_count": "Int64", "line_number": "Int64"})

    # Every file is read and parsed once for both outputs.
    from gateledger.session import durable

    parts = durable(files.mapInPandas(unpack, _PART))
    lines = validate_decisions(parts.where("raw_line is not null"))
    from gateledger.sources.decisions import _fields

    invalid = lines.where("parse_error is not null").groupBy("archive_path").agg(
        F.min_by(F.concat(F.lit("archived entry is invalid: "), F.col("parse_error")), "line_number")
        .alias("_bad")
    )
    member = lambda name: F.get_json_object("header", f"$.{name}")
    headers = (
        parts.where("line_number is null")
        .join(invalid, "archive_path", "left")
        .select(
            "archive_path",
            F.coalesce("error", "_bad").alias("error"),
            member("archive_format_version").cast("int").alias("archive_format_version"),
            member("range_start").alias("range_start"),
            member("range_end").alias("range_end"),
            member("entry_count").cast("long").alias("entry_count"),
            member("merkle_root").alias("merkle_root"),
            "stored_root",
        )
    )
    good = headers.where("error is null").select("archive_path")
    entries = lines.join(good, "archive_path", "left_semi").select(
        "archive_path", F.col("line_number").alias("archive_seq"),
        *_fields(F.col("_document"), F.col("raw_line")),
    )
    return headers, entries


def write_archive_dataset(
    entries: DataFrame, header: DataFrame, path: str, archive_id: str
) -> None:
    """Rows first, then the one-row manifest: a crash leaves no claimed archive."""
    entries.withColumn("archive_id", F.lit(archive_id)).write.mode("errorifexists").parquet(
        f"{path}/entries/archive_id={archive_id}"
    )
    header.withColumn("archive_path", F.lit(archive_id)).write.mode("append").parquet(
        f"{path}/manifest"
    )


def read_archive_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, entries) of the table form; only manifest-listed archives count."""
    headers = spark.read.parquet(f"{path}/manifest").withColumn(
        "stored_root", F.col("merkle_root")
    ).withColumn("error", F.lit(None).cast("string"))
    entries = spark.read.parquet(f"{path}/entries").drop("archive_id").withColumn(
        "archive_path", F.regexp_extract(F.col("_metadata.file_path"), "archive_id=([^/]+)", 1)
    )
    return headers, entries

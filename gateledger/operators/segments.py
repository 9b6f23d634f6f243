"""Linked segments: a chain of segment heads over chains that are sealed side by side.

``ledger.seal`` with ``segment_rows`` cuts a long chain so that many tasks can seal
it.  Alone, such segments are separate chains, and a whole one could vanish.  Here
each segment gives one head (number, rows, last MAC); the heads of a chain are
sealed as a chain of their own, closed by a row with their number.  A removed,
added, shortened or exchanged segment no longer agrees with its signed head, and
a removed head breaks the chain of heads.  The sequential part is one slim row
per segment; all else runs over segments side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateledger.functions.crypto import KeyRing
from gateledger.operators import ledger

HEADS = "/heads"
HEAD, CLOSED = "segment_head", "segments_closed"


def _ends(segments: DataFrame) -> DataFrame:
    """root, segment, rows, last_hmac and last time of each sealed segment."""
    root = F.regexp_extract("chain_id", "^(.*)/[0-9]+$", 1)
    number = F.regexp_extract("chain_id", "/([0-9]+)$", 1).cast("long")
    return segments.groupBy(root.alias("root"), number.alias("segment")).agg(
        F.count(F.lit(1)).alias("rows"), F.max_by("hmac", "seq").alias("last_hmac"), F.max("ts_ns").alias("ts_ns"))


def seal_heads(segments: DataFrame, ring: KeyRing, anchor_backend: str | None = "noop") -> DataFrame:
    """The signed heads of sealed segments, in segment order, and a closing row for each chain."""
    ends = _ends(segments)
    facts = ["last_hmac", "rows", "segment"]
    closing = ends.groupBy("root").agg(F.count(F.lit(1)).alias("seq"), F.max("ts_ns").alias("ts_ns")).select(
        "root", "seq", "ts_ns", F.lit(CLOSED).alias("check_name"), F.concat("root", F.lit(HEADS)).alias("entry_id"),
        F.to_json(F.struct(F.col("seq").alias("segments"))).alias("metadata"))
    # One row per segment: as many rows as the chain of heads has to pass one by one anyway.
    place = F.row_number().over(Window.partitionBy("root").orderBy("segment")).cast("long") - 1
    heads = ends.select(
        "root", place.alias("seq"), "ts_ns", F.lit(HEAD).alias("check_name"),
        F.concat("root", F.lit("/"), F.col("segment").cast("string")).alias("entry_id"),
        F.to_json(F.struct(*facts)).alias("metadata"))
    rows = heads.unionByName(closing).select(
        F.concat("root", F.lit(HEADS)).alias("chain_id"), "seq", "ts_ns", F.lit("policy").alias("owner_type"),
        F.lit("segments").alias("owner_id"), F.array(F.lit("policy:segments")).alias("approval_chain"), "check_name",
        F.lit("allow").alias("decision"), F.lit("segment sealed").alias("reason"), "entry_id",
        F.lit("").alias("request_fingerprint"), "metadata")
    return ledger.seal(rows, ring, anchor_backend=anchor_backend)


def verify_linked(segments: DataFrame, heads: DataFrame, ring: KeyRing) -> DataFrame:
    """All breaks: chain_id, index, entry_id, kind.

    Breaks inside segments and in the chain of heads are those of ``verify_chain``.
    Against heads whose own MAC holds: ``segment_missing``, ``segment_unlisted``
    (rows without a head), ``segment_changed`` (another number of rows or last
    MAC), and ``heads_open`` for a chain whose closing row is gone or has another
    number of heads.  An index is a row's position, or the segment's number.
    """
    facts = F.from_json("metadata", "last_hmac string, rows long, segment long, segments long")
    trusted = ledger.self_status(heads, ring).where("self_kind is null").select(
        F.regexp_extract("chain_id", f"^(.*){HEADS}$", 1).alias("root"), "check_name", facts.alias("m"))
    listed = trusted.where(F.col("check_name") == HEAD).select(
        "root", F.col("m.segment").alias("segment"), F.col("m.rows").alias("head_rows"), F.col("m.last_hmac").alias("head_hmac"))
    both = _ends(segments).join(listed, ["root", "segment"], "full_outer")
    kind = (
        F.when(F.col("rows").isNull(), "segment_missing").when(F.col("head_rows").isNull(), "segment_unlisted")
        .when((F.col("rows") != F.col("head_rows")) | ~F.col("last_hmac").eqNullSafe(F.col("head_hmac")), "segment_changed"))
    compared = both.select(
        F.concat("root", F.lit("/"), F.lpad(F.col("segment").cast("string"), 8, "0")).alias("chain_id"),
        F.col("segment").alias("index"), F.lit("").alias("entry_id"), kind.alias("kind")).where("kind is not null")
    closed = trusted.where(F.col("check_name") == CLOSED).select("root", F.col("m.segments").alias("segments"))
    roots = both.groupBy("root").agg(F.count("head_rows").alias("heads"))
    still_open = roots.join(closed, "root", "left").where(~F.col("heads").eqNullSafe(F.col("segments"))).select(
        F.concat("root", F.lit(HEADS)).alias("chain_id"), F.col("heads").alias("index"), F.lit("").alias("entry_id"),
        F.lit("heads_open").alias("kind"))
    own = [ledger.verify_chain(df, ring).select("chain_id", "index", "entry_id", "kind") for df in (segments, heads)]
    return own[0].union(own[1]).union(compared).union(still_open)

"""Compaction of old rows into archives, and verification across them."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateledger import schema as S
from gateledger.functions.crypto import KeyRing, canonical_json
from gateledger.functions.times import iso_micros, ns_to_timestamp
from gateledger.operators.filters import before_cutoff, is_marker_shaped, is_marker_trusted
from gateledger.operators.ledger import breaks_of, seal, self_status
from gateledger.operators.merkle import merkle_roots
from gateledger.operators.ordered import BLOCK_ROWS, halo_blocks, running_sum

MARKER_DOMAIN = "gateledger-compaction-marker-v1"


@dataclass(frozen=True)
class Compaction:
    """What a compaction produces; nothing is written yet."""

    entries: DataFrame
    header: DataFrame
    marker: DataFrame
    retained: DataFrame
    live: DataFrame


def archive_stats(entries: DataFrame) -> DataFrame:
    """(archive_format_version, range_start, range_end, entry_count)."""
    at = lambda pick: iso_micros(ns_to_timestamp(pick("ts_ns", "seq")))
    return entries.agg(
        F.lit(S.ARCHIVE_VERSION).alias("archive_format_version"),
        at(F.min_by).alias("range_start"),
        at(F.max_by).alias("range_end"),
        F.count(F.lit(1)).alias("entry_count"),
    )


def compact(
    df: DataFrame,
    before: datetime,
    ring: KeyRing,
    archive_path: str,
    marker_ts_ns: int,
    domain: str = MARKER_DOMAIN,
    entry_id: str | None = None,
) -> Compaction | None:
    """Split one chain at a cutoff; None when no row is old enough.

    Refuses a range holding a marker-shaped row, trusted or not, and a range
    that is not a prefix of the chain.
    """
    eligible = df.where(before_cutoff(F.col("ts_ns"), before))
    retained = df.where(~before_cutoff(F.col("ts_ns"), before))
    shaped = is_marker_shaped(F.col("check_name"), F.col("metadata"))
    facts = df.agg(
        F.count(F.when(before_cutoff(F.col("ts_ns"), before), 1)).alias("old"),
        F.max(F.when(before_cutoff(F.col("ts_ns"), before), F.col("seq"))).alias("last"),
        F.count(F.when(before_cutoff(F.col("ts_ns"), before) & shaped, 1)).alias("markers"),
        F.max_by(
            F.when(before_cutoff(F.col("ts_ns"), before), F.col("hmac")),
            F.when(before_cutoff(F.col("ts_ns"), before), F.col("seq")),
        ).alias("bridge"),
        F.first("chain_id").alias("chain_id"),
    ).first()
    if not facts.old:
        return None
    if facts.markers:
        raise ValueError("the range holds a compaction marker; choose another cutoff")
    if facts.last != facts.old - 1:
        raise ValueError("the rows before the cutoff are not a prefix of the chain")
    root = merkle_roots(eligible, "chain_id", "seq", "hmac").first().root
    stats = archive_stats(eligible).first()
    payload = {
        "archive_format_version": S.ARCHIVE_VERSION,
        "archive_path": archive_path,
        "compacted_count": facts.old,
        "merkle_root": root,
        "range_end": stats.range_end,
        "range_start": stats.range_start,
    }
    header = df.sparkSession.createDataFrame(
        [(S.ARCHIVE_VERSION, stats.range_start, stats.range_end, facts.old, root)],
        "archive_format_version int, range_start string, range_end string, "
        "entry_count long, merkle_root string",
    )
    marker = sign_marker(
        df, payload, ring, facts.chain_id, facts.bridge, marker_ts_ns, domain, entry_id
    )
    shift = F.col("seq") - facts.old + 1
    live = marker.unionByName(retained.withColumn("seq", shift).select(marker.columns))
    entries = eligible.withColumn("archive_seq", F.col("seq"))
    return Compaction(entries, header, marker, retained, live)


def sign_marker(
    df: DataFrame, payload: dict, ring: KeyRing, chain_id: str, bridge: str, ts_ns: int,
    domain: str = MARKER_DOMAIN, entry_id: str | None = None,
) -> DataFrame:
    """The one marker row that replaces the archived rows."""
    import hashlib
    import hmac

    message = domain.encode() + b"\0" + canonical_json(payload).encode()
    signature = hmac.new(ring.active.secret, message, hashlib.sha256).hexdigest()
    metadata = {S.MARKER_FIELD: {**payload, S.MARKER_SIGNATURE_FIELD: signature}}
    spark = df.sparkSession
    row = spark.createDataFrame(
        [(
            chain_id, 0, ts_ns, "policy", "audit-compactor", ["policy:audit-compactor"],
            S.MARKER_CHECK, "allow",
            f"compacted {payload['compacted_count']} entries into "
            f"{payload['archive_path'].rsplit('/', 1)[-1]}",
            entry_id or str(uuid.uuid4()), "", json.dumps(metadata),
        )],
        "chain_id string, seq long, ts_ns long, owner_type string, owner_id string, "
        "approval_chain array<string>, check_name string, decision string, reason string, "
        "entry_id string, request_fingerprint string, metadata string",
    )
    links = spark.createDataFrame([(chain_id, bridge)], "chain_id string, link string")
    return seal(row, ring, links).withColumn("ts_ns", F.col("ts_ns").cast("decimal(20,0)"))


def trim_before(df: DataFrame, n: int) -> DataFrame:
    """Drop the first ``n`` rows of each chain and renumber the rest."""
    if n < 0:
        raise ValueError("cannot trim a negative number of rows")
    return df.where(F.col("seq") >= n).withColumn("seq", F.col("seq") - n)


def _base(path):
    return F.regexp_extract(path, r"([^/]*)$", 1)


def verify_with_archives(
    live: DataFrame,
    headers: DataFrame,
    entries: DataFrame,
    ring: KeyRing,
    domain: str = MARKER_DOMAIN,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Breaks of one logical chain: archives in place of their markers.

    ``headers``/``entries`` come from ``read_archives``.  A marker finds its
    archive by full path, else by file name.  Logical positions are counted
    from per-marker archive sizes, so archived and live rows stay distributed.
    """
    shaped = is_marker_shaped(F.col("check_name"), F.col("metadata"))
    marked = live.withColumn("_marker", shaped)
    payload = lambda name: F.get_json_object("metadata", f"$.{S.MARKER_FIELD}.{name}")
    markers = marked.where("_marker").select(
        "chain_id", F.col("seq").alias("_mseq"), "entry_id", F.col("prev_hmac").alias("_mprev"),
        F.coalesce(payload("archive_path"), F.lit("")).alias("_want"),
        F.coalesce(payload("merkle_root"), F.lit("")).alias("_root"),
        F.coalesce(payload("compacted_count").cast("long"), F.lit(0)).alias("_claimed"),
    )
    heads = headers.select(
        F.col("archive_path").alias("_path"), F.col("error").alias("_error"),
        F.col("merkle_root").alias("_hroot"), F.col("stored_root").alias("_sroot"),
    ).withColumn("_name", _base(F.col("_path")))
    exact = heads.select(F.col("_path").alias("_want"), F.col("_path").alias("_p1"))
    named = heads.groupBy(F.col("_name").alias("_n2")).agg(F.min("_path").alias("_p2"))
    found = (
        markers.withColumn("_n2", _base(F.col("_want")))
        .join(exact, "_want", "left")
        .join(named, "_n2", "left")
        .withColumn("_path", F.coalesce("_p1", "_p2"))
        .join(heads.drop("_name"), "_path", "left")
    )
    entries = entries.drop("chain_id", "seq")
    sizes = entries.groupBy("archive_path").agg(
        F.count(F.lit(1)).alias("_size"),
        F.max_by("hmac", "archive_seq").alias("_last_hmac"),
    ).withColumnRenamed("archive_path", "_path")
    roots = merkle_roots(entries, "archive_path", "archive_seq", "hmac").select(
        F.col("archive_path").alias("_path"), F.col("root").alias("_rroot")
    )
    resolved = (
        found.join(sizes, "_path", "left").join(roots, "_path", "left")
        .withColumn(
            "_state",
            F.when(F.col("_path").isNull(), "archive_missing")
            .when(F.col("_error").isNotNull(), "archive_format_invalid"),
        )
        .withColumn("_rows", F.when(F.col("_state").isNull(), F.coalesce("_size", F.lit(0))).otherwise(0))
    )
    # One row per compaction ever made: the running size is a small window.
    order = Window.partitionBy("chain_id").orderBy("_mseq")
    placed = resolved.withColumn("_grown", F.sum("_rows").over(order)).cache()
    steps = placed.select("chain_id", "_mseq", "_rows", "_grown", "_state", "_last_hmac")
    shift = steps.select("chain_id", F.col("_mseq").alias("seq"), F.col("_rows").alias("_extra"))
    widened = marked.join(shift, ["chain_id", "seq"], "left").withColumn(
        "_extra", F.coalesce("_extra", F.lit(0))
    )
    numbered = running_sum(widened, ["chain_id"], "seq", F.col("_extra"), "_before", block_rows)
    live_rows = numbered.withColumn("index", F.col("seq") + F.col("_before")).join(
        steps.select("chain_id", F.col("_mseq").alias("seq"), "_state",
                     F.coalesce("_last_hmac", F.lit("")).alias("_bridge")),
        ["chain_id", "seq"], "left",
    )
    archived = (
        entries.join(
            placed.where("_state is null").select(
                "chain_id", F.col("_path").alias("archive_path"), "_mseq", "_grown", "_rows"
            ),
            "archive_path",
        )
        .withColumn("index", F.col("_mseq") + F.col("_grown") - F.col("_rows") + F.col("archive_seq"))
    )
    common = ["chain_id", "index", "entry_id", "metadata", "check_name", "prev_hmac", "hmac", "raw_line"]
    rows = live_rows.select(
        *common,
        F.when(~F.col("_marker"), "live").when(F.col("_state").isNull(), "marker")
        .otherwise(F.col("_state")).alias("_role"),
        F.when(F.col("_marker") & F.col("_state").isNull(), F.col("_bridge"))
        .otherwise(F.col("hmac")).alias("_carry"),
    ).unionByName(
        archived.select(*common, F.lit("archived").alias("_role"), F.col("hmac").alias("_carry"))
    )
    blocks = halo_blocks(rows, "index", 1, block_rows)
    seen = Window.partitionBy("chain_id", "_block").orderBy("index")
    linked = (
        blocks.withColumn(
            "_expected",
            F.when(F.col("_role") == "marker", F.col("_carry"))
            .otherwise(F.coalesce(F.lag("_carry").over(seen), F.lit(""))),
        )
        .withColumn("_prev_role", F.lag("_role").over(seen))
        .where("not _context")
    )
    unchecked = F.col("_role").isin("archive_missing", "archive_format_invalid")
    # One mismatch right after an unreadable archive is its consequence.
    forgiven = (F.col("_role") == "live") & (F.col("_prev_role") == "archive_format_invalid")
    status = (
        self_status(linked, ring)
        .withColumn("expected_prev", F.col("_expected"))
        .withColumn("_mismatch", (F.col("prev_hmac") != F.col("_expected")) & ~unchecked)
        .withColumn("link_ok", ~F.col("_mismatch"))
    )
    breaks = breaks_of(status.where(~(F.coalesce(forgiven, F.lit(False)) & F.col("_mismatch"))), ring, "index")
    # A forgiven row still shows key problems, just not the two mismatches.
    keyed = status.where(F.coalesce(forgiven, F.lit(False)) & F.col("_mismatch")).where(
        "self_kind is not null and self_kind <> 'self_mismatch'"
    ).withColumn("link_ok", F.lit(True))
    position = placed.select(
        "chain_id", (F.col("_mseq") + F.col("_grown")).alias("index"), "entry_id",
        F.explode(F.array_compact(F.array(
            F.when(F.col("_state").isNotNull(), F.struct(F.col("_state").alias("kind"),
                   F.coalesce("_error", F.lit("archive not found")).alias("detail"))),
            F.when(F.col("_state").isNull() & ~(
                F.col("_rroot").eqNullSafe(F.col("_root")) & F.col("_hroot").eqNullSafe(F.col("_root"))
                & F.col("_sroot").eqNullSafe(F.col("_root"))),
                F.struct(F.lit("merkle_mismatch").alias("kind"),
                         F.lit("archive root differs from the marker").alias("detail"))),
            F.when(F.col("_state").isNull() & (F.col("_rows") != F.col("_claimed")),
                   F.struct(F.lit("archive_format_invalid").alias("kind"),
                            F.lit("archive size differs from the marker").alias("detail"))),
        ))).alias("_b"),
    ).select("chain_id", "index", "entry_id", "_b.kind", "_b.detail", F.lit(-1).alias("_order"))
    return (
        breaks.unionByName(breaks_of(keyed, ring, "index"))
        .unionByName(position)
        .orderBy("chain_id", "index", "_order")
        .drop("_order")
    )


def untrusted_markers(live: DataFrame, ring: KeyRing, domain: str = MARKER_DOMAIN) -> DataFrame:
    """Marker-shaped rows whose signature no ring key explains."""
    shaped = is_marker_shaped(F.col("check_name"), F.col("metadata"))
    trusted = is_marker_trusted(F.col("check_name"), F.col("metadata"), ring, domain)
    return live.where(shaped & ~trusted)

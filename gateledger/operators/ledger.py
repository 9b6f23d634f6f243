"""Sealing and verifying HMAC-linked decision chains.

Each row stores the MAC of its predecessor, so every MAC can be recomputed on
its own; only the comparison with the neighbouring row needs order, and that
runs over bounded blocks.  One chain holding most of the log is no special case
for verification.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger import schema as S
from gateledger.functions.crypto import (
    KeyRing,
    canonical_json,
    resigned_text_udf,
    ring_hmac,
    signed_text,
)
from gateledger.operators.ordered import BLOCK_ROWS, halo_blocks, running_sum
from gateledger.session import spread

SLICE_ROWS = 2_000

# --------------------------------------------------------------------------
# Sealing
# --------------------------------------------------------------------------


def canonical_parts(anchor_backend: str | None, key_id: str):
    """Arrow function: row fields → the canonical text around ``prev_hmac``.

    ``metadata`` gains the signing key id and the anchor receipt here, so this
    part runs in parallel over all rows of all chains.
    """
    stamp = {S.KEY_ID_FIELD: key_id}
    if anchor_backend:
        stamp[S.ANCHOR_FIELD] = {"backend": anchor_backend, "success": True}

    parts = T.StructType(
        [
            T.StructField("before", T.StringType()),
            T.StructField("middle", T.StringType()),
            T.StructField("after", T.StringType()),
            T.StructField("metadata", T.StringType()),
        ]
    )

    quote, loads, canonical = json.encoder.encode_basestring, json.loads, canonical_json

    @F.pandas_udf(parts)
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        texts = []
        for row in rows.itertuples(index=False):
            metadata = canonical({**loads(row.metadata or "{}"), **stamp})
            chain = "[" + ",".join(map(quote, row.approval_chain)) + "]"
            before = (
                f'{{"approval_chain":{chain}'
                f',"check_name":{quote(row.check_name)}'
                f',"decision":{quote(row.decision)}'
                f',"entry_id":{quote(row.entry_id)}'
            )
            middle = (
                f',"metadata":{metadata}'
                f',"owner_id":{quote(row.owner_id)}'
                f',"owner_type":{quote(row.owner_type)}'
                ',"prev_hmac":"'
            )
            after = (
                f'","reason":{quote(row.reason)}'
                f',"request_fingerprint":{quote(row.request_fingerprint)}'
                f',"ts_ns":{int(row.ts_ns)}}}'
            )
            texts.append((before, middle, after, metadata))
        return pd.DataFrame(texts, columns=["before", "middle", "after", "metadata"])

    return build


def _chain_macs(secret: bytes):
    """Walk sorted Arrow batches, carrying one MAC per chain across batches."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = hmac.new(secret, digestmod=hashlib.sha256)
        chain, prev = None, ""
        for whole in batches:
            # Rows pass as they came; only a slice's texts become Python values.
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                before_macs, macs = [], []
                columns = zip(*(
                    batch.column(c).to_pylist() for c in ("chain_id", "link", "before", "middle", "after")))
                for chain_id, link, before, middle, after in columns:
                    if chain_id != chain:
                        chain, prev = chain_id, link or ""
                    before_macs.append(prev)
                    mac = start.copy()
                    mac.update(f"{before}{middle}{prev}{after}".encode())
                    prev = mac.hexdigest()
                    macs.append(prev)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(before_macs, pa.string()), pa.array(macs, pa.string())],
                    names=[*batch.schema.names, "prev_hmac", "hmac"])

    return walk


def seal(
    df: DataFrame,
    ring: KeyRing,
    links: DataFrame | None = None,
    segment_rows: int | None = None,
    anchor_backend: str | None = "noop",
    tasks: int | None = None,
) -> DataFrame:
    """Sign rows of each chain in ``seq`` order under the active key.

    A chain is sequential by definition: each MAC covers the one before.  Rows
    stream through in sorted Arrow batches with one MAC carried, so memory does
    not grow with the chain, and chains run side by side.  ``segment_rows``
    cuts long chains into shorter ones (``chain/00000001``) so that one hot chain
    is sealed by many tasks; ``segments.seal_heads`` links and signs these.  ``links`` (chain_id, link) continues
    existing chains.  ``tasks`` deals rows out before the canonical text is built.
    """
    if segment_rows:
        part = F.floor(F.col("seq") / segment_rows)
        df = df.withColumn(
            "chain_id",
            F.concat(F.col("chain_id"), F.lit("/"), F.lpad(part.cast("string"), 8, "0")),
        ).withColumn("seq", F.col("seq") - part * segment_rows)
    fields = ["approval_chain", "check_name", "decision", "entry_id", "metadata",
              "owner_id", "owner_type", "reason", "request_fingerprint", "ts_ns"]
    build = canonical_parts(anchor_backend, ring.active.key_id)
    parts = spread(df, tasks).withColumn(
        "_p", build(F.struct(*[F.col(f) for f in fields]))
    )
    if links is not None:
        parts = parts.join(links.select("chain_id", "link"), "chain_id", "left")
    else:
        parts = parts.withColumn("link", F.lit("").cast("string"))
    slim = parts.select(
        "chain_id", "seq", "link", "entry_id", "ts_ns", "owner_type", "owner_id",
        "approval_chain", "check_name", "decision", "reason", "request_fingerprint",
        "_p.metadata", "_p.before", "_p.middle", "_p.after",
    )
    # A fixed count: coalescing small shuffles would serialise whole chains.
    chains = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartition(chains, "chain_id").sortWithinPartitions("chain_id", "seq")
    schema = T.StructType(
        [
            *ordered.schema.fields,
            T.StructField("prev_hmac", T.StringType()),
            T.StructField("hmac", T.StringType()),
        ]
    )
    signed = ordered.mapInArrow(_chain_macs(ring.active.secret), schema)
    line = F.concat("before", F.lit(',"hmac":"'), "hmac", F.lit('"'), "middle", "prev_hmac", "after")
    return signed.select(
        "chain_id", "seq", *[name for name, _ in S.ENTRY_FIELDS], line.alias("raw_line")
    )


def next_link(df: DataFrame) -> DataFrame:
    """(chain_id, link): what the next appended row must carry as ``prev_hmac``."""
    from gateledger.operators.filters import is_marker_shaped

    marker = is_marker_shaped(F.col("check_name"), F.col("metadata"))
    link = F.when(marker, F.col("prev_hmac")).otherwise(F.col("hmac"))
    return df.groupBy("chain_id").agg(F.max_by(link, "seq").alias("link"))


# --------------------------------------------------------------------------
# Verifying
# --------------------------------------------------------------------------


def self_status(df: DataFrame, ring: KeyRing) -> DataFrame:
    """Add ``self_kind`` (null when the row's own MAC holds) and ``expected_hmac``.

    The fast path signs the stored line natively.  Only rows it rejects are
    re-serialised in Python (equivalent lines in another layout still hold).
    """
    key_value = F.try_variant_get(
        F.try_parse_json("metadata"), f"$.{S.KEY_ID_FIELD}", "variant"
    )
    key_kind = F.schema_of_variant(key_value)
    key_id = F.when(key_kind == "STRING", key_value.cast("string"))
    known = key_id.isin(ring.ids())
    staged = (
        df.withColumn("_kind", key_kind)
        .withColumn("key_id", key_id)
        .withColumn("_fast", F.when(known, ring_hmac(ring, key_id, signed_text(F.col("raw_line")))))
    )
    retry = F.when(known & ~F.col("_fast").eqNullSafe(F.col("hmac")), F.col("raw_line"))
    retried = staged.withColumn("_again", resigned_text_udf(retry))
    expected = F.when(
        F.col("_again").isNotNull(), ring_hmac(ring, F.col("key_id"), F.col("_again"))
    ).otherwise(F.col("_fast"))
    kind = (
        F.when(
            F.col("_kind").isNull() | (F.col("_kind") == "VOID") | (F.col("key_id") == ""),
            "missing_key_id",
        )
        .when(F.col("_kind") != "STRING", "malformed_line")
        .when(~F.col("key_id").isin(ring.ids()), "unknown_key")
        .when(~F.col("expected_hmac").eqNullSafe(F.col("hmac")), "self_mismatch")
    )
    return (
        retried.withColumn("expected_hmac", expected)
        .withColumn("self_kind", kind)
        .drop("_kind", "_fast", "_again")
    )


def link_status(
    df: DataFrame, pos: str = "seq", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``expected_prev`` and ``link_ok`` (``prev_hmac`` equals it).

    ``pos`` is dense per chain, so blocks of it with one row of context replace
    a window over the whole chain.
    """
    blocks = halo_blocks(df, pos, 1, block_rows)
    order = Window.partitionBy("chain_id", "_block").orderBy(pos)
    return (
        blocks.withColumn("expected_prev", F.coalesce(F.lag("hmac").over(order), F.lit("")))
        .where("not _context")
        .withColumn("link_ok", F.col("prev_hmac") == F.col("expected_prev"))
        .drop("_block", "_context")
    )


def _short(mac: Column) -> Column:
    return F.concat(F.substring(mac, 1, 16), F.lit("..."))


def chain_status(df: DataFrame, ring: KeyRing, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per-row verdicts: ``link_ok``, ``self_kind``, ``self_ok``."""
    status = link_status(self_status(df, ring), block_rows=block_rows)
    return status.withColumn("self_ok", F.col("self_kind").isNull())


def breaks_of(status: DataFrame, ring: KeyRing, pos: str = "seq") -> DataFrame:
    """Explode per-row verdicts into break rows.

    A link break hides the self mismatch of the same row (both follow from one
    changed byte), but not a key problem.
    """
    link = F.when(
        ~F.col("link_ok"),
        F.struct(
            F.lit(0).alias("order"),
            F.lit("link_mismatch").alias("kind"),
            F.concat(
                F.lit("prev_hmac="), _short(F.col("prev_hmac")),
                F.lit(" does not match previous hmac="),
                F.when(F.col("expected_prev") == "", "(empty)")
                .otherwise(_short(F.col("expected_prev"))),
            ).alias("detail"),
        ),
    )
    known = ", ".join(ring.ids())
    detail = (
        F.when(F.col("self_kind") == "missing_key_id",
               F.lit(f"no {S.KEY_ID_FIELD} in metadata"))
        .when(F.col("self_kind") == "malformed_line",
              F.lit(f"{S.KEY_ID_FIELD} must be a string"))
        .when(F.col("self_kind") == "unknown_key",
              F.concat(F.lit("key "), F.col("key_id"), F.lit(f" is not in the ring ({known})")))
        .otherwise(
            F.concat(F.lit("recomputed hmac="), _short(F.col("expected_hmac")),
                     F.lit(" does not match stored hmac="), _short(F.col("hmac"))))
    )
    shown = F.col("self_kind").isNotNull() & (
        (F.col("self_kind") != "self_mismatch") | F.col("link_ok")
    )
    own = F.when(
        shown,
        F.struct(
            F.lit(1).alias("order"),
            F.col("self_kind").alias("kind"),
            detail.alias("detail"),
        ),
    )
    return (
        status.where(~F.col("link_ok") | F.col("self_kind").isNotNull())
        .withColumn("_b", F.explode(F.array_compact(F.array(link, own))))
        .select(
            "chain_id",
            F.col(pos).cast("long").alias("index"),
            "entry_id",
            F.col("_b.kind").alias("kind"),
            F.col("_b.detail").alias("detail"),
            F.col("_b.order").alias("_order"),
        )
    )


def collapse_cascades(status: DataFrame, pos: str = "seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs of consecutive link breaks → the first break plus one summary row.

    Returns (chain_id, index, kind, suppressed).  A run starts where a broken
    link follows an intact one; run numbers come from block totals and runs
    are then counted with map-side partial sums.
    """
    blocks = halo_blocks(status.select("chain_id", pos, "link_ok"), pos, 1, block_rows)
    order = Window.partitionBy("chain_id", "_block").orderBy(pos)
    broken = (
        blocks.withColumn("_before", F.coalesce(F.lag("link_ok").over(order), F.lit(True)))
        .where("not _context and not link_ok")
        .withColumn("_starts", F.col("_before").cast("int"))
    )
    numbered = running_sum(
        broken, ["chain_id"], pos, F.col("_starts"), "_run", block_rows
    )
    runs = numbered.groupBy("chain_id", "_run").agg(
        F.min(pos).alias("first"), F.count(F.lit(1)).alias("n")
    )
    rows = F.array_compact(
        F.array(
            F.struct(F.col("first").alias("index"), F.lit("link_mismatch").alias("kind"),
                     F.lit(0).cast("long").alias("suppressed")),
            F.when(
                F.col("n") > 1,
                F.struct((F.col("first") + 1).alias("index"),
                         F.lit("cascade_suppressed").alias("kind"),
                         (F.col("n") - 1).alias("suppressed")),
            ),
        )
    )
    return runs.select("chain_id", F.inline(rows))


def verify_chain(
    df: DataFrame,
    ring: KeyRing,
    malformed: DataFrame | None = None,
    compact_breaks: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All integrity breaks of a decisions table, in chain order."""
    status = chain_status(df, ring, block_rows)
    breaks = breaks_of(status, ring)
    if compact_breaks:
        runs = collapse_cascades(status, block_rows=block_rows)
        first = runs.where("kind = 'link_mismatch'").select("chain_id", "index")
        kept_links = breaks.where("kind = 'link_mismatch'").join(
            first, ["chain_id", "index"], "left_semi"
        )
        summaries = runs.where("kind = 'cascade_suppressed'").select(
            "chain_id", "index", F.lit("").alias("entry_id"), "kind",
            F.concat(
                F.col("suppressed").cast("string"),
                F.lit(" following rows report the same link break"),
            ).alias("detail"),
            F.lit(2).alias("_order"),
        )
        breaks = (
            breaks.where("kind <> 'link_mismatch'")
            .unionByName(kept_links.select(breaks.columns))
            .unionByName(summaries)
        )
    if malformed is not None:
        ends = df.groupBy("chain_id").agg((F.max("seq") + 1).alias("_next"))
        bad = malformed.join(ends, "chain_id", "left").select(
            "chain_id",
            F.coalesce("_next", F.lit(0)).cast("long").alias("index"),
            F.lit("").alias("entry_id"),
            F.lit("malformed_line").alias("kind"),
            F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(": "),
                     F.col("parse_error")).alias("detail"),
            F.lit(3).alias("_order"),
        )
        breaks = breaks.unionByName(bad)
    return breaks.orderBy("chain_id", "index", "_order").drop("_order")


def verification_report(df: DataFrame, ring: KeyRing, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per chain: totals, break count, last row whose own MAC holds.

    The last good row advances past link breaks; -1 and "" mean none.
    """
    status = chain_status(df, ring, block_rows)
    n_breaks = (~F.col("link_ok")).cast("int") + (
        F.col("self_kind").isNotNull()
        & ((F.col("self_kind") != "self_mismatch") | F.col("link_ok"))
    ).cast("int")
    return (
        status.groupBy("chain_id")
        .agg(
            F.count(F.lit(1)).alias("total_entries"),
            F.sum(n_breaks).alias("breaks"),
            F.coalesce(F.max(F.when(F.col("self_ok"), F.col("seq"))), F.lit(-1)).alias(
                "last_good_index"
            ),
            F.coalesce(
                F.max_by(F.when(F.col("self_ok"), F.col("hmac")),
                         F.when(F.col("self_ok"), F.col("seq"))),
                F.lit(""),
            ).alias("last_good_hmac"),
        )
        .withColumn("ok", F.col("breaks") == 0)
    )


BREAK_HINTS = {
    "merkle_mismatch": "the marker's root no longer matches the archive; one of them changed",
    "archive_missing": "point the verification at the folder holding the archive",
    "archive_format_invalid": "the archive is malformed; restore a known-good copy",
}


def break_counts(breaks: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for pair in BREAK_HINTS.items() for x in pair]
    hint = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("kind")), F.lit(""))
    return (
        breaks.groupBy("chain_id", "kind")
        .agg(F.count(F.lit(1)).alias("breaks"))
        .withColumn("hint", hint)
    )


def first_breaks(breaks: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` breaks for display and the count of the remainder."""
    head = breaks.orderBy("chain_id", "index").limit(limit)
    rest = breaks.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("more"))
    return head, rest


def key_eras(df: DataFrame, ring: KeyRing) -> DataFrame:
    """Rows, span and MAC failures per signing key id."""
    status = self_status(df, ring)
    return status.groupBy("chain_id", "key_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.count("self_kind").alias("failed"),
    )


def unknown_key_rows(df: DataFrame, ring: KeyRing) -> DataFrame:
    """Rows naming a key id outside the ring, as an anti join."""
    spark = df.sparkSession
    known = spark.createDataFrame([(k,) for k in ring.ids()], "key_id string")
    key_id = F.get_json_object("metadata", f"$.{S.KEY_ID_FIELD}")
    named = df.withColumn("key_id", key_id).where(F.col("key_id") != "")
    return named.join(F.broadcast(known), "key_id", "left_anti")


def anchor_coverage(df: DataFrame) -> DataFrame:
    """Rows per anchor backend and outcome."""
    base = f"$.{S.ANCHOR_FIELD}."
    return (
        df.select(
            F.get_json_object("metadata", base + "backend").alias("backend"),
            F.get_json_object("metadata", base + "success").alias("success"),
        )
        .groupBy(F.coalesce("backend", F.lit("none")).alias("backend"),
                 F.coalesce(F.col("success") == "true", F.lit(False)).alias("success"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )

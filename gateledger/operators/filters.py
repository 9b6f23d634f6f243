"""Row predicates and small projections over decisions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger import schema as S
from gateledger.functions.crypto import KeyRing, hmac_sha256
from gateledger.functions.principals import owner_string
from gateledger.functions.text import control_char_clean
from gateledger.functions.times import epoch_ns, parse_duration, ts_literal

_FILTERABLE = ("check", "decision", "owner_type")


def filter_decisions(df: DataFrame, **equals: str) -> DataFrame:
    """Keep rows equal on every named field; a filter on an unknown field fails."""
    for field, wanted in equals.items():
        if field not in _FILTERABLE:
            raise ValueError(f"unknown filter field {field!r}; use one of {_FILTERABLE}")
        column = "check_name" if field == "check" else field
        df = df.where(F.col(column) == wanted)
    return df


def current_window(ts: Column, now: datetime, since: str) -> Column:
    """Both ends belong to the current window."""
    return ts.between(ts_literal(now - parse_duration(since)), ts_literal(now))


def prior_window(ts: Column, now: datetime, since: str) -> Column:
    """The equally long window just before, its end excluded."""
    span = parse_duration(since)
    return (ts >= ts_literal(now - 2 * span)) & (ts < ts_literal(now - span))


def before_cutoff(ts_ns: Column, cutoff: datetime) -> Column:
    return ts_ns < F.lit(epoch_ns(cutoff)).cast("decimal(20,0)")


def pre_pipeline_rows(df: DataFrame, keep: bool = False) -> DataFrame:
    """Drop (or keep only) refusals recorded before any check ran."""
    flag = F.coalesce(
        F.get_json_object("metadata", "$._pre_pipeline_refusal") == "true", F.lit(False)
    )
    return df.where(flag if keep else ~flag)


def lookup_entry(df: DataFrame, entry_id: str) -> DataFrame:
    """First row in chain order whose id matches, ignoring case and blanks."""
    wanted = entry_id.strip().lower()
    return df.where(F.lower(F.trim("entry_id")) == wanted).orderBy("seq").limit(1)


def tail(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """Last ``n`` rows in chain order, oldest first."""
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def gated_path(path: Column) -> Column:
    return F.when(path.isin(*S.GATED_PATHS), "gated").otherwise("unsupported")


def effective_check(check_name: Column, metadata: Column) -> Column:
    """The check that fired, rather than the stage wrapper that recorded it."""
    return F.coalesce(F.get_json_object(metadata, "$._check_name"), check_name)


def flatten_owner(df: DataFrame, owner: str = "owner") -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != owner],
        F.col(f"{owner}.owner_type").alias("owner_type"),
        F.col(f"{owner}.owner_id").alias("owner_id"),
        F.col(f"{owner}.approval_chain").alias("approval_chain"),
    )


def split_metadata(metadata: Column) -> tuple[Column, Column]:
    """(visible, internal) maps; internal keys start with an underscore."""
    return (
        F.map_filter(metadata, lambda k, _: ~F.startswith(k, F.lit("_"))),
        F.map_filter(metadata, lambda k, _: F.startswith(k, F.lit("_"))),
    )


def display_owner(owner_type: Column, owner_id: Column) -> Column:
    return control_char_clean(owner_string(owner_type, owner_id))


def is_marker_shaped(check_name: Column, metadata: Column) -> Column:
    """Compaction sentinel with a non-empty signature."""
    signature = F.try_variant_get(
        F.try_parse_json(metadata),
        f"$.{S.MARKER_FIELD}.{S.MARKER_SIGNATURE_FIELD}",
        "variant",
    )
    text = signature.cast("string")
    is_text = F.schema_of_variant(signature) == "STRING"
    return F.coalesce(
        (check_name == S.MARKER_CHECK) & is_text & (F.length(text) > 0), F.lit(False)
    )


def marker_payload_text(metadata: Column) -> Column:
    """Canonical JSON of the six signed marker fields (keys sorted)."""
    base = f"$.{S.MARKER_FIELD}."

    def text(name: str) -> Column:
        value = F.get_json_object(metadata, base + name)
        quoted = F.to_json(F.array(value))
        return F.substr(quoted, F.lit(2), F.length(quoted) - 2)

    def number(name: str) -> Column:
        return F.get_json_object(metadata, base + name).cast("bigint").cast("string")

    return F.concat(
        F.lit('{"archive_format_version":'), number("archive_format_version"),
        F.lit(',"archive_path":'), text("archive_path"),
        F.lit(',"compacted_count":'), number("compacted_count"),
        F.lit(',"merkle_root":'), text("merkle_root"),
        F.lit(',"range_end":'), text("range_end"),
        F.lit(',"range_start":'), text("range_start"),
        F.lit("}"),
    )


def is_marker_trusted(
    check_name: Column, metadata: Column, ring: KeyRing, domain: str
) -> Column:
    """The marker signature verifies under some ring key."""
    message = F.concat(F.lit(domain), F.lit("\0"), marker_payload_text(metadata))
    claimed = F.get_json_object(
        metadata, f"$.{S.MARKER_FIELD}.{S.MARKER_SIGNATURE_FIELD}"
    )
    genuine = F.lit(False)
    for key in ring.keys():
        genuine = genuine | F.coalesce(hmac_sha256(key, message) == claimed, F.lit(False))
    return is_marker_shaped(check_name, metadata) & genuine

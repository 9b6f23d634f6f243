"""Counts, tops and windowed deltas over decisions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger import schema as S
from gateledger.functions.crypto import anonymize_owner
from gateledger.functions.principals import owner_string
from gateledger.operators.filters import current_window, effective_check, prior_window

FIRING = ("block", "escalate", "redact")


def _owner() -> Column:
    return owner_string(F.col("owner_type"), F.col("owner_id"))


def count_decisions(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("decisions"))


def count_by(df: DataFrame, field: str) -> DataFrame:
    """Rows per check, owner, decision, owner_type or stage."""
    column = {
        "check": F.col("check_name"),
        "owner": _owner(),
        "decision": F.col("decision"),
        "owner_type": F.col("owner_type"),
        "stage": F.coalesce(F.col("stage"), F.lit("unknown")) if "stage" in df.columns
        else F.lit("unknown"),
    }[field]
    return df.groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("decisions"))


def count_by_all(df: DataFrame) -> DataFrame:
    """All five groupings from one scan, as GROUPING SETS."""
    view = df.select(
        F.col("check_name").alias("check"), _owner().alias("owner"), "decision", "owner_type",
        F.coalesce("stage", F.lit("unknown")).alias("stage"),
    )
    names = ["check", "owner", "decision", "owner_type", "stage"]
    columns = [F.col(n) for n in names]
    grouped = view.groupingSets([[c] for c in columns], *columns).agg(
        F.count(F.lit(1)).alias("decisions"),
        *[F.grouping(c).alias(f"_g_{n}") for c, n in zip(columns, names)],
    )
    field = F.coalesce(*[F.when(F.col(f"_g_{n}") == 0, n) for n in names])
    value = F.coalesce(*[F.when(F.col(f"_g_{n}") == 0, F.col(n)) for n in names])
    return grouped.select(field.alias("field"), value.alias("value"), "decisions")


def check_rollup(df: DataFrame) -> DataFrame:
    return df.rollup("check_name", "decision").agg(F.count(F.lit(1)).alias("decisions"))


def decision_distribution(df: DataFrame) -> DataFrame:
    """Count and share of each of the four decisions, zeros included."""
    counts = df.agg(
        *[F.count(F.when(F.col("decision") == d, 1)).alias(d) for d in S.DECISIONS]
    )
    total = F.greatest(sum((F.col(d) for d in S.DECISIONS), F.lit(0)), F.lit(1))
    rows = F.array(*[
        F.struct(F.lit(d).alias("decision"), F.col(d).alias("decisions"),
                 (F.col(d) * 100.0 / total).alias("percent"))
        for d in S.DECISIONS
    ])
    return counts.select(F.inline(rows))


def by_effective_check(df: DataFrame) -> DataFrame:
    """Name the check that fired instead of its stage wrapper, where rows tell it."""
    if "metadata" not in df.columns:
        return df
    return df.withColumn("check_name", effective_check(F.col("check_name"), F.col("metadata")))


def check_firings(df: DataFrame, approximate: bool = False, order: str = "seq") -> DataFrame:
    """Firings, distinct owners and per-decision counts per check.

    Exact distinct owners cost one extra shuffle on (check, owner);
    ``approximate`` keeps it to one pass.
    """
    owners = F.approx_count_distinct(_owner()) if approximate else F.count_distinct(_owner())
    return (
        by_effective_check(df).where(F.col("decision").isin(*FIRING))
        .groupBy("check_name")
        .agg(
            F.count(F.lit(1)).alias("firings"),
            owners.alias("distinct_owners"),
            *[F.count(F.when(F.col("decision") == d, 1)).alias(f"{d}s") for d in FIRING],
            F.min(order).alias("first_seen"),
        )
    )


def top_checks(df: DataFrame, n: int = 10, approximate: bool = False, order: str = "seq") -> DataFrame:
    """Most firings first; ties by first appearance."""
    return (
        check_firings(df, approximate, order)
        .orderBy(F.desc("firings"), "first_seen")
        .limit(n)
        .drop("first_seen")
    )


def blocked_owners(df: DataFrame, salt: str | None = None, order: str = "seq") -> DataFrame:
    """Blocks per owner; hashing happens after the aggregation."""
    counts = (
        df.where("decision = 'block'")
        .groupBy("owner_type", "owner_id")
        .agg(F.count(F.lit(1)).alias("blocks"), F.min(order).alias("first_seen"))
    )
    shown = anonymize_owner(_owner(), salt) if salt is not None else _owner()
    return counts.select(shown.alias("owner"), "blocks", "first_seen")


def top_blocked_owners(
    df: DataFrame, n: int = 10, salt: str | None = None, order: str = "seq"
) -> DataFrame:
    return (
        blocked_owners(df, salt, order)
        .orderBy(F.desc("blocks"), "first_seen")
        .limit(n)
        .drop("first_seen")
    )


def pct_delta(current: Column, prior: Column) -> Column:
    return (
        F.when((prior == 0) & (current > 0), F.lit(float("inf")))
        .when(prior == 0, F.lit(0.0))
        .otherwise((current - prior) / prior * 100.0)
    )


def _both_windows(df: DataFrame, now: datetime, since: str) -> DataFrame:
    """Rows of the two windows, tagged; one scan, pruned by time."""
    current = current_window(F.col("ts"), now, since)
    prior = prior_window(F.col("ts"), now, since)
    return df.where(current | prior).withColumn("_current", current)


def window_deltas(
    df: DataFrame, now: datetime, since: str, n: int = 10, parity: bool = False,
    order: str = "seq",
) -> DataFrame:
    """Top checks of the current window against the prior one.

    All prior counts are used; ``parity`` counts a check outside the prior top
    ``n`` as new.
    """
    tagged = _both_windows(by_effective_check(df), now, since).where(F.col("decision").isin(*FIRING))
    counts = tagged.groupBy("check_name").agg(
        F.count(F.when(F.col("_current"), 1)).alias("current"),
        F.count(F.when(~F.col("_current"), 1)).alias("prior"),
        F.min(F.when(F.col("_current"), F.col(order))).alias("_first"),
        F.min(F.when(~F.col("_current"), F.col(order))).alias("_first_prior"),
    )
    top = counts.where("current > 0").orderBy(F.desc("current"), "_first").limit(n)
    if parity:
        kept = (
            counts.where("prior > 0").orderBy(F.desc("prior"), "_first_prior").limit(n)
            .select("check_name", F.col("prior").alias("_kept"))
        )
        top = top.join(kept, "check_name", "left").withColumn(
            "prior", F.coalesce("_kept", F.lit(0))
        )
    return top.select(
        "check_name", "prior", "current", pct_delta(F.col("current"), F.col("prior")).alias("pct_delta")
    )


def new_blocked_owners(
    df: DataFrame, now: datetime, since: str, n: int = 10, salt: str | None = None,
    order: str = "seq",
) -> DataFrame:
    """Current top blocked owners that are not in the prior window's top."""
    current = df.where(current_window(F.col("ts"), now, since))
    prior = df.where(prior_window(F.col("ts"), now, since))
    return top_blocked_owners(current, n, salt, order).join(
        top_blocked_owners(prior, n, salt, order), "owner", "left_anti"
    )


def report_totals(df: DataFrame, now: datetime, since: str) -> DataFrame:
    """Decision counts of both windows in one conditional aggregation."""
    tagged = _both_windows(df, now, since)
    return tagged.groupBy("decision").agg(
        F.count(F.when(F.col("_current"), 1)).alias("current"),
        F.count(F.when(~F.col("_current"), 1)).alias("prior"),
    )


def report(
    df: DataFrame, now: datetime, since: str, salt: str | None = None,
    integrity: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The sections of the periodic report, each a small DataFrame."""
    current = df.where(current_window(F.col("ts"), now, since))
    sections = {
        "totals": report_totals(df, now, since),
        "distribution": decision_distribution(current),
        "top_checks": top_checks(current),
        "top_blocked_owners": top_blocked_owners(current, salt=salt),
        "check_deltas": window_deltas(df, now, since),
        "new_blocked_owners": new_blocked_owners(df, now, since, salt=salt),
    }
    if integrity is not None:
        sections["integrity"] = integrity
    return sections

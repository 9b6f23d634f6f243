"""The result struct every check returns, as a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gateledger import schema as S


def _metadata(values: dict[str, object]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    pairs: list[Column] = []
    for key, value in values.items():
        column = value if isinstance(value, Column) else F.lit(value)
        pairs += [F.lit(key), column.cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def result(
    decision: str | Column,
    reason: str | Column = "",
    replacement: Column | None = None,
    **metadata: object,
) -> Column:
    """Build a result; only redactions may carry replacement text."""
    if isinstance(decision, str):
        if decision not in S.DECISIONS:
            raise ValueError(f"unknown decision {decision!r}")
        if (replacement is not None) != (decision == "redact"):
            raise ValueError("replacement text belongs to redact results, and only there")
        decision = F.lit(decision)
    reason = F.lit(reason) if isinstance(reason, str) else reason
    text = replacement if replacement is not None else F.lit(None)
    return F.struct(
        decision.alias("decision"),
        reason.alias("reason"),
        _metadata(metadata).alias("metadata"),
        text.cast("string").alias("replacement"),
    )


def allow(reason: str | Column = "", **metadata: object) -> Column:
    return result("allow", reason, **metadata)


def block(reason: str | Column, **metadata: object) -> Column:
    return result("block", reason, **metadata)


def escalate(reason: str | Column, **metadata: object) -> Column:
    return result("escalate", reason, **metadata)


def redact(replacement: Column, reason: str | Column, **metadata: object) -> Column:
    return result("redact", reason, replacement, **metadata)


def first_result(*arms: Column) -> Column:
    """First non-null result."""
    return F.coalesce(*arms)


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def annotate(outcome: Column, check: str, stage: str) -> Column:
    """Record which check and stage a non-allow result came from."""
    stamp = F.create_map(
        F.lit("_check_name"), F.lit(check), F.lit("_stage"), F.lit(stage)
    )
    stamped = F.map_concat(
        F.map_filter(outcome["metadata"], lambda k, _: ~k.isin("_check_name", "_stage")), stamp
    )
    kept = F.when(F.map_contains_key(outcome["metadata"], "_check_name"), outcome["metadata"])
    return F.struct(
        outcome["decision"].alias("decision"),
        outcome["reason"].alias("reason"),
        F.coalesce(kept, stamped).alias("metadata"),
        outcome["replacement"].alias("replacement"),
    )

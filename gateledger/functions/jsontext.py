"""Predicates over raw JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING_LITERAL = r'"(?:[^"\\]|\\.)*+(?:"|\z)'


def without_strings(raw: Column) -> Column:
    """The text with every string literal removed (an open one runs to the end)."""
    return F.regexp_replace(raw, rf"(?s){_STRING_LITERAL}", "")


def json_depth(raw: Column) -> Column:
    """Deepest bracket nesting outside string literals."""
    brackets = F.regexp_replace(without_strings(raw), r"[^\[\]{}]", "")
    steps = F.transform(
        F.split(brackets, ""),
        lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))
    walked = F.aggregate(
        steps,
        start,
        lambda acc, step: F.struct(
            (acc["depth"] + step).alias("depth"),
            F.greatest(acc["deepest"], acc["depth"] + step).alias("deepest"),
        ),
    )
    return walked["deepest"]


def exceeds_depth(raw: Column, limit: int) -> Column:
    """Cheap first: text with few openers cannot nest deeply."""
    openers = F.length(raw) - F.length(F.translate(raw, "{[", ""))
    return (openers > limit) & (json_depth(raw) > limit)


def has_non_finite(raw: Column) -> Column:
    """A bare NaN or Infinity outside string literals."""
    return raw.rlike(r"NaN|Infinity") & without_strings(raw).rlike(r"\b(NaN|Infinity)\b")


def finite_form(raw: Column) -> Column:
    """The text with NaN/Infinity outside strings replaced by 0, to test syntax."""
    swapped = F.regexp_replace(
        raw, rf"(?s)({_STRING_LITERAL})|-?\b(?:NaN|Infinity)\b", "$1\u0001"
    )
    # Group 1 is empty for a literal number, so a lone marker is that number.
    return F.regexp_replace(F.regexp_replace(swapped, '"\u0001', '"'), "\u0001", "0")


def variant_kind(value: Column) -> Column:
    """Outer JSON type of a variant: OBJECT, ARRAY, STRING, BIGINT, …"""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def strict_json(raw: Column) -> Column:
    """Variant of a text that is exactly one JSON value, else null.

    The parser stops after the first value and ignores what follows.  Wrapped
    in an array and in an object, text behind the value cannot close both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    single = F.size(F.variant_get(listed, "$", "array<variant>")) == 1
    member = F.try_parse_json(F.concat(F.lit('{"a":'), raw, F.lit("}")))
    return F.when(single & member.isNotNull(), F.variant_get(listed, "$[0]", "variant"))

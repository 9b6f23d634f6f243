"""Request and reply bodies: pre-flight refusals, text extraction."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger import schema as S
from gateledger.functions import jsontext as J
from gateledger.functions.crypto import request_fingerprint
from gateledger.functions.principals import header_ci, header_value_safe, valid_session_id

SESSION_HEADER = "X-Session-Id"


def refusal_kind(
    body: Column,
    headers: Column,
    max_body_bytes: int = S.MAX_BODY_BYTES,
    session_header: str = SESSION_HEADER,
    forward_headers: Sequence[str] = (),
) -> Column:
    """First pre-flight refusal that applies, else null.  ``body`` is binary."""
    raw = body.cast("string")
    size = F.octet_length(body)
    session = F.coalesce(
        F.try_element_at(headers, F.lit(session_header)),
        F.get(F.filter(F.map_entries(headers),
                       lambda e: F.lower(e["key"]) == session_header.lower()), 0)["value"],
    )
    arms = [
        F.when(size > max_body_bytes, "body_too_large"),
        F.when(F.octet_length(session) > S.MAX_SESSION_ID_BYTES, "session_id_too_long"),
        F.when(session.isNotNull() & ~valid_session_id(session), "session_id_invalid_charset"),
    ]
    for name in forward_headers:
        value = F.coalesce(F.try_element_at(headers, F.lit(name)),
                           F.try_element_at(headers, F.lit(name.lower())))
        arms.append(F.when(value.isNotNull() & ~header_value_safe(value), "header_invalid_charset"))
    readable = F.is_valid_utf8(raw)
    document = J.strict_json(F.when(readable, J.finite_form(raw)))
    arms += [
        F.when(body.isNull() | (size == 0), "empty_body"),
        F.when(readable & J.exceeds_depth(raw, S.MAX_JSON_DEPTH), "json_too_deeply_nested"),
        F.when(~readable, "invalid_encoding"),
        F.when(document.isNull(), "json_decode_error"),
        F.when(J.variant_kind(document) != "OBJECT", "non_object_body"),
        F.when(J.has_non_finite(raw), "non_finite_float"),
    ]
    return F.coalesce(*arms)


def read_requests(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Raw rows (request_id, body binary, headers) → (accepted, refused).

    Both carry the body fingerprint; refused rows carry ``refusal_kind``.
    """
    checked = df.withColumn(
        "refusal_kind", refusal_kind(F.col("body"), F.col("headers"), **options)
    ).withColumn("fingerprint", request_fingerprint(F.col("body")))
    accepted = checked.where("refusal_kind is null").drop("refusal_kind")
    return accepted.withColumn("body", F.col("body").cast("string")), checked.where(
        "refusal_kind is not null"
    )


def reply_problem(status: Column, content_type: Column, body: Column) -> Column:
    """Classify an upstream reply: redirect, content type, decoding, shape."""
    document = J.strict_json(F.when(F.is_valid_utf8(body), body))
    choices = F.try_variant_get(document, "$.choices", "variant")
    first = F.try_variant_get(document, "$.choices[0]", "variant")
    has_first = J.variant_kind(choices).eqNullSafe(F.lit("ARRAY")) & first.isNotNull()
    return F.coalesce(
        F.when(status.between(300, 399), "upstream_redirect"),
        F.when(
            ~F.coalesce(F.lower(content_type), F.lit("")).rlike(r"^\s*application/([a-z0-9.+-]+\+)?json\b"),
            "upstream_content_type_invalid",
        ),
        F.when(document.isNull(), "upstream_decode_error"),
        F.when(J.variant_kind(document) != "OBJECT", "upstream_protocol_violation"),
        F.when(choices.isNotNull() & ~J.variant_kind(choices).isin("ARRAY", "VOID"),
               "upstream_protocol_violation"),
        F.when(has_first & (J.variant_kind(first) != "OBJECT"), "upstream_protocol_violation"),
    )


def redirect_host(location: Column) -> Column:
    """Host and port only; user info is dropped; null for relative targets."""
    host = F.try_parse_url(location, F.lit("HOST"))
    port = F.regexp_extract(location, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*)(:\d+)", 1)
    return F.concat(host, port)


def response_text(body: Column, path: Column | None = None) -> Column:
    """Message content or completion text of the first choice."""
    document = F.try_parse_json(body)

    def text(where: str) -> Column:
        value = F.try_variant_get(document, where, "variant")
        return F.when(J.variant_kind(value) == "STRING", value.cast("string"))

    return F.coalesce(text("$.choices[0].message.content"), text("$.choices[0].text"))


def messages_of(body: Column) -> Column:
    """array<struct<role, content, parts>>; content and parts exclude each other.

    Only strings are contents and only arrays have parts; numbers, objects and
    nulls leave both null.
    """
    raw = F.from_json(F.get_json_object(body, "$.messages"), "array<string>")

    def one(m: Column) -> Column:
        content = F.get_json_object(m, "$.content")
        kind = J.variant_kind(F.try_variant_get(F.try_parse_json(m), "$.content", "variant"))
        listed = kind.eqNullSafe(F.lit("ARRAY"))
        parts = F.transform(
            F.from_json(content, "array<string>"),
            lambda p: F.struct(
                F.get_json_object(p, "$.type").alias("type"),
                F.get_json_object(p, "$.text").alias("text"),
                p.alias("raw"),
            ),
        )
        return F.struct(
            F.get_json_object(m, "$.role").alias("role"),
            F.when(kind == "STRING", content).alias("content"),
            F.when(listed, parts).alias("parts"),
        )

    return F.transform(F.filter(raw, lambda m: F.startswith(F.ltrim(m), F.lit("{"))), one)


def extract_messages(df: DataFrame, body: str = "body", roles: Sequence[str] | None = None) -> DataFrame:
    """(request_id, pos, role, part_type, text): string contents and text parts."""
    m = df.select("request_id", F.posexplode(messages_of(F.col(body))).alias("pos", "_m"))
    if roles is not None:
        m = m.where(F.col("_m.role").isin(list(roles)))
    plain = m.where("_m.content is not null").select(
        "request_id", "pos", F.lit(0).alias("part"), F.col("_m.role").alias("role"),
        F.lit("text").alias("part_type"), F.col("_m.content").alias("text"),
    )
    parts = m.select("request_id", "pos", F.col("_m.role").alias("role"),
                     F.posexplode("_m.parts").alias("part", "_p")).where("_p.type = 'text'")
    return plain.unionByName(
        parts.select("request_id", "pos", "part", "role", F.col("_p.type").alias("part_type"),
                     F.coalesce("_p.text", F.lit("")).alias("text"))
    )


def message_texts(body: Column, roles: Sequence[str] | None = None) -> Column:
    """Array of the texts of the wanted messages."""
    messages = messages_of(body)
    if roles is not None:
        messages = F.filter(messages, lambda m: m["role"].isin(list(roles)))
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.coalesce(
                F.transform(F.filter(m["parts"], lambda p: p["type"] == "text"),
                            lambda p: F.coalesce(p["text"], F.lit(""))),
                F.array_compact(F.array(m["content"])),
            ),
        )
    )


def message_text(body: Column, roles: Sequence[str] | None = None) -> Column:
    """The texts of the wanted messages, joined with newlines, in one row."""
    return F.array_join(message_texts(body, roles), "\n")


def string_leaves(node: object) -> Iterable[str]:
    """String values of a parsed JSON tree in document order, at any depth."""
    waiting = [node]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            yield node
        elif isinstance(node, (dict, list)):
            members = list(node.values()) if isinstance(node, dict) else node
            waiting += reversed(members)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _leaves(bodies: pd.Series) -> pd.Series:
    """Strings below the free-form members of a request body."""

    def walk(body: str) -> list[str]:
        try:
            document = json.loads(body)
        except ValueError:
            return []
        if not isinstance(document, dict):
            return []
        found: list[str] = []
        for name, kinds in (("tools", list), ("tool_choice", (str, dict)),
                            ("response_format", dict), ("metadata", dict)):
            member = document.get(name)
            if isinstance(member, kinds):
                found += string_leaves(member)
        return found

    return bodies.map(walk, na_action="ignore")


def scan_text(body: Column) -> Column:
    """Every text of a request that may carry an instruction, joined by blanks."""
    document = F.try_parse_json(body)
    raw_messages = F.from_json(F.get_json_object(body, "$.messages"), "array<string>")
    calls = lambda m: F.from_json(F.get_json_object(m, "$.tool_calls"), "array<string>")
    extras = F.flatten(
        F.transform(
            raw_messages,
            lambda m: F.concat(
                F.array(F.get_json_object(m, "$.name")),
                F.coalesce(
                    F.flatten(F.transform(calls(m), lambda c: F.array(
                        F.get_json_object(c, "$.function.name"),
                        F.get_json_object(c, "$.function.arguments"),
                    ))),
                    F.array().cast("array<string>"),
                ),
            ),
        )
    )

    def texts(name: str) -> Column:
        value = F.try_variant_get(document, f"$.{name}", "variant")
        kind = J.variant_kind(value)
        listed = F.transform(
            F.filter(F.try_variant_get(document, f"$.{name}", "array<variant>"),
                     lambda v: J.variant_kind(v) == "STRING"),
            lambda v: v.cast("string"),
        )
        return F.when(kind == "STRING", F.array(value.cast("string"))).when(
            kind == "ARRAY", listed
        )

    none = F.array().cast("array<string>")
    free_form = body.rlike(r'"(tools|tool_choice|response_format|metadata)"')
    parts = F.concat(
        F.coalesce(message_texts(body), none),
        F.coalesce(extras, none),
        F.coalesce(texts("prompt"), none),
        F.coalesce(texts("input"), none),
        F.coalesce(_leaves(F.when(free_form, body)), none),
    )
    return F.array_join(F.array_compact(parts), " ")


def request_max_tokens(body: Column) -> Column:
    """Whole-number ``max_tokens``, else null."""
    value = F.try_variant_get(F.try_parse_json(body), "$.max_tokens", "variant")
    return F.when(
        J.variant_kind(value).isin("BIGINT", "DECIMAL"), F.try_variant_get(F.try_parse_json(body), "$.max_tokens", "bigint")
    )


def session_header(headers: Column) -> Column:
    return F.nullif(header_ci(headers, SESSION_HEADER), F.lit(""))

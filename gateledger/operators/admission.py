"""Admission checks over request rows, all of them Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger import schema as S
from gateledger.functions import principals as P
from gateledger.functions import text as X
from gateledger.functions.results import (
    allow, block, first_result, quoted, redact, result, say,
)

OWNER = "struct<owner_type:string,owner_id:string,approval_chain:array<string>>"


def make_owner(kind: str, owner_id: Column) -> Column:
    """Owner struct; its approval chain starts with the owner itself."""
    return F.when(
        owner_id.isNotNull(),
        F.struct(
            F.lit(kind).alias("owner_type"),
            owner_id.alias("owner_id"),
            F.array(F.concat(F.lit(f"{kind}:"), owner_id)).alias("approval_chain"),
        ),
    )


def unresolved_owner() -> Column:
    return F.struct(
        F.lit("unresolved").alias("owner_type"),
        F.lit("").alias("owner_id"),
        F.array().cast("array<string>").alias("approval_chain"),
    )


_OWNER_HEADERS = {
    "human": "X-Commit-Owner",
    "agent": "X-Agent-Id",
    "name": "X-Policy-Name",
    "version": "X-Policy-Version",
}


def owner_from_headers(df: DataFrame, headers: str = "headers", name: str = "found") -> DataFrame:
    """Add the owner: human header, else agent, else policy name[@version], else null.

    The steps are separate projections, so each header is looked up and cleaned
    once instead of once per use.
    """
    keys = list(_OWNER_HEADERS)
    raw = {f"_raw_{k}": P.header_ci(F.col(headers), h) for k, h in _OWNER_HEADERS.items()}
    df = df.withColumns(raw)

    def candidate(k: str) -> Column:
        value = F.col(f"_raw_{k}")
        if k in ("human", "agent"):
            rest = F.substr(value, F.lit(len(k) + 2))
            return F.when(F.startswith(value, F.lit(f"{k}:")), X.strip_space(rest))
        return F.when(value != "", value)

    df = df.withColumns({f"_cut_{k}": candidate(k) for k in keys})
    df = df.withColumns({f"_form_{k}": X.normalize_unicode(F.col(f"_cut_{k}"), "NFKC") for k in keys})
    df = df.withColumns({f"_fold_{k}": X.fold_confusables(F.col(f"_form_{k}")) for k in keys})
    df = df.withColumns({f"_ok_{k}": P.usable_principal(F.col(f"_fold_{k}")) for k in keys})
    joined = F.when(F.col("_raw_version") == "", F.col("_ok_name")).otherwise(
        F.concat("_ok_name", F.lit("@"), "_ok_version")
    )
    df = df.withColumn("_joined", joined)
    policy = F.when(F.length("_joined") <= S.MAX_PRINCIPAL_CHARS, F.col("_joined"))
    owner_type = (
        F.when(F.col("_ok_human").isNotNull(), "human")
        .when(F.col("_ok_agent").isNotNull(), "agent")
        .when(policy.isNotNull(), "policy")
    )
    df = df.withColumn("_type", owner_type).withColumn(
        "_id", F.coalesce("_ok_human", "_ok_agent", policy)
    )
    found = F.when(
        F.col("_type").isNotNull(),
        F.struct(
            F.col("_type").alias("owner_type"),
            F.col("_id").alias("owner_id"),
            F.array(F.concat("_type", F.lit(":"), "_id")).alias("approval_chain"),
        ),
    )
    helpers = [f"_{p}_{k}" for p in ("raw", "cut", "form", "fold", "ok") for k in keys]
    return df.withColumn(name, found).drop(*helpers, "_joined", "_type", "_id")


def owner_resolution(df: DataFrame, headers: str = "headers", require: bool = True) -> DataFrame:
    """Add ``owner`` and ``owner_resolution`` (result)."""
    if "owner" not in df.columns:
        df = df.withColumn("owner", unresolved_owner())
    df = owner_from_headers(df, headers, "_found")
    known = F.col("owner.owner_type") != "unresolved"
    found = F.col("_found")

    def label(owner: Column) -> Column:
        return P.owner_string(owner["owner_type"], owner["owner_id"])

    if require:
        missing = block("no commit owner could be resolved")
        fallback = F.col("owner")
    else:
        missing = allow("permissive fallback to policy:unattributed")
        fallback = make_owner("policy", F.lit("unattributed"))
    outcome = (
        F.when(known, allow(say("owner already resolved: ", label(F.col("owner"))),
                            source="upstream-resolver"))
        .when(found.isNotNull(), allow(say("owner resolved: ", label(found)),
                                       source=found["approval_chain"][0]))
        .otherwise(missing)
    )
    return (
        df.withColumn("owner_resolution", outcome)
        .withColumn("owner", F.when(known, F.col("owner")).otherwise(F.coalesce(found, fallback)))
        .drop("_found")
    )


LOOPBACK = ("127.0.0.0/8", "::1/128")
SHARED_ADDRESS = "100.64.0.0/10"


def loopback_trust(
    df: DataFrame,
    client_ip: str = "client_ip",
    trust_loopback: bool = True,
    trust_shared: bool = True,
    extra_cidrs: Sequence[str] = (),
) -> DataFrame:
    """Give unresolved rows from trusted networks a policy owner; never blocks."""
    cidrs = [*(LOOPBACK if trust_loopback else ()),
             *((SHARED_ADDRESS,) if trust_shared else ()), *extra_cidrs]
    ip = F.col(client_ip)
    df = df.withColumn("_net", P.first_network(ip, cidrs) if cidrs else F.lit(None).cast("string"))
    is_loop = F.startswith(ip, F.lit("127.")) | ip.rlike(r"^(0*:)*:?0*1\z")
    policy_id = (
        F.when(is_loop, F.lit("internal-loopback"))
        .when(F.col("_net") == SHARED_ADDRESS, say("internal-tailnet:", ip))
        .otherwise(say("internal-trusted:", ip))
    )
    applies = (F.col("owner.owner_type") == "unresolved") & F.col("_net").isNotNull()
    outcome = F.when(
        applies,
        allow(say("trusted source ", ip, "; resolved to policy:", policy_id),
              matched_network=F.col("_net")),
    ).otherwise(allow())
    return (
        df.withColumn("loopback_trust", outcome)
        .withColumn("owner", F.when(applies, make_owner("policy", policy_id)).otherwise(F.col("owner")))
        .drop("_net")
    )


def classification_gate(
    headers: Column,
    classification_header: str = "X-Classification",
    clearance_header: str = "X-Caller-Clearance",
    default_classification: int = 0,
    default_clearance: int = 0,
) -> Column:
    """Refuse when the caller's clearance is below the data's level."""
    needs_raw = P.header_ci(headers, classification_header)
    holds_raw = P.header_ci(headers, clearance_header)
    return gate_levels(needs_raw, holds_raw, classification_header, clearance_header,
                       default_classification, default_clearance)


def gate_levels(
    needs_raw: Column,
    holds_raw: Column,
    classification_header: str = "X-Classification",
    clearance_header: str = "X-Caller-Clearance",
    default_classification: int = 0,
    default_clearance: int = 0,
) -> Column:
    needs = P.parse_classification(needs_raw, default_classification)
    holds = P.parse_classification(holds_raw, default_clearance)
    names = {"classification": P.level_name(needs), "clearance": P.level_name(holds)}
    return (
        F.when(needs.isNull(),
               block(say("unrecognized classification header value: ", quoted(needs_raw)),
                     header=classification_header))
        .when(holds.isNull(),
              block(say("unrecognized clearance header value: ", quoted(holds_raw)),
                    header=clearance_header))
        .when(holds < needs,
              block(say("caller clearance ", P.level_name(holds),
                        " insufficient for data classification ", P.level_name(needs)), **names))
        .otherwise(allow(say("clearance ", P.level_name(holds), " cleared for ",
                             P.level_name(needs)), **names))
    )


@dataclass(frozen=True)
class ContentPattern:
    """A Java regex and what to do on a match."""

    pattern: str
    action: str = "block"
    replacement: str = "[REDACTED]"
    label: str = "match"

    def __post_init__(self) -> None:
        if self.action not in ("block", "redact"):
            raise ValueError("action must be 'block' or 'redact'")


def regex_content(text: Column, patterns: Sequence[ContentPattern]) -> Column:
    """The first registered pattern that matches decides."""
    arms = []
    for p in patterns:
        if p.action == "block":
            outcome = block(f"pattern '{p.label}' matched", pattern_label=p.label)
        else:
            outcome = redact(redact_text(text, p), f"pattern '{p.label}' redacted",
                             pattern_label=p.label)
        arms.append(F.when(text.rlike(p.pattern), outcome))
    return first_result(*arms, allow())


def redact_text(text: Column, pattern: ContentPattern) -> Column:
    literal = pattern.replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, pattern.pattern, literal)


def patterns_from_table(rules: DataFrame) -> list[ContentPattern]:
    """Turn a rule table into inlined patterns.

    Rules are configuration that people write, in the order they decide; each
    becomes a literal regex compiled once per task.  Joining texts with rules
    instead would pair every text with every rule.
    """
    rows = rules.orderBy("position").collect()
    return [ContentPattern(r.pattern, r.action, r.replacement, r.label) for r in rows]


def apply_redaction(messages: Column, replacement: Column) -> Column:
    """Put ``replacement`` into the last user message.

    ``messages`` is array<struct<role, content, parts: array<struct<type, text,
    raw>>>>.  With parts, the first text part takes the text, other text parts
    go, and non-text parts stay; without a text part one is put in front.
    """
    positions = F.transform(messages, lambda m, i: F.when(m["role"] == "user", i))
    last_user = F.array_max(positions)
    part_type = "struct<type:string,text:string,raw:string>"

    def new_parts(parts: Column) -> Column:
        new = F.struct(
            F.lit("text").alias("type"), replacement.alias("text"),
            F.lit(None).cast("string").alias("raw"),
        ).cast(part_type)
        text_at = F.array_position(F.transform(parts, lambda p: p["type"]), "text")
        placed = F.filter(
            F.transform(parts, lambda p, i: F.when(i + 1 == text_at, new)
                        .when(p["type"] == "text", F.lit(None)).otherwise(p)),
            lambda p: p.isNotNull(),
        )
        in_front = F.concat(F.array(new), parts)
        return F.when(text_at > 0, placed).otherwise(in_front)

    def rewrite(m: Column, i: Column) -> Column:
        changed = F.struct(
            m["role"].alias("role"),
            F.when(m["parts"].isNull(), replacement).alias("content"),
            F.when(m["parts"].isNotNull(), new_parts(m["parts"])).alias("parts"),
        )
        return F.when(i == last_user, changed).otherwise(m)

    return F.when(replacement.isNull(), messages).otherwise(F.transform(messages, rewrite))

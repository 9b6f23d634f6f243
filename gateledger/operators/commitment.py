"""Tool-call checks: registry gate, sandbox preview, two-judge verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger import schema as S
from gateledger.functions.principals import tier_name
from gateledger.functions.results import allow, block, escalate, quoted, say


def tool_gate(
    calls: DataFrame,
    registry: DataFrame,
    max_tier: int = 2,
    escalate_at: int = 2,
    allow_critical: bool = False,
    allow_unregistered: bool = False,
) -> DataFrame:
    """Join calls to the registry on ``tool_name`` and add ``tool_call_inspector``.

    The registry side is left to the size-based join choice: it broadcasts when
    Spark knows it is small, and shuffles (with skew splitting) otherwise.
    """
    known = registry.select(
        "tool_name", "risk_tier", "irreversible", "dryrun_supported", F.lit(True).alias("_known")
    )
    df = calls.join(known, "tool_name", "left")
    tool, tier = F.col("tool_name").cast("string"), F.col("risk_tier")
    name = tier_name(tier)
    chain = F.col("approval_chain") if "approval_chain" in calls.columns else F.array().cast("array<string>")
    unknown = (
        allow(say("unregistered tool ", quoted(tool), " allowed by config"), tool=tool)
        if allow_unregistered
        else block(say("tool ", quoted(tool), " not in registry"), tool=tool)
    )
    outcome = F.when(F.col("_known").isNull(), unknown)
    if not allow_critical:
        outcome = outcome.when(
            tier == 3,
            block(say("tool ", quoted(tool), " is CRITICAL tier and allow_critical=False"),
                  tool=tool, tier=name),
        )
    outcome = (
        outcome.when(
            tier > max_tier,
            block(say("tool ", quoted(tool), " tier ", name,
                      f" exceeds max {S.RISK_TIERS[max_tier]}"), tool=tool, tier=name),
        )
        .when(
            F.col("irreversible") & (tier >= escalate_at),
            escalate(
                say("tool ", quoted(tool), " is irreversible and tier ", name,
                    f" >= escalate-at {S.RISK_TIERS[escalate_at]}"),
                tool=tool, tier=name, irreversible=F.col("irreversible"),
                dryrun_supported=F.col("dryrun_supported"),
                requires_approval_from=F.to_json(chain), current_approver=F.get(chain, 0),
            ),
        )
        .otherwise(allow(say("tool ", quoted(tool), " cleared (tier=", name, ")"),
                         tool=tool, tier=name))
    )
    return df.withColumn("tool_call_inspector", outcome).drop("_known")


def preview_is_safe(ok: Column, effect: Column) -> Column:
    """No error and none of the alarm words in the observed effect."""
    return ok & ~F.coalesce(F.lower(effect), F.lit("")).rlike("|".join(S.UNSAFE_EFFECT_WORDS))


def sandbox_preview(
    calls: DataFrame,
    previews: DataFrame,
    only_for: Sequence[str] = (),
    require_dryrun: bool = True,
    policy=preview_is_safe,
) -> DataFrame:
    """Judge recorded preview runs (call_id, ok, effect, error) per call.

    ``calls`` carries ``dryrun_supported``; calls whose preview row is missing
    count as a preview error.
    """
    p = previews.select(
        "call_id", F.col("ok").alias("_ok"), F.col("effect").alias("_effect"),
        F.col("error").alias("_error"),
    )
    df = calls.join(p, "call_id", "left")
    tool = F.col("tool_name").cast("string")
    outcome = F.when(F.lit(False), allow())
    if only_for:
        outcome = outcome.when(~tool.isin(list(only_for)), allow("sandbox preview not required"))
    if require_dryrun:
        outcome = outcome.when(
            ~F.coalesce(F.col("dryrun_supported"), F.lit(False)),
            escalate(say("tool ", quoted(tool), " does not support a preview run"), tool=tool),
        )
    failed = F.col("_ok").isNull() | F.col("_error").isNotNull()
    outcome = (
        outcome.when(failed, block(say("sandbox preview failed: ",
                                       F.coalesce("_error", F.lit("no preview"))), tool=tool))
        .when(~policy(F.col("_ok"), F.col("_effect")),
              escalate(say("sandbox preview of ", quoted(tool), " looks unsafe"),
                       tool=tool, observed_effect=F.col("_effect")))
        .otherwise(allow("sandbox preview ok", tool=tool, observed_effect=F.col("_effect")))
    )
    return df.withColumn("sandbox_preview", outcome).drop("_ok", "_effect", "_error")


def verdict_of(reply: Column) -> Column:
    """BLOCK beats ALLOW in the first 200 characters; anything else is BLOCK."""
    head = F.upper(F.left(F.coalesce(reply, F.lit("")), F.lit(200)))
    clear = F.contains(head, F.lit("ALLOW")) & ~F.contains(head, F.lit("BLOCK"))
    return F.when(clear, "ALLOW").otherwise("BLOCK")


def tribunal(a: Column, b: Column, unanimous_block: bool = False) -> Column:
    """Two judges: agreement decides, dissent escalates (or passes)."""
    votes = {"judge_a": a, "judge_b": b}
    dissent = (
        allow(say("tribunal: judges disagree (", a, "/", b,
                  "); allowing per require_unanimous_block"), **votes)
        if unanimous_block
        else escalate(say("tribunal dissent: judge_a=", a, ", judge_b=", b), **votes)
    )
    return (
        F.when((a == "ALLOW") & (b == "ALLOW"), allow("tribunal: both judges allow", **votes))
        .when((a == "BLOCK") & (b == "BLOCK"), block("tribunal: both judges block", **votes))
        .otherwise(dissent)
    )


def tribunal_join(
    requests: DataFrame, judge_a: DataFrame, judge_b: DataFrame, unanimous_block: bool = False
) -> DataFrame:
    """Requests with both judges' replies; a missing reply counts as BLOCK."""
    df = requests.join(judge_a.select("request_id", F.col("reply").alias("_a")), "request_id", "left")
    df = df.join(judge_b.select("request_id", F.col("reply").alias("_b")), "request_id", "left")
    return df.withColumn(
        "tribunal", tribunal(verdict_of(F.col("_a")), verdict_of(F.col("_b")), unanimous_block)
    ).drop("_a", "_b")

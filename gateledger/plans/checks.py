"""Check lists and their staged evaluation over request, chunk and call rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger import schema as S
from gateledger.functions.results import allow, annotate, block, say
from gateledger.session import durable_table

_STAGE_ORDER = {s: i for i, s in enumerate(S.STAGES)}


@dataclass(frozen=True)
class Check:
    """One policy check.

    ``column`` returns the result struct from the row's columns.  ``table``
    instead maps a DataFrame to one with a column named like the check, for
    checks that need joins or Python.  A ``stateful`` table check must not see
    rows that earlier checks refused.  ``timeout_seconds`` is compared
    with the recorded ``<name>_seconds`` column when the rows carry one.
    """

    name: str
    stage: str
    priority: int = 0
    column: Callable[[], Column] | None = None
    table: Callable[[DataFrame], DataFrame] | None = None
    timeout_seconds: float | None = None
    stateful: bool = False

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a check needs a name")
        if self.stage not in S.STAGES:
            raise ValueError(f"unknown stage {self.stage!r}")
        if (self.column is None) == (self.table is None):
            raise ValueError("a check has either a column or a table form")


def in_order(checks: Sequence[Check]) -> list[Check]:
    """Stage, then priority, then registration."""
    return sorted(checks, key=lambda c: (_STAGE_ORDER[c.stage], c.priority))


def _timed(check: Check, outcome: Column, columns: list[str]) -> Column:
    took = f"{check.name}_seconds"
    if check.timeout_seconds is None or took not in columns:
        return outcome
    late = block(
        f"check '{check.name}' timed out after {check.timeout_seconds}s",
        check=check.name, timeout_seconds=check.timeout_seconds,
    )
    return F.when(F.col(took) > check.timeout_seconds, late).otherwise(outcome)


def evaluate(
    df: DataFrame, checks: Sequence[Check], stage: str = "admission", name: str = "verdict"
) -> DataFrame:
    """First non-allow result wins; later checks do not count.

    Neighbouring row-wise checks share one pass.  Before a stateful check the rows are cut durably once, so the
    check reads the survivors and the rows refused so far are kept, without
    evaluating everything before it twice.
    """
    df = df.withColumn(name, F.lit(None).cast(S.CHECK_RESULT))
    refused: list[DataFrame] = []
    pending: list[Column] = []
    helpers: list[str] = []

    def settle(frame: DataFrame) -> DataFrame:
        if pending:
            frame = frame.withColumn(name, F.coalesce(F.col(name), *pending))
        frame = frame.drop(*helpers)
        pending.clear()
        helpers.clear()
        return frame

    for check in (c for c in in_order(checks) if c.stage == stage):
        if check.column is not None:
            # One projection per check: its parts are then computed once.
            df = df.withColumn(f"_{check.name}", check.column())
            helpers.append(f"_{check.name}")
            outcome = _timed(check, F.col(f"_{check.name}"), df.columns)
            pending.append(
                F.when(outcome["decision"] != "allow", annotate(outcome, check.name, stage))
            )
            continue
        if check.stateful:
            df = durable_table(settle(df))
            refused.append(df.where(F.col(name).isNotNull()))
            df = df.where(F.col(name).isNull())
        df = check.table(df)
        outcome = _timed(check, F.col(check.name), df.columns)
        pending.append(
            F.when(outcome["decision"] != "allow", annotate(outcome, check.name, stage))
        )
    df = settle(df)
    for part in refused:
        df = df.unionByName(part, allowMissingColumns=True)
    cleared = allow("admission cleared") if stage == "admission" else (
        allow("tool call approved") if stage == "commitment" else allow()
    )
    return df.withColumn(name, F.coalesce(F.col(name), cleared))


def record(df: DataFrame, checks: Sequence[Check], key: str) -> DataFrame:
    """All record checks run; a check with a null result becomes a block row.

    Returns (key, check_name, result), one row per check.
    """
    rows = []
    for check in (c for c in in_order(checks) if c.stage == "record"):
        frame = check.table(df) if check.table else df
        outcome = F.col(check.name) if check.table else check.column()
        failed = block(
            f"record-stage check '{check.name}' raised", _record_error=True,
            _audit_row_name="pipeline.record.error", _failing_check_name=check.name,
        )
        rows.append(
            frame.select(
                key, F.lit(check.name).alias("check_name"),
                annotate(F.coalesce(outcome, failed), check.name, "record").alias("result"),
            )
        )
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out


def shadow(df: DataFrame, name: str = "verdict") -> DataFrame:
    """Let everything pass but keep what would have happened."""
    would = F.col(name)["decision"] != "allow"
    return df.withColumn("shadow", would).withColumn(
        "effective_decision", F.lit("allow")
    )


def to_decisions(
    df: DataFrame,
    stage: str = "admission",
    name: str = "verdict",
    parity: bool = False,
) -> DataFrame:
    """Results → unsigned decision rows, ready for ``ledger.seal``.

    A missing result counts as allow, an unknown decision as block.  With
    ``parity`` only refusals are recorded, as a proxy would; by default every
    row is.
    """
    outcome = F.col(name)
    decision = F.coalesce(outcome["decision"], F.lit("allow"))
    decision = F.when(decision.isin(*S.DECISIONS), decision).otherwise("block")
    metadata = F.coalesce(outcome["metadata"], F.create_map().cast("map<string,string>"))
    if "shadow" in df.columns:
        metadata = F.when(
            F.col("shadow"), F.map_concat(metadata, F.create_map(F.lit("shadow"), F.lit("true")))
        ).otherwise(metadata)
    owner = F.col("owner")
    fingerprint = F.col("fingerprint") if "fingerprint" in df.columns else F.lit("")
    rows = df.select(
        "request_id",
        F.concat(F.lit("r-"), F.col("request_id").cast("string")).alias("entry_id"),
        (F.unix_micros("ts") * 1000).alias("ts_ns"),
        owner["owner_type"].alias("owner_type"),
        owner["owner_id"].alias("owner_id"),
        owner["approval_chain"].alias("approval_chain"),
        F.lit(f"pipeline.{stage}").alias("check_name"),
        decision.alias("decision"),
        F.coalesce(outcome["reason"], F.lit("")).alias("reason"),
        fingerprint.alias("request_fingerprint"),
        F.to_json(metadata).alias("metadata"),
    )
    return rows.where("decision in ('block', 'escalate')") if parity else rows


def completion_rows(chunks: DataFrame, usage: DataFrame) -> DataFrame:
    """One ``pipeline.complete`` row per response.

    ``usage``: request_id, finish_reason, completion_tokens, dropped_frames.
    """
    totals = chunks.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.max("truncated").alias("truncated")
    )
    return totals.join(usage, "request_id", "left").select(
        "request_id", F.lit("pipeline.complete").alias("check_name"),
        "finish_reason", "completion_tokens", "truncated", "chunk_count",
        F.coalesce("dropped_frames", F.lit(0)).alias("dropped_frames"),
    )


def inspect_stream(
    chunks: DataFrame, checks: Sequence[Check], name: str = "verdict"
) -> tuple[DataFrame, DataFrame]:
    """(evaluated, delivered): chunks after a response's first refusal drop out."""
    from gateledger.operators.inspection import delivered, first_abort

    judged = evaluate(chunks, checks, "inspection", name)
    aborts = first_abort(judged, name).select("request_id", "abort_chunk")
    seen = (
        judged.join(aborts, "request_id", "left")
        .where(F.col("abort_chunk").isNull() | (F.col("chunk_idx") <= F.col("abort_chunk")))
        .drop("abort_chunk")
    )
    return seen, delivered(judged, name)


def gate_tool_calls(calls: DataFrame, checks: Sequence[Check], name: str = "verdict") -> DataFrame:
    return evaluate(calls, checks, "commitment", name)


def describe(verdict: Column) -> Column:
    return say(verdict["decision"], ": ", verdict["reason"])

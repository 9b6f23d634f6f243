"""Stateful checks on streams, with the same step functions as in batch.

State is keyed by owner, request or chain and expires by time-to-live, where a
proxy would keep a bounded map.  Rows of one key inside a micro-batch are put
in order before the step runs, so batch and stream agree on ordered input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from gateledger import schema as S
from gateledger.operators.limits import TOKEN, bucket_step, budget_step


class OrderedStep(StatefulProcessor):
    """Keeps one literal per key and applies ``step`` to its rows in order."""

    def __init__(
        self, step: Callable, order: Sequence[str], columns: Sequence[str],
        names: Sequence[str], ttl_ms: int | None,
    ) -> None:
        self.step, self.order, self.columns, self.names, self.ttl = (
            step, list(order), list(columns), list(names), ttl_ms,
        )

    def init(self, handle) -> None:
        kind = T.StructType([T.StructField("value", T.StringType())])
        if self.ttl:
            self.state = handle.getValueState("fold", kind, self.ttl)
        else:
            self.state = handle.getValueState("fold", kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        import ast

        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        held = self.state.get()
        state = ast.literal_eval(held[0]) if held is not None else None
        results = []
        for row in batch.itertuples(index=False):
            state, out = self.step(state, row)
            results.append(out)
        self.state.update((repr(state),))
        extra = pd.DataFrame(results, columns=self.names, index=batch.index, dtype=object)
        yield pd.concat([batch[self.columns], extra], axis=1)

    def close(self) -> None:
        pass


def ordered_step(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable,
    outputs: Sequence[T.StructField], ttl_ms: int | None = None, mode: str = "Append",
) -> DataFrame:
    """Streaming counterpart of ``operators.ordered.ordered_fold``."""
    columns = df.columns
    schema = T.StructType([*df.schema.fields, *outputs])
    processor = OrderedStep(step, order, columns, [f.name for f in outputs], ttl_ms)
    return df.groupBy(*keys).transformWithStateInPandas(
        processor, schema, mode, "None" if ttl_ms is None else "ProcessingTime"
    )


def live_rate_limit(
    df: DataFrame, capacity: int, refill_per_second: float, ttl_ms: int | None = None
) -> DataFrame:
    """(owner_key, ts, request_id) stream → allowed, tokens_remaining."""
    advance, one = bucket_step(capacity, refill_per_second), TOKEN

    def step(state, row):
        state, passed, tokens = advance(state, int(row.us_))
        return state, (passed, round(tokens / one, 3) if passed else None)

    slim = df.select("owner_key", "request_id", F.unix_micros("ts").alias("us_"))
    outputs = [
        T.StructField("allowed", T.BooleanType()),
        T.StructField("tokens_remaining", T.DoubleType()),
    ]
    return ordered_step(slim, ["owner_key"], ["us_", "request_id"], step, outputs, ttl_ms)


def live_token_budget(
    df: DataFrame, cap: int, window: str = "day", ttl_ms: int | None = None
) -> DataFrame:
    """(owner_key, ts, request_id, kind, amount) stream → ok, used, reserved."""
    advance = budget_step(cap, window)

    def step(state, row):
        return advance(state, int(row.us_), row.kind, row.request_id, int(row.amount))

    slim = df.select(
        "owner_key", F.col("request_id").cast("string").alias("request_id"), "kind",
        F.col("amount").cast("long").alias("amount"), F.unix_micros("ts").alias("us_"),
        F.when(F.col("kind") == "admit", 1).otherwise(0).alias("rank_"),
    )
    outputs = [
        T.StructField("ok", T.BooleanType()),
        T.StructField("budget_used", T.LongType()),
        T.StructField("budget_reserved", T.LongType()),
    ]
    return ordered_step(
        slim, ["owner_key"], ["us_", "rank_", "request_id"], step, outputs, ttl_ms
    )


def live_chain_links(df: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(chain_id, seq, prev_hmac, hmac) stream → link_ok per row."""

    def step(state, row):
        expected = state[0] if state is not None else ""
        return (row.hmac,), (row.prev_hmac == expected,)

    outputs = [T.StructField("link_ok", T.BooleanType())]
    slim = df.select("chain_id", "seq", "prev_hmac", "hmac")
    return ordered_step(slim, ["chain_id"], ["seq"], step, outputs, ttl_ms)


def live_inspection(
    df: DataFrame, markers: dict[str, int] = S.OUTPUT_MARKERS, ttl_ms: int | None = None
) -> DataFrame:
    """Chunk stream → decision per chunk; after an abort nothing is delivered.

    Keyed by response: total length, the last characters, and the abort flag.
    """
    import re

    from gateledger.functions.text import ZERO_WIDTH

    longest = max(len(m) for m in markers)
    pattern = re.compile(
        "|".join(re.escape(m) for m in sorted(markers, key=len, reverse=True)), re.IGNORECASE
    )
    levels = {m.lower(): n for m, n in markers.items()}
    hidden = dict.fromkeys(map(ord, ZERO_WIDTH))

    def step(state, row):
        import unicodedata

        total, tail, aborted = state if state is not None else (0, "", False)
        if aborted:
            return state, ("dropped", None)
        text = row.text or ""
        total += len(text)
        kind = None
        limit = int(row.max_tokens * 4 * 1.1) if row.max_tokens and row.max_tokens > 0 else None
        if limit is not None and total > limit:
            kind = "token_count"
        elif text:
            seen = unicodedata.normalize("NFKC", (tail + text).translate(hidden))
            found = [levels[m.lower()] for m in pattern.findall(seen)]
            if found and max(found) > row.request_level:
                kind = "classification"
        tail = (tail + text)[-(longest - 1):]
        return (total, tail, kind is not None), ("block" if kind else "allow", kind)

    outputs = [T.StructField("decision", T.StringType()), T.StructField("kind", T.StringType())]
    slim = df.select("request_id", "chunk_idx", "text", "max_tokens", "request_level")
    return ordered_step(slim, ["request_id"], ["chunk_idx"], step, outputs, ttl_ms)


def live_consent(df: DataFrame, every: int = 5, ttl_ms: int | None = None) -> DataFrame:
    """Union of chunk and consent rows → decision per chunk.

    Columns: request_id, ts, kind ('chunk' or 'consent'), chunk_idx, granted.
    """

    def step(state, row):
        granted = state[0] if state is not None else True
        if row.kind == "consent":
            return (bool(row.granted),), (None,)
        due = int(row.chunk_idx) % every == 0
        return (granted,), ("block" if due and not granted else "allow",)

    slim = df.select(
        "request_id", F.unix_micros("ts").alias("us_"), "kind",
        F.when(F.col("kind") == "chunk", 1).otherwise(0).alias("rank_"), "chunk_idx", "granted",
    )
    outputs = [T.StructField("decision", T.StringType())]
    return ordered_step(
        slim, ["request_id"], ["us_", "rank_", "chunk_idx"], step, outputs, ttl_ms
    ).where("decision is not null")


def live_frames(df: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Frame stream (request_id, frame_idx, text) → array of complete events.

    The unterminated tail waits in state for the next frame.
    """

    def step(state, row):
        pending = (state[0] if state is not None else "") + (row.text or "")
        held = ""
        if pending.endswith("\r"):
            pending, held = pending[:-1], "\r"
        flat = pending.replace("\r\n", "\n").replace("\r", "\n")
        *done, rest = flat.split("\n\n")
        events = []
        for event in done:
            data = [x[5:].removeprefix(" ") for x in event.split("\n") if x.startswith("data:")]
            if data and data != ["[DONE]"]:
                events.append("\n".join(data))
        return (rest + held,), (events,)

    outputs = [T.StructField("events", T.ArrayType(T.StringType()))]
    slim = df.select("request_id", "frame_idx", "text")
    return ordered_step(slim, ["request_id"], ["frame_idx"], step, outputs, ttl_ms)

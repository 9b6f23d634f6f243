"""Rate limits and token budgets per owner.

Refused requests consume nothing, so the state after a row depends on every
earlier verdict: a fold, not a running sum.  ``ordered_fold`` runs it over
balanced chunks, so one owner with most of the traffic is spread over tasks.
Token amounts are integers (micro-tokens), which makes results independent of
where chunks are cut and equal between batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger import schema as S
from gateledger.functions.results import allow, block, say
from gateledger.operators.ordered import carry_sum, ordered_fold, range_chunks

TOKEN = 1_000_000_000_000  # one token in pico-tokens: µs × micro-tokens/s


def bucket_step(capacity: int, refill_per_second: float):
    """(tokens, last µs) × now µs → (state, allowed, tokens after)."""
    full = capacity * TOKEN
    rate = round(refill_per_second * 1_000_000)
    one = TOKEN

    def step(state, now: int):
        tokens, last = state if state is not None else (full, now)
        # A clock that steps back refills nothing but still moves.
        tokens = min(full, tokens + max(0, now - last) * rate)
        passed = tokens >= one
        if passed:
            tokens -= one
        return (tokens, now), passed, tokens

    return step


def rate_limit(
    df: DataFrame,
    capacity: int,
    refill_per_second: float,
    owner: str = "owner_key",
    ts: str = "ts",
    row_id: str = "request_id",
) -> DataFrame:
    """Token bucket per owner: adds allowed, tokens_remaining, retry_after_seconds.

    Rows whose owner is null (unresolved) pass unmetered.
    """
    if capacity < 1 or refill_per_second < 0:
        raise ValueError("capacity must be >= 1 and refill_per_second >= 0")
    advance = bucket_step(capacity, refill_per_second)
    one, rate = TOKEN, refill_per_second

    outputs = [
        T.StructField("allowed", T.BooleanType()),
        T.StructField("tokens_remaining", T.DoubleType()),
        T.StructField("retry_after_seconds", T.DoubleType()),
    ]
    slim = df.where(F.col(owner).isNotNull()).select(
        owner, row_id, F.unix_micros(ts).alias("us_")
    )

    def step(state, row):
        state, passed, tokens = advance(state, int(row.us_))
        left = round(tokens / one, 3) if passed else None
        wait = None if passed or rate == 0 else round((1.0 - tokens / one) / rate, 3)
        return state, (passed, left, wait)

    # After such a pause the bucket is full, whatever happened before.
    units = round(refill_per_second * 1_000_000)
    pause = -(-capacity * TOKEN // units) if units else None

    def refilled(before, row) -> bool:
        return pause is not None and int(row.us_) - int(before.us_) >= pause

    metered = ordered_fold(slim, [owner], ["us_", row_id], step, outputs, refilled)
    free = df.where(F.col(owner).isNull()).select(
        owner, row_id, F.unix_micros(ts).alias("us_"), F.lit(True).alias("allowed"))
    return metered.unionByName(free, allowMissingColumns=True).withColumn(
        "ts", F.timestamp_micros("us_")
    ).drop("us_")


def rate_limit_result(capacity: int, refill_per_second: float) -> Column:
    """Check result from the columns ``rate_limit`` added."""
    return F.when(
        F.col("allowed"), allow("rate limit ok", tokens_remaining=F.col("tokens_remaining"))
    ).otherwise(
        block("rate limit exceeded", retry_after_seconds=F.col("retry_after_seconds"),
              capacity=capacity, refill_per_second=refill_per_second,
              hard_quota=refill_per_second == 0)
    )


def hard_quota(
    df: DataFrame,
    capacity: int,
    owner: str = "owner_key",
    ts: str = "ts",
    row_id: str = "request_id",
) -> DataFrame:
    """Only each owner's first ``capacity`` requests pass (no refill).

    Rows whose owner is null pass unmetered.

    The filter on the row number lets Spark keep at most ``capacity`` rows per
    owner and map task before the shuffle; the last row that fits then marks
    the cut, and every row compares itself with it.
    """
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(ts, row_id))
    owned = df.where(F.col(owner).isNotNull())
    firsts = owned.select(owner, ts, row_id).withColumn("_n", rank).where(F.col("_n") <= capacity)
    cut = firsts.groupBy(owner).agg(F.max(F.struct(ts, row_id)).alias("_cut"))
    return (
        owned.join(cut, owner)
        .withColumn("allowed", F.struct(ts, row_id) <= F.col("_cut"))
        .drop("_cut")
        .unionByName(df.where(F.col(owner).isNull()).withColumn("allowed", F.lit(True)))
    )


def token_estimate(max_tokens: Column, default: int = 1024) -> Column:
    """Positive request value, else a small floor at zero, else the default."""
    floor = max(1, default // 100)
    return (
        F.when(max_tokens > 0, max_tokens)
        .when(max_tokens == 0, F.lit(floor))
        .otherwise(F.lit(max(floor, default)))
    )


def budget_step(cap: int, window: str):
    """State (window start µs, used, reserved, in-flight pairs)."""
    span = S.WINDOW_SECONDS[window] * 1_000_000

    def step(state, now: int, kind: str, request: str, amount: int):
        if state is None or now - state[0] >= span:
            # A new window forgets what was reserved, yet replies to requests
            # admitted before it still arrive and are told apart from refused.
            state = (now, 0, 0, state[3] if state is not None else ())
        start, used, reserved, flying = state
        if kind == "admit":
            if amount < 0:
                return state, (False, used, reserved)
            if used + reserved + amount > cap:
                return state, (False, used, reserved)
            reserved += amount
            state = (start, used, reserved, (*flying, (request, amount)))
            return state, (True, used, reserved)
        held = [pair for pair in flying if pair[0] == request]
        if held:
            reserved = max(0, reserved - held[0][1])
            used += max(0, amount)
            flying = tuple(pair for pair in flying if pair[0] != request)
        return (start, used, reserved, flying), (bool(held), used, reserved)

    return step


def token_budget(
    admits: DataFrame,
    completions: DataFrame | None,
    cap: int,
    window: str = "day",
) -> DataFrame:
    """Reserve on admission, reconcile on completion, per owner and window.

    ``admits``: owner_key, ts, request_id, amount (estimate).  ``completions``:
    the same with the tokens really used; replies to refused requests are
    ignored.  A window starts at the owner's first request and rolls when its
    length has passed.  Adds ok, budget_used, budget_reserved.
    """
    if cap < 1:
        raise ValueError("cap must be >= 1")
    advance = budget_step(cap, window)
    shape = lambda d, kind, rank: d.select(
        "owner_key", F.unix_micros("ts").alias("us_"), F.lit(rank).alias("rank_"),
        F.col("request_id").cast("string").alias("request_id"),
        F.lit(kind).alias("kind"), F.col("amount").cast("long").alias("amount"),
    )
    rows = shape(admits, "admit", 1)
    if completions is not None:
        rows = rows.unionByName(shape(completions, "complete", 0))

    def step(state, row):
        return advance(state, int(row.us_), row.kind, row.request_id, int(row.amount))

    outputs = [
        T.StructField("ok", T.BooleanType()),
        T.StructField("budget_used", T.LongType()),
        T.StructField("budget_reserved", T.LongType()),
    ]
    folded = ordered_fold(rows, ["owner_key"], ["us_", "rank_", "request_id"], step, outputs)
    return folded.withColumn("ts", F.timestamp_micros("us_")).drop("us_", "rank_")


def token_budget_result(cap: int, window: str = "day") -> Column:
    """Check result for the admit rows of ``token_budget``."""
    total = F.col("budget_used") + F.col("budget_reserved") + F.col("amount")
    meta = {
        "budget_used": F.col("budget_used"), "budget_reserved": F.col("budget_reserved"),
        "budget_cap": cap, "request_estimate": F.col("amount"),
    }
    return (
        F.when(F.col("amount") < 0,
               block(say("max_tokens must be non-negative, got ", F.col("amount"))))
        .when(F.col("ok"), allow(say("budget ok: ", F.col("budget_used"), f"/{cap} used, ",
                                     F.col("budget_reserved"), " reserved"), **meta))
        .otherwise(block(say("token budget exceeded: would use ", total,
                             f" of {cap} per {window}"), window=window, **meta))
    )


def window_usage(
    df: DataFrame, cap: int, window: str = "day", owner: str = "owner_key",
    ts: str = "ts", row_id: str = "request_id", amount: str = "amount",
) -> DataFrame:
    """Observed use per owner in fixed calendar windows, and whether it is over.

    Rows whose owner is null are kept, with null use, and are never over.
    """
    span = S.WINDOW_SECONDS[window]
    start = F.timestamp_seconds(F.floor(F.unix_seconds(ts) / span) * span)
    keyed = df.select(owner, ts, row_id, amount).withColumn("window_start", start)
    owned = keyed.where(F.col(owner).isNotNull())
    chunks = range_chunks(owned, [owner, "window_start", ts, row_id])
    totals = carry_sum(
        chunks, [owner, "window_start"], [ts, row_id], F.col(amount), "used"
    ).drop("_chunk")
    free = keyed.where(F.col(owner).isNull())
    return totals.unionByName(free, allowMissingColumns=True).withColumn(
        "over", F.coalesce(F.col("used") > cap, F.lit(False)))

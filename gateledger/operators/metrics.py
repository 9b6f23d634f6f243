"""Counters, histograms, exact percentiles, session summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateledger import schema as S


def decision_counters(df: DataFrame) -> DataFrame:
    return df.groupBy("check_name", "stage", "decision").agg(F.count(F.lit(1)).alias("total"))


def shadow_counters(df: DataFrame) -> DataFrame:
    """Non-allow results of checks that ran in shadow mode."""
    return decision_counters(df.where("shadow and decision <> 'allow'"))


def requests_by_path(df: DataFrame) -> DataFrame:
    return df.groupBy("path").agg(F.count(F.lit(1)).alias("requests"))


def truncations(responses: DataFrame, cap: int = S.ACCUMULATED_TEXT_CHARS) -> DataFrame:
    """Responses whose accumulated text hit the cap, one count per response."""
    return responses.agg(
        F.lit(cap).alias("cap"), F.count(F.when(F.col("truncated"), 1)).alias("truncated")
    )


def anchor_failures(df: DataFrame) -> DataFrame:
    from gateledger.operators.ledger import anchor_coverage

    return anchor_coverage(df).where("not success").select("backend", F.col("rows").alias("failures"))


def refusals_by_kind(df: DataFrame) -> DataFrame:
    return (
        df.where("refusal_kind is not null")
        .groupBy("refusal_kind")
        .agg(F.count(F.lit(1)).alias("refusals"))
    )


def latency_histogram(
    df: DataFrame, by: Sequence[str], value: str, buckets: Sequence[float] = S.LATENCY_BUCKETS
) -> DataFrame:
    """Cumulative buckets plus sum and count, one pass with map-side sums."""
    columns = [
        F.count(F.when(F.col(value) <= b, 1)).alias("le_" + f"{b:g}".replace(".", "_"))
        for b in buckets
    ]
    return df.groupBy(*by).agg(
        *columns,
        F.count(value).alias("le_inf"),
        F.sum(value).alias("total_seconds"),
        F.count(value).alias("observations"),
    )


def percentiles_small(
    df: DataFrame, by: Sequence[str], value: str, percents: Sequence[int] = (50, 95, 99)
) -> DataFrame:
    """Built-in exact percentiles; holds one group's distinct values in memory."""
    return df.groupBy(*by).agg(
        *[F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in percents],
        F.max(value).alias("max"),
        F.count(value).alias("count"),
    )


ACCURACY = 2_000


def percentiles(
    df: DataFrame, by: Sequence[str], value: str, percents: Sequence[int] = (50, 95, 99)
) -> DataFrame:
    """Exact percentiles (linear between ranks) without holding a group.

    A sketch brackets each wanted rank; one more pass counts what lies below
    the bracket and keeps only the distinct values inside it, pre-counted.  The
    bracket covers about 4/ACCURACY of the rows, and the sketch's error bound
    guarantees that the rank is in it.  Returns by, p<N>…, max, count.
    """
    key = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(1))
    base = base.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("_v"))
    slack = 2.0 / ACCURACY
    points = [
        edge
        for p in percents
        for edge in (max(0.0, p / 100 - slack), min(1.0, p / 100 + slack))
    ]
    sketch = base.groupBy(*key).agg(
        F.percentile_approx("_v", points, ACCURACY).alias("_edges"),
        F.count(F.lit(1)).alias("_n"),
        F.max("_v").alias("_max"),
        F.min("_v").alias("_min"),
    )
    # Below this size one rank step exceeds the slack; the bracket is the group.
    small = F.col("_n") <= 8 * ACCURACY
    brackets = sketch.select(
        *key, "_n", "_max",
        F.explode(F.array(*[
            F.struct(
                F.lit(p).alias("p"),
                (F.lit(p / 100) * (F.col("_n") - 1)).alias("rank"),
                F.when(small | F.lit(p / 100 <= slack), F.col("_min"))
                .otherwise(F.get("_edges", 2 * i)).alias("lo"),
                F.when(small | F.lit(p / 100 >= 1 - slack), F.col("_max"))
                .otherwise(F.get("_edges", 2 * i + 1)).alias("hi"),
            )
            for i, p in enumerate(percents)
        ])).alias("_q"),
    ).select(*key, "_n", "_max", "_q.*")
    wide = brackets.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("p", "rank", "lo", "hi"))).alias("_qs"),
        F.first("_n").alias("_n"), F.first("_max").alias("_max"),
    )
    # Pre-count equal values on the map side, then look at the few brackets.
    counted = base.groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = counted.join(wide.select(*key, "_qs"), key).select(
        *key, "_v", "_c", F.explode("_qs").alias("_q")
    )
    below = F.col("_v") < F.col("_q.lo")
    inside = (F.col("_v") >= F.col("_q.lo")) & (F.col("_v") <= F.col("_q.hi"))
    under = placed.where(below).groupBy(*key, "_q.p").agg(F.sum("_c").alias("_under"))
    span = placed.where(inside).select(*key, F.col("_q.p").alias("p"),
                                       F.col("_q.rank").alias("_rank"), "_v", "_c")
    order = Window.partitionBy(*key, "p").orderBy("_v")
    upto = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (
        span.join(under, [*key, "p"], "left")
        .withColumn("_hi", F.coalesce("_under", F.lit(0)) + upto - 1)
        .withColumn("_lo", F.col("_hi") - F.col("_c") + 1)
    )
    floor = F.floor(F.col("_rank"))
    ceil = F.ceil(F.col("_rank"))
    at = ranked.groupBy(*key, "p", "_rank").agg(
        F.max(F.when((F.col("_lo") <= floor) & (floor <= F.col("_hi")), F.col("_v"))).alias("_a"),
        F.max(F.when((F.col("_lo") <= ceil) & (ceil <= F.col("_hi")), F.col("_v"))).alias("_b"),
    )
    share = F.col("_rank") - floor
    values = at.select(
        *key, "p",
        (F.col("_a") * (1 - share) + F.coalesce("_b", "_a") * share).alias("_x"),
    )
    spread = values.groupBy(*key).agg(
        *[F.max(F.when(F.col("p") == p, F.col("_x"))).alias(f"p{p}") for p in percents]
    )
    out = spread.join(wide.select(*key, "_max", "_n"), key)
    return out.select(
        *by, *[f"p{p}" for p in percents], F.col("_max").alias("max"), F.col("_n").alias("count")
    )


def stage_latency(samples: DataFrame, stages: Sequence[str] = S.STAGES,
                  percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Percentiles per stage; a request that skipped a stage counts as zero."""
    rows = samples.select(
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("stage"),
                     F.coalesce(F.try_element_at("stage_s", F.lit(s)), F.lit(0.0)).alias("seconds"))
            for s in stages
        ])).alias("_r")
    ).select("_r.*")
    return percentiles(rows, ["stage"], "seconds", percents)


def check_latency(samples: DataFrame, percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Percentiles per check over the requests in which it ran."""
    rows = samples.select(F.explode("check_s").alias("check_name", "seconds"))
    return percentiles(rows, ["check_name"], "seconds", percents)


def overhead(pipeline: DataFrame, baseline: DataFrame, value: str,
             percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Pipeline percentiles minus baseline percentiles (two one-row results)."""
    names = [f"p{p}" for p in percents]
    a = percentiles(pipeline, [], value, percents).withColumn("_j", F.lit(1))
    b = percentiles(baseline, [], value, percents).select(
        F.lit(1).alias("_j"), *[F.col(n).alias(f"_{n}") for n in names]
    )
    return a.join(b, "_j").select(*[(F.col(n) - F.col(f"_{n}")).alias(n) for n in names])


def session_summary(df: DataFrame, session: str = "session_id", ts: str = "ts",
                    level: Column | None = None) -> DataFrame:
    """First and last seen, request count and highest classification."""
    high = F.max(level) if level is not None else F.lit(0)
    return df.groupBy(session).agg(
        F.min(ts).alias("created_at"),
        F.max(ts).alias("last_seen_at"),
        F.count(F.lit(1)).alias("request_count"),
        high.alias("high_water_mark"),
    )


# The cumulative counters of a realtime session row.
REALTIME_COUNTERS = (
    "function_calls_count",
    "function_calls_blocked",
    "function_calls_escalated",
    "client_event_count",
    "upstream_event_count",
    "audio_chunks_passed_through",
    "text_chunks_inspected",
    "binary_frames_received",
)


def realtime_totals(rows: DataFrame) -> DataFrame:
    """Per-session totals from end rows, or the last checkpoint row without one.

    ``rows``: session_id, ts, kind ('checkpoint' or 'end'), close_code and the
    counters.  Counters are cumulative, so the best row is the whole answer.
    """
    rank = F.struct((F.col("kind") == "end").cast("int").alias("ended"), F.col("ts").alias("at"))
    picked = [F.max_by(c, rank).alias(c) for c in (*REALTIME_COUNTERS, "close_code", "kind")]
    return rows.groupBy("session_id").agg(
        *picked, F.min("started_at").alias("started_at"), F.max("ts").alias("_until")
    ).withColumn(
        "duration_seconds",
        (F.unix_micros("_until") - F.unix_micros("started_at")) / F.lit(1e6),
    ).withColumn("complete", F.col("kind") == "end").drop("_until", "kind")


def scanner_quality(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Recall and false positives per channel.

    ``labels``: doc_id, expected (True for attacks), channel.
    """
    joined = labels.join(verdicts.select("doc_id", "decision"), "doc_id")
    hit = F.col("decision") != "allow"
    return joined.groupBy("channel").agg(
        F.count(F.when(F.col("expected"), 1)).alias("attacks"),
        F.count(F.when(F.col("expected") & hit, 1)).alias("caught"),
        F.count(F.when(~F.col("expected"), 1)).alias("benign"),
        F.count(F.when(~F.col("expected") & hit, 1)).alias("false_positives"),
    )

"""Windowed streaming aggregates, sources and late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from gateledger.operators.report import FIRING


def stream_lines(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New log files as they arrive; file position comes with each line."""
    return (
        spark.readStream.option("lineSep", "\n")
        .option("maxFilesPerTrigger", max_files)
        .text(folder)
        .select(F.col("value").alias("raw_line"), F.col("_metadata.file_path").alias("file_path"))
    )


def stream_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Valid rows of a growing log, parsed; invalid lines carry ``parse_error``."""
    from gateledger.sources.decisions import _fields, validate_decisions

    checked = validate_decisions(stream_lines(spark, folder))
    return checked.select(
        *_fields(F.col("_document"), F.col("raw_line")), "parse_error"
    )


def decision_rates(df: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts per (check, stage, decision)."""
    return (
        df.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "check_name", "stage", "decision")
        .agg(F.count(F.lit(1)).alias("decisions"))
        .select("window.start", "window.end", "check_name", "stage", "decision", "decisions")
    )


def sliding_report(df: DataFrame, span: str, slide: str, late: str = "1 hour") -> DataFrame:
    """Firings per check over sliding windows; neighbours give the deltas."""
    return (
        df.where(F.col("decision").isin(*FIRING))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", span, slide), "check_name")
        .agg(F.count(F.lit(1)).alias("firings"),
             F.approx_count_distinct("owner_id").alias("distinct_owners"))
        .select("window.start", "window.end", "check_name", "firings", "distinct_owners")
    )


def gap_sessions(df: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a quiet gap."""
    return (
        df.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "session_id")
        .agg(F.count(F.lit(1)).alias("request_count"))
        .select("session_id", "session_window.start", "session_window.end", "request_count")
    )


def split_late(df: DataFrame, horizon: Column) -> tuple[DataFrame, DataFrame]:
    """(on time, late) by a known horizon, for a side output of late rows."""
    return df.where(F.col("ts") >= horizon), df.where(F.col("ts") < horizon)


def paired_usage(requests: DataFrame, replies: DataFrame, within: str = "1 hour") -> DataFrame:
    """Stream-stream join of requests and their replies inside a time bound."""
    r = requests.withWatermark("ts", within).alias("r")
    p = replies.withWatermark("reply_ts", within).alias("p")
    match = F.expr(
        f"r.request_id = p.reply_to and reply_ts >= ts and reply_ts <= ts + interval {within}"
    )
    return r.join(p, match, "inner")


class SessionTracker(StatefulProcessor):
    """Running totals per session, with a checkpoint row on a timer."""

    def __init__(self, every_ms: int | None) -> None:
        self.every = every_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState(
            "totals", T.StructType([
                T.StructField("created", T.LongType()),
                T.StructField("last", T.LongType()),
                T.StructField("count", T.LongType()),
            ])
        )

    def _row(self, key, kind: str):
        import pandas as pd

        created, last, count = self.totals.get()
        return pd.DataFrame(
            {"session_id": [key[0]], "created_us": [created], "last_seen_us": [last],
             "request_count": [count], "kind": [kind]}
        )

    def handleInputRows(self, key, rows, timers):
        import pandas as pd

        batch = pd.concat(list(rows), ignore_index=True)
        held = self.totals.get()
        created, last, count = held if held is not None else (None, None, 0)
        low, high = int(batch.us_.min()), int(batch.us_.max())
        self.totals.update((
            low if created is None else min(created, low),
            high if last is None else max(last, high),
            count + len(batch),
        ))
        if self.every and held is None:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.every)
        yield self._row(key, "update")

    def handleExpiredTimer(self, key, timers, expired):
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.every)
        yield self._row(key, "checkpoint")

    def close(self) -> None:
        pass


SESSION_ROW = "session_id string, created_us long, last_seen_us long, request_count long, kind string"


def track_sessions(df: DataFrame, checkpoint_ms: int | None = 30_000) -> DataFrame:
    """(session_id, ts) stream → totals per session, plus timed checkpoints."""
    slim = df.select(F.col("session_id").cast("string").alias("session_id"),
                     F.unix_micros("ts").alias("us_"))
    return slim.groupBy("session_id").transformWithStateInPandas(
        SessionTracker(checkpoint_ms), SESSION_ROW, "Update",
        "ProcessingTime" if checkpoint_ms else "None",
    )


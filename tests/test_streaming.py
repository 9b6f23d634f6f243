"""Streaming twins give the batch rows for the same input."""

import json
import tempfile

from pyspark.sql import functions as F

from gateledger.operators import limits
from gateledger.streaming import rates, runner, state


def as_stream(spark, df):
    """The rows as a file stream of several files."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/in"
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_tables_of_one_or_many_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.range(50).repartition(3).write.parquet(f"{folder}/many.parquet")
    spark.range(7).toPandas().to_parquet(f"{folder}/one.parquet")
    counts = [runner.run_available(runner.table_stream(spark, folder, n)).count() for n in ("many", "one")]
    assert counts == [50, 7]


def test_budget_twin(spark):
    runner.use_durable_state(spark)
    s = 1_000_000
    rows = [("a", 0, "r1", "admit", 60), ("a", 1 * s, "r2", "admit", 60), ("a", 5 * s, "r1", "complete", 10),
            ("a", 10 * s, "r3", "admit", 60), ("b", 3, "r4", "admit", 101), ("a", 61 * s, "r5", "admit", 90)]
    df = spark.createDataFrame(rows, "owner_key string, us long, request_id string, kind string, amount long")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    live = runner.run_available(state.live_token_budget(as_stream(spark, df), 100, "minute"))
    batch = limits.token_budget(df.where("kind = 'admit'"), df.where("kind = 'complete'"), 100, "minute")
    shape = lambda d: sorted((r.request_id, r.kind, r.ok, r.budget_used, r.budget_reserved) for r in d.collect())
    assert shape(live) == shape(batch)


def test_consent_and_frames(spark):
    runner.use_durable_state(spark)
    rows = [("r", i * 10, "chunk", i, None) for i in range(6)] + [("r", 25, "consent", None, False)]
    df = spark.createDataFrame(rows, "request_id string, us long, kind string, chunk_idx int, granted boolean")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    out = runner.run_available(state.live_consent(as_stream(spark, df), every=2))
    assert {int(r.chunk_idx): r.decision for r in out.collect()} == {
        0: "allow", 1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "allow"}
    frames = [("r", 0, 'data: {"a'), ("r", 1, '":1}\r'), ("r", 2, "\n\r\ndata: x\ndata: y\n\nda"), ("r", 3, "ta: [DONE]\n\n")]
    df = spark.createDataFrame(frames, "request_id string, frame_idx int, text string")
    out = runner.run_available(state.live_frames(as_stream(spark, df)))
    events = [e for r in sorted(out.collect(), key=lambda r: r.frame_idx) for e in r.events]
    assert events == ['{"a":1}', "x\ny"]


def test_sessions_rates_and_late_rows(spark):
    runner.use_durable_state(spark)
    rows = [("s1", 10), ("s1", 40), ("s2", 7), ("s1", 5)]
    df = spark.createDataFrame(rows, "session_id string, sec long").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    latest = {}
    tracked = rates.track_sessions(as_stream(spark, df), None)

    def keep(batch, _):
        latest.update({r.session_id: (r.created_us, r.last_seen_us, r.request_count) for r in batch.collect()})

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    q = (tracked.writeStream.foreachBatch(keep).outputMode("update")
         .option("checkpointLocation", base).trigger(availableNow=True).start())
    q.awaitTermination()
    assert latest == {"s1": (5_000_000, 40_000_000, 3), "s2": (7_000_000, 7_000_000, 1)}
    on_time, late = rates.split_late(df, F.timestamp_seconds(F.lit(8)))
    assert (on_time.count(), late.count()) == (2, 2)
    ev = spark.createDataFrame(
        [(i * 60, "c", "admission", "block", f"o{i % 3}") for i in range(600)],
        "sec long, check_name string, stage string, decision string, owner_id string",
    ).withColumn("ts", F.timestamp_seconds("sec"))
    slid = runner.run_available(rates.sliding_report(as_stream(spark, ev), "2 hours", "1 hour", "1 minute"))
    full = {r.firings for r in slid.collect()}
    assert 120 in full and max(full) == 120
    gaps = runner.run_available(rates.gap_sessions(
        as_stream(spark, ev.withColumn("session_id", F.lit("x")).withColumn(
            "ts", F.timestamp_seconds(F.col("sec") + F.when(F.col("sec") >= 18_000, 90_000).otherwise(0)))),
        "30 minutes", "1 minute"))
    assert [r.request_count for r in gaps.collect()] == [300]


def test_pairing_requests_with_replies(spark):
    req = spark.createDataFrame([(i, i * 10) for i in range(5)], "request_id long, sec long")
    req = req.withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    rep = spark.createDataFrame([(1, 15, 7), (3, 4000, 9), (4, 41, 2)], "reply_to long, sec long, used int")
    rep = rep.withColumn("reply_ts", F.timestamp_seconds("sec")).drop("sec")
    out = runner.run_available(rates.paired_usage(as_stream(spark, req), as_stream(spark, rep), "1 hour"))
    assert sorted((r.request_id, r.used) for r in out.collect()) == [(1, 7), (4, 2)]


def test_log_stream(spark):
    row = {"approval_chain": [], "check_name": "c", "decision": "allow", "entry_id": "e", "hmac": "",
           "metadata": {}, "owner_id": "o", "owner_type": "agent", "prev_hmac": "", "reason": "r",
           "request_fingerprint": "", "ts_ns": 1}
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/a.jsonl", "w") as out:
        out.write(json.dumps(row) + "\nbroken\n")
    got = runner.run_available(rates.stream_decisions(spark, folder)).collect()
    assert sorted((r.entry_id or "", r.parse_error is None) for r in got) == [("", False), ("e", True)]

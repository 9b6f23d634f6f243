"""Rows that checks must not lose: no owner, empty chunks, empty frames."""

from pyspark.sql import functions as F

from gateledger.operators import inspection, limits
from gateledger.operators.admission import ContentPattern
from gateledger.sources import streams


def test_rows_without_owner_pass_unmetered(spark):
    rows = [("a", i, i) for i in range(5)] + [(None, 10 + i, i) for i in range(3)]
    df = spark.createDataFrame(rows, "owner_key string, request_id long, n int").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n"))).withColumn("amount", F.lit(100).cast("long"))
    for found in (
        limits.rate_limit(df, 2, 0.0), limits.hard_quota(df, 2),
        limits.window_usage(df, 250).withColumn("allowed", ~F.col("over")),
    ):
        got = {r.request_id: r.allowed for r in found.collect()}
        assert set(got) == {0, 1, 2, 3, 4, 10, 11, 12}
        assert got[0] and got[1] and not got[4]
        assert got[10] and got[11] and got[12]


def test_a_match_holds_for_all_later_chunks(spark):
    chunks = [(1, 0, "abc sec"), (1, 1, ""), (1, 2, "ret"), (1, 3, None), (1, 4, "calm"), (2, 0, ""), (2, 1, "calm")]
    df = spark.createDataFrame(chunks, "request_id long, chunk_idx int, text string")
    found = inspection.regex_output(df, [ContentPattern("secret", "block", label="s")])
    got = {(r.request_id, r.chunk_idx): r.regex_output.decision for r in found.collect()}
    assert got == {
        (1, 0): "allow", (1, 1): "allow", (1, 2): "block", (1, 3): "block", (1, 4): "block",
        (2, 0): "allow", (2, 1): "allow"}


def test_long_output_is_measured_whole(spark):
    chunks = [(1, i, "x" * 700_000) for i in range(3)]
    df = spark.createDataFrame(chunks, "request_id long, chunk_idx int, text string").withColumns(
        {"max_tokens": F.lit(400_000), "request_level": F.lit(0)})
    got = {r.chunk_idx: r.scope_drift.decision for r in inspection.scope_drift(df).collect()}
    assert got == {0: "allow", 1: "allow", 2: "block"}  # the cap lies above a mebicharacter


def test_empty_frames_do_not_glue_events(spark):
    frames = [(1, 0, 'data: {"a":1}\n'), (1, 1, ""), (1, 2, '\ndata: {"a":2}\r'), (1, 3, ""), (1, 4, "\n\r\n"),
              (1, 5, "data: {bad\n\n"), (1, 6, 'data: {"a":3}')]
    df = spark.createDataFrame(frames, "request_id long, frame_idx long, text string")
    got = sorted((r.event_idx, r.data, r.malformed) for r in streams.assemble_frames(df).collect())
    assert [(d, m) for _, d, m in got] == [('{"a":1}', False), ('{"a":2}', False), ("{bad", True), ('{"a":3}', False)]

"""Checks, durations, levels, redaction, staged evaluation."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from gateledger.functions import principals as P
from gateledger.functions import results
from gateledger.functions.times import parse_duration
from gateledger.operators import admission, commitment, inspection
from gateledger.plans import checks
from gateledger.sources import requests


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_durations():
    assert parse_duration("30m") == timedelta(minutes=30)
    assert parse_duration("1w") == timedelta(days=7)
    assert parse_duration("PT1H30M") == timedelta(minutes=90)
    assert parse_duration("P1W") == timedelta(days=7)
    for bad in ("", "10", "P1Y", "P1M", "PT", "99999999d"):
        with pytest.raises(ValueError):
            parse_duration(bad)


@pytest.mark.parametrize("word, level", [("secret", 2), (" TS//SCI", None), ("ＳＥＣＲＥＴ", 2), ("", 0),
                                         ("topsecret", 3), ("TS-SCI", 4), ("x", None)])
def test_levels(spark, word, level):
    assert one(spark, P.parse_classification(F.lit(word))) == level


def headers(spark, **h):
    rows = [(1, {k.replace("_", "-"): v for k, v in h.items()})]
    return spark.createDataFrame(rows, "request_id int, headers map<string,string>")


@pytest.mark.parametrize("h, owner", [
    ({"x_commit_owner": "human:alice"}, "human:alice"),
    ({"X_Commit_Owner": "HUMAN:alice", "X_Agent_Id": "agent:b"}, "agent:b"),
    ({"X_Commit_Owner": "human:\x01a", "X_Policy_Name": "p", "X_Policy_Version": "v2"}, "policy:p@v2"),
    ({"X_Policy_Name": "p" * 257}, None),
    ({"X_Policy_Name": "p" * 250, "X_Policy_Version": "v" * 10}, None),
    ({"X_Commit_Owner": "human: аlice "}, "human:alice"),
    ({}, None),
])
def test_owner_resolution(spark, h, owner):
    df = headers(spark, **h) if h else headers(spark, other="x")
    r = admission.owner_resolution(df).first()
    if owner is None:
        assert r.owner_resolution.decision == "block" and r.owner.owner_type == "unresolved"
    else:
        assert f"{r.owner.owner_type}:{r.owner.owner_id}" == owner
        assert r.owner.approval_chain == [owner]


def test_loopback(spark):
    df = spark.createDataFrame([("127.0.0.1",), ("::1",), ("100.64.1.1",), ("10.1.1.1",), ("x",)], "client_ip string")
    df = df.withColumn("owner", admission.unresolved_owner())
    got = [r.owner.owner_id for r in admission.loopback_trust(df, extra_cidrs=("10.0.0.0/8",)).collect()]
    assert got == ["internal-loopback", "internal-loopback", "internal-tailnet:100.64.1.1",
                   "internal-trusted:10.1.1.1", ""]


def test_redaction_goes_into_the_last_user_message(spark):
    body = ('{"messages":[{"role":"user","content":"a"},{"role":"user","content":[{"type":"image","u":1},'
            '{"type":"text","text":"b"},{"type":"text","text":"c"}]},{"role":"assistant","content":"d"}]}')
    m = one(spark, admission.apply_redaction(requests.messages_of(F.lit(body)), F.lit("XX")))
    assert m[0].content == "a" and m[2].content == "d"
    assert [(p.type, p.text) for p in m[1].parts] == [("image", None), ("text", "XX")]


def test_first_registered_pattern_wins(spark):
    pats = [admission.ContentPattern(r"\d{3}", "redact", "$1#", "num"), admission.ContentPattern("secret", label="s")]
    r = one(spark, admission.regex_content(F.lit("secret 123"), pats))
    assert (r.decision, r.replacement) == ("redact", "secret $1#")


def test_markers_are_judged_by_the_highest(spark):
    marker, level = inspection.marker_level(F.lit("(U) then (s) fouo"))
    assert one(spark, level) == 2
    _, first = inspection.marker_level(F.lit("(U) then (S)"), first_only=True)
    assert one(spark, first) == 0


def test_marker_across_many_tiny_chunks(spark):
    text = "xx SECRET//NOFORN yy"
    rows = [(1, i, c, 1000, 0) for i, c in enumerate(text)]
    df = spark.createDataFrame(rows, "request_id int, chunk_idx int, text string, max_tokens int, request_level int")
    got = inspection.first_abort(inspection.scope_drift(df, block_rows=16), "scope_drift").first()
    assert got.abort_chunk == text.index("N", 9) + 5


def test_tribunal(spark):
    say = lambda a, b, **k: one(spark, commitment.tribunal(commitment.verdict_of(F.lit(a)), commitment.verdict_of(F.lit(b)), **k)).decision
    assert say("ALLOW", "I allow") == "allow"
    assert say("ALLOW", "BLOCK and ALLOW") == "escalate"
    assert say("hm", None) == "block"
    assert say("ALLOW", "BLOCK", unanimous_block=True) == "allow"


def test_evaluation_order_and_annotation(spark):
    seen = checks.in_order([
        checks.Check("b", "admission", 5, column=results.allow),
        checks.Check("r", "record", column=results.allow),
        checks.Check("a", "admission", column=results.allow),
    ])
    assert [c.name for c in seen] == ["a", "b", "r"]
    with pytest.raises(ValueError):
        checks.Check("", "admission", column=results.allow)
    with pytest.raises(ValueError):
        checks.Check("x", "nowhere", column=results.allow)
    df = spark.createDataFrame([(1, 0.1), (2, 9.0)], "request_id int, slow_seconds double")
    out = checks.evaluate(df, [
        checks.Check("slow", "admission", column=results.allow, timeout_seconds=1.0),
        checks.Check("last", "admission", 9, column=lambda: results.block("no")),
    ])
    got = {r.request_id: r.verdict for r in out.collect()}
    assert got[1].metadata["_check_name"] == "last" and got[2].metadata["_check_name"] == "slow"
    rec = checks.record(df, [checks.Check("ok", "record", column=results.allow),
                             checks.Check("bad", "record", column=lambda: F.lit(None).cast("struct<decision:string,reason:string,metadata:map<string,string>,replacement:string>"))], "request_id")
    assert rec.where("result.decision = 'block'").count() == 2


def test_result_contract():
    with pytest.raises(ValueError):
        results.result("allow", "x", F.lit("text"))
    with pytest.raises(ValueError):
        results.result("maybe", "x")


def test_contents_that_are_no_text(spark):
    body = '{"messages":[{"role":"user","content":5},{"role":"user","content":{"a":"x"}},{"role":"user","content":null},' \
           '{"role":"user","content":"[1]"},{"role":"user","content":[{"type":"text","text":"p"}]}]}'
    m = one(spark, requests.message_texts(F.lit(body)))
    assert list(m) == ["[1]", "p"]

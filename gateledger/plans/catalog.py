"""Named queries over the sample tables, one per operator family."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateledger import schema as S
from gateledger.functions import principals as P
from gateledger.functions import text as X
from gateledger.functions.crypto import (
    KeyRing, SigningKey, anonymize_owner, hmac_sha256, request_fingerprint,
)
from gateledger.functions.rules import rule_hits
from gateledger.functions import results
from gateledger.operators import (
    admission, cascade, commitment, filters, injection, inspection, joins, ledger, limits,
    merkle, metrics, networks, receipts, report, rulejoin,
    segments,
)
from gateledger.operators.ordered import dense_position
from gateledger.plans import checks, gates
from gateledger.session import durable_table, fresh_path, spread
from gateledger.sources import decisions


def cores(spark: SparkSession) -> int:
    """Tasks for CPU-heavy stages over the one-file samples."""
    return spark.sparkContext.defaultParallelism
from gateledger.sources import requests, streams
from gateledger.sources import tables as T
from gateledger.streaming import rates, runner, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = datetime(2024, 1, 31)
KEY = SigningKey("k1", b"gateledger-sample-secret-0123456")
OLD_KEY = SigningKey("k0", b"gateledger-retired-secret-000000")
RING = KeyRing(KEY, [OLD_KEY])
SEGMENT = 256


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --------------------------------------------------------------------------
# Counts and reports
# --------------------------------------------------------------------------


@query
def decision_counts(spark, folder):
    return report.count_decisions(T.decisions(spark, folder))


@query
def decision_distribution(spark, folder):
    return report.decision_distribution(T.decisions(spark, folder)).withColumn(
        "percent", F.round("percent", 6)
    )


@query
def count_by_grouping_sets(spark, folder):
    return report.count_by_all(T.decisions(spark, folder))


@query
def check_rollup(spark, folder):
    return report.check_rollup(T.decisions(spark, folder))


@query
def top_checks(spark, folder):
    return report.top_checks(T.decisions(spark, folder))


@query
def top_blocked_owners(spark, folder):
    return report.top_blocked_owners(T.decisions(spark, folder), salt="pepper")


@query
def window_deltas(spark, folder):
    return report.window_deltas(T.decisions(spark, folder), NOW, "7d").withColumn(
        "pct_delta", F.round("pct_delta", 6)
    )


@query
def new_blocked_owners(spark, folder):
    return report.new_blocked_owners(T.decisions(spark, folder), NOW, "7d")


@query
def report_totals(spark, folder):
    return report.report_totals(T.decisions(spark, folder), NOW, "1w")


@query
def tail_filtered(spark, folder):
    d = filters.filter_decisions(T.decisions(spark, folder), decision="block", owner_type="agent")
    return filters.tail(d, 25).select("seq", "check_name", "owner_id")


@query
def show_entry(spark, folder):
    d = T.decisions(spark, folder).withColumn("entry_id", F.concat(F.lit("E-"), "seq"))
    return filters.lookup_entry(d, "  e-17 ").select("seq", "entry_id", "decision")


@query
def request_trace(spark, folder):
    d = T.decisions(spark, folder).select("fingerprint", "seq", "check_name", "decision")
    return joins.request_trace(d, "fingerprint", "seq", F.floor(F.col("seq") / 65_536))


@query
def escalations_open(spark, folder):
    d = T.decisions(spark, folder).select("owner_id", "seq", "decision", "check_name")
    return joins.escalations_open(d, "owner_id", "seq")


@query
def shadow_join(spark, folder):
    d = T.decisions(spark, folder).select("check_name", "stage", "decision", "seq")
    return joins.shadow_join(d, d.where("seq % 3 = 0 and decision <> 'allow'"))


@query
def name_differences(spark, folder):
    expected = T.load(spark, folder, "part").select(F.col("p_name").alias("name"))
    installed = (
        T.load(spark, folder, "part").where("p_size % 7 <> 0")
        .select(F.concat(F.col("p_name"), F.when(F.col("p_size") % 11 == 0, "+").otherwise("")).alias("name"))
    )
    return joins.name_differences(expected, installed, "name")


# --------------------------------------------------------------------------
# Ledger
# --------------------------------------------------------------------------


def unsigned(spark, folder):
    """Decision rows ready to seal."""
    d = T.decisions(spark, folder)
    return d.select(
        "chain_id", "seq", "ts_ns", "owner_type", "owner_id",
        F.array(F.concat("owner_type", F.lit(":"), "owner_id")).alias("approval_chain"),
        "check_name", "decision", F.concat(F.lit("rule "), F.col("event_type")).alias("reason"),
        F.concat(F.lit("e"), F.col("seq").cast("string")).alias("entry_id"),
        F.col("fingerprint").alias("request_fingerprint"),
        F.concat(F.lit('{"stage":"'), "stage", F.lit('"}')).alias("metadata"),
    )


def sealed(spark, folder):
    return ledger.seal(unsigned(spark, folder), RING, segment_rows=SEGMENT, tasks=cores(spark))


@query
def seal_segments(spark, folder):
    return sealed(spark, folder).select("chain_id", "seq", "prev_hmac", "hmac")


@query
def sealed_heads(spark, folder):
    """The signed chain of segment heads, closed by their number."""
    heads = segments.seal_heads(durable_table(sealed(spark, folder)), RING)
    return heads.select("chain_id", "seq", "entry_id", "prev_hmac", "hmac")


@query
def linked_segment_breaks(spark, folder):
    """Of the sealed segments every fifth is gone and others have lost their last row."""
    whole = durable_table(sealed(spark, folder))
    number = F.regexp_extract("chain_id", "/([0-9]+)$", 1).cast("long")
    size = F.count(F.lit(1)).over(Window.partitionBy("chain_id"))
    left = whole.withColumn("_size", size).where(
        (number % 5 != 2) & ~((number % 7 == 3) & (F.col("seq") == F.col("_size") - 1))).drop("_size")
    return segments.verify_linked(left, segments.seal_heads(whole, RING), RING)


def written_log(spark, folder):
    """Sealed rows as a log of text lines, some of them damaged or blank."""
    rows, n = sealed(spark, folder), F.substring("entry_id", 2, 20).cast("long")
    line = (
        F.when(n % 50 == 7, F.concat(F.lit("{cut"), F.substring("raw_line", 9, 40)))
        .when(n % 50 == 9, F.regexp_replace("raw_line", '"decision":"[a-z]+"', '"decision":"maybe"'))
        .when(n % 50 == 11, F.lit("  ")).otherwise(F.col("raw_line"))
    )
    path = fresh_path(spark)
    decisions.write_decisions(rows.withColumn("raw_line", line), path)
    return path


@query
def log_round_trip(spark, folder):
    """Rows of a written log as they are read back, in order, bad lines skipped."""
    good, _ = decisions.read_decisions(spark, written_log(spark, folder), "skip")
    return good.select("seq", "entry_id", "owner_type", "owner_id", "decision", "check_name",
                       F.col("ts_ns").cast("long").alias("ts_ns"), F.length("hmac").alias("mac_length"))


@query
def malformed_lines(spark, folder):
    _, bad = decisions.read_decisions(spark, written_log(spark, folder), "skip")
    return bad.select("line_number", "parse_error")


@query
def unknown_keys(spark, folder):
    """Rows sealed under a key that the verifier's ring lacks."""
    rows = unsigned(spark, folder)
    old = F.floor(F.col("seq") / SEGMENT) % 3 == 1
    both = ledger.seal(rows.where(~old), RING, segment_rows=SEGMENT).unionByName(
        ledger.seal(rows.where(old), KeyRing(OLD_KEY), segment_rows=SEGMENT))
    return ledger.unknown_key_rows(both, KeyRing(KEY)).select("entry_id", "key_id")


@query
def effective_top_checks(spark, folder):
    """Stage wrappers recorded the decisions; the checks behind them are counted."""
    d = T.decisions(spark, folder)
    inner = F.to_json(F.create_map(F.lit("_check_name"), F.col("check_name")))
    wrapped = d.withColumn("metadata", F.when(F.col("seq") % 3 < 2, inner).otherwise(F.lit("{}"))).withColumn(
        "check_name", F.concat(F.lit("pipeline."), "stage"))
    return report.top_checks(wrapped)


def tampered(spark, folder):
    """Every 97th row edited, every 389th dropped, positions made dense again."""
    rows = sealed(spark, folder).withColumn("_n", F.substring("entry_id", 2, 20).cast("long"))
    edited = F.when(
        F.col("_n") % 97 == 11, F.regexp_replace("raw_line", '"reason":"rule', '"reason":"RULE')
    ).otherwise(F.col("raw_line"))
    kept = rows.withColumn("raw_line", edited).where("_n % 389 <> 5").drop("_n")
    return dense_position(
        kept.withColumnRenamed("seq", "_seq"), ["_seq"], F.floor(F.col("_seq") / 65_536),
        "seq", ["chain_id"],
    ).drop("_seq")


@query
def chain_breaks(spark, folder):
    return ledger.verify_chain(tampered(spark, folder), RING).select(
        "chain_id", "index", "entry_id", "kind"
    )


@query
def verification_report(spark, folder):
    return ledger.verification_report(tampered(spark, folder), RING).select(
        "chain_id", "total_entries", "breaks", "last_good_index", "ok"
    )


@query
def link_cascades(spark, folder):
    """Rows of one chain whose stored link points elsewhere for runs of rows."""
    d = T.decisions(spark, folder).select("chain_id", "seq")
    rows = d.withColumn("hmac", F.sha2(F.col("seq").cast("string"), 256)).withColumn(
        "prev_hmac",
        F.when(F.col("seq") == 0, "")
        .when((F.col("seq") % 50).between(10, 10 + F.floor(F.col("seq") / 50) % 5), F.lit("0"))
        .otherwise(F.sha2((F.col("seq") - 1).cast("string"), 256)),
    )
    return ledger.collapse_cascades(ledger.link_status(rows, block_rows=4096), block_rows=4096)


@query
def hmac_self(spark, folder):
    e = T.load(spark, folder, "events")
    text = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    return e.select("event_id", hmac_sha256(KEY, text).alias("mac"))


@query
def fingerprints(spark, folder):
    e = T.load(spark, folder, "events")
    return e.select(
        "event_id",
        request_fingerprint(F.when(F.col("event_id") % 9 > 0, F.col("props"))).alias("fingerprint"),
        anonymize_owner(F.concat(F.lit("human:u"), F.col("user_id").cast("string")), "s").alias("owner"),
    )


@query
def merkle_root(spark, folder):
    d = T.decisions(spark, folder).select(
        "chain_id", "seq", F.sha2(F.concat_ws("/", F.col("seq").cast("string"), "props"), 256).alias("hmac")
    )
    return merkle.merkle_roots(d, "chain_id", "seq", "hmac")


@query
def key_eras(spark, folder):
    """Every third segment under the retired key, and some rows edited after sealing."""
    old_ring, rows = KeyRing(OLD_KEY, [KEY]), unsigned(spark, folder)
    old = F.floor(F.col("seq") / SEGMENT) % 3 == 1
    both = ledger.seal(rows.where(~old), RING, segment_rows=SEGMENT).unionByName(
        ledger.seal(rows.where(old), old_ring, segment_rows=SEGMENT))
    edited = F.when(
        F.col("seq") % 97 == 11, F.regexp_replace("raw_line", '"reason":"rule', '"reason":"RULE')
    ).otherwise(F.col("raw_line"))
    return ledger.key_eras(both.withColumn("raw_line", edited), RING)


@query
def anchor_coverage(spark, folder):
    """Some anchors failed, and some rows carry none."""
    rows = sealed(spark, folder)
    failed = F.regexp_replace("metadata", '"success": ?true', '"success":false')
    changed = F.when(F.col("seq") % 10 == 3, failed).when(F.col("seq") % 10 == 7, F.lit("{}")).otherwise(F.col("metadata"))
    return ledger.anchor_coverage(rows.withColumn("metadata", changed))


# --------------------------------------------------------------------------
# Limits
# --------------------------------------------------------------------------

BUCKET_CAPACITY, BUCKET_RATE = 3, 0.00002
BUDGET_CAP = 60


def _owned_events(spark, folder):
    return T.load(spark, folder, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner_key"),
        "ts", F.col("event_id").alias("request_id"), "value",
    )


@query
def token_bucket(spark, folder):
    rows = limits.rate_limit(
        _owned_events(spark, folder), BUCKET_CAPACITY, BUCKET_RATE
    )
    return rows.select("owner_key", "request_id", "allowed", "tokens_remaining")


@query
def hard_quota(spark, folder):
    rows = limits.hard_quota(_owned_events(spark, folder), 40)
    return rows.select("owner_key", "request_id", "allowed")


@query
def token_budget(spark, folder):
    e = _owned_events(spark, folder).withColumn("amount", F.round("value").cast("long"))
    done = e.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + 1)).withColumn(
        "amount", F.floor(F.col("amount") / 2)
    )
    rows = limits.token_budget(e, done, BUDGET_CAP, "day")
    return rows.where("kind = 'admit'").select("owner_key", "request_id", "ok", "budget_used", "budget_reserved")


@query
def window_usage(spark, folder):
    e = _owned_events(spark, folder).withColumn("amount", F.round("value").cast("long"))
    return limits.window_usage(e, BUDGET_CAP).select(
        "owner_key", "request_id", "used", "over"
    )


# --------------------------------------------------------------------------
# Admission
# --------------------------------------------------------------------------


def header_rows(spark, folder):
    c = T.load(spark, folder, "customer")
    key = F.col("c_custkey")
    level = lambda n: T.pick(T.LEVEL_WORDS, n % 6)
    headers = F.map_filter(
        F.create_map(
            F.lit("x-commit-owner"),
            F.when(key % 4 == 0, F.concat(F.lit(" human:"), "c_name", F.lit(" "))),
            F.lit("X-Agent-Id"),
            F.when(key % 4 == 1, F.concat(F.lit("agent:a"), key.cast("string"))),
            F.lit("X-Policy-Name"), F.when(key % 4 == 2, F.col("c_mktsegment")),
            F.lit("X-Policy-Version"),
            F.when(key % 8 == 2, F.concat(F.lit("v"), F.col("c_nationkey").cast("string"))),
            F.lit("X-Classification"), level(F.col("c_nationkey")),
            F.lit("X-Caller-Clearance"), level(key),
        ),
        lambda _, v: v.isNotNull(),
    )
    return c.select(
        key.alias("request_id"), headers.alias("headers"),
        F.concat_ws(".", T.pick(("127", "100", "10", "8"), F.floor(key / 4) % 4),
                    (F.col("c_nationkey") * 5 % 256).cast("string"),
                    F.lit("0"), (key % 256).cast("string")).alias("client_ip"),
    )


@query
def owner_resolution(spark, folder):
    df = admission.owner_resolution(header_rows(spark, folder))
    return df.select(
        "request_id", "owner.owner_type", "owner.owner_id", "owner_resolution.decision",
        "owner_resolution.reason",
    )


@query
def loopback_trust(spark, folder):
    df = admission.owner_resolution(header_rows(spark, folder))
    df = admission.loopback_trust(df, extra_cidrs=("10.0.0.0/10",))
    return df.select("request_id", "owner.owner_type", "owner.owner_id", "loopback_trust.reason")


def listed_networks(spark, folder):
    """A network per order: five lengths of IPv4, two of IPv6; the key is its position."""
    n = F.col("o_orderkey")
    length = F.get(F.array(*map(F.lit, (12, 16, 20, 24, 28, 32))), (n % 6).cast("int"))
    number = n % 1_000_003 * 2_654_435_761 % 2**32
    first = number - number % F.call_function("shiftleft", F.lit(1).cast("long"), 32 - length)
    octets = [F.shiftright(first, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)]
    group, low = F.hex(n % 65_536 * 7_919 % 65_536), F.hex(n % 64)
    six = F.when(n % 2 == 0, F.concat(F.lit("2001:db8:"), group, F.lit("::/48"))).otherwise(
        F.concat(F.lit("2001:db8:"), group, F.lit(":"), low, F.lit("::/64")))
    return T.load(spark, folder, "orders").select(
        n.alias("position"), F.concat(F.lit("team-"), (n % 97).cast("string")).alias("team"),
        F.when(n % 5 == 0, six).otherwise(F.concat(F.concat_ws(".", *octets), F.lit("/"), length.cast("string"))).alias("cidr"))


def client_addresses(spark, folder):
    e = F.col("event_id")
    number = e % 1_000_003 * 2_246_822_519 % 2**32
    four = F.concat_ws(".", *[F.shiftright(number, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])
    six = F.concat(F.lit("2001:DB8:"), F.hex(e * 5 % 65_536 * 7_919 % 65_536), F.lit(":"), F.hex(e % 64), F.lit("::"), F.hex(e % 65_536))
    return T.load(spark, folder, "events").select("event_id", (
        F.when(e % 50 == 7, F.concat(F.lit("host-"), e.cast("string"))).when(e % 50 == 9, F.lit(None))
        .when(e % 4 == 0, six).otherwise(four)).alias("client_ip"))


@query
def network_owners(spark, folder):
    found = networks.network_owners(client_addresses(spark, folder), listed_networks(spark, folder), carry=("team",))
    return found.select("event_id", "client_ip", "network", "team")


@query
def rule_table_matches(spark, folder):
    """Documents against a rule for each long word of every other document."""
    docs = T.load(spark, folder, "documents")
    words = docs.where("doc_id % 2 = 0").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).where(
        "length(word) >= 9").distinct()
    any_case = F.when(F.length("word") % 3 == 0, "(?i)").otherwise("")
    rules = words.select(
        F.col("word").alias("rule_id"),
        F.concat(any_case, F.lit("(^|[^A-Za-z])"), "word", F.lit("([^A-Za-z]|$)")).alias("pattern"))
    hits = rulejoin.rule_matches(spread(docs, cores(spark)), rules, "doc_id")
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rules"), F.min("rule_id").alias("first_rule"))


@query
def classification_gate(spark, folder):
    df = header_rows(spark, folder).withColumn("gate", admission.classification_gate(F.col("headers")))
    return df.select("request_id", "gate.decision", "gate.reason")


PII = (
    admission.ContentPattern(r"\b[0-9a-f]{32,}\b", "block", label="token"),
    admission.ContentPattern(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "redact", "[EMAIL]", "email"
    ),
)


@query
def redact_pii(spark, folder):
    d = spread(T.load(spark, folder, "documents"), cores(spark))
    df = d.withColumn("r", admission.regex_content(F.col("text"), PII))
    return df.select(
        "doc_id", "r.decision", "r.reason", F.md5(F.col("r.replacement").cast("binary")).alias("redacted_md5")
    )


# --------------------------------------------------------------------------
# Scans
# --------------------------------------------------------------------------


@query
def injection_rules(spark, folder):
    d = spread(T.planted_documents(spark, folder), cores(spark))
    return d.select("doc_id", F.inline(rule_hits(F.col("text")))).select("doc_id", "rule", "severity")


@query
def rules_hit(spark, folder):
    d = spread(T.planted_documents(spark, folder), cores(spark))
    hits = d.select("doc_id", rule_hits(F.col("text")).alias("hits"))
    return hits.select("doc_id", F.array_join(injection.rules_hit(F.col("hits")), ",").alias("rules"))


@query
def injection_verdicts(spark, folder):
    df = injection.scan_texts(T.planted_documents(spark, folder), parts=cores(spark))
    return df.select("doc_id", "prompt_injection.decision", "prompt_injection.reason")


@query
def decode_cascade(spark, folder):
    """Decisions and rules over every layer of encoding, from whole texts."""
    df = cascade.scan_with_cascade(T.planted_documents(spark, folder), "doc_id")
    return df.select("doc_id", "prompt_injection.decision",
                     F.array_join(injection.rules_hit(F.col("hits")), ",").alias("rules"))


@query
def scan_text_forms(spark, folder):
    """The clean forms of every document text, as digests and lengths."""
    d = T.load(spark, folder, "documents")
    t = F.col("text")
    return d.select(
        "doc_id",
        F.length(X.strip_markdown_split(t)).alias("md_len"),
        F.length(X.strip_zero_width(t)).alias("zw_len"),
        F.md5(X.fold_confusables(t).cast("binary")).alias("folded_md5"),
    )


@query
def scanner_quality(spark, folder):
    d = T.planted_documents(spark, folder)
    verdicts = injection.scan_texts(d).select("doc_id", "prompt_injection.decision")
    channels = ("plain", "base64", "hex", "rot13", "html", "marker", "role")
    k = F.col("doc_id") % 11
    labels = d.select(
        "doc_id", k.isin(0, 1, 2, 3, 4, 6).alias("expected"),
        F.coalesce(T.pick(channels, k), F.lit("none")).alias("channel"),
    )
    return metrics.scanner_quality(verdicts, labels)


# --------------------------------------------------------------------------
# Output and tool checks
# --------------------------------------------------------------------------


def chunk_rows(spark, folder):
    """Conversation turns as chunks; some carry markers, some split ones."""
    c = T.load(spark, folder, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.concat(
        F.when((conv % 5 == 1) & (turn == 1), "FORN ").otherwise(""),
        F.col("text"),
        F.when((conv % 5 == 1) & (turn == 0), " SECRET//NO")
        .when((conv + turn) % 7 == 3, " (U) fouo")
        .otherwise(""),
    )
    return c.select(
        conv.alias("request_id"), turn.cast("int").alias("chunk_idx"), text.alias("text"),
        (100 + conv % 7 * 100).cast("int").alias("max_tokens"),
        (conv % 3).cast("int").alias("request_level"),
        F.timestamp_seconds(F.lit(1_704_067_200) + turn * 60).alias("ts"),
    )


@query
def scope_drift(spark, folder):
    df = inspection.scope_drift(chunk_rows(spark, folder))
    return df.select("request_id", "chunk_idx", "accumulated_chars",
                     "scope_drift.decision", F.col("scope_drift")["metadata"]["drift_kind"].alias("kind"),
                     F.col("scope_drift")["metadata"]["marker_level"].alias("marker_level"))


@query
def regex_output(spark, folder):
    """A pattern over the growing response: empty chunks stay, a match holds on."""
    rows = T.load(spark, folder, "conversations").select(
        F.col("conv_id").alias("request_id"), F.col("turn").cast("int").alias("chunk_idx"),
        F.when(F.col("turn") % 5 == 3, F.lit("")).otherwise(F.col("text")).alias("text"))
    found = inspection.regex_output(rows, [admission.ContentPattern(r"th[a-z]{2}re", "block", label="word")])
    return found.select("request_id", "chunk_idx", "regex_output.decision", "regex_output.reason")


@query
def regex_output_long(spark, folder):
    """Patterns whose matches may run over any number of chunks, and a short one."""
    rows = T.load(spark, folder, "conversations").select(
        F.col("conv_id").alias("request_id"), F.col("turn").cast("int").alias("chunk_idx"), "text")
    found = inspection.regex_output(rows, [
        admission.ContentPattern(r"[a-z]ing,[^!?;:]*[a-z]ing,", "block", label="far"),
        admission.ContentPattern(r"th[a-z]{2}re", "block", label="word"),
        admission.ContentPattern(r"(?i)ung [a-z\u00df-\u00ff]+[^,]*ung[.]", "block", label="tail")])
    return found.select("request_id", "chunk_idx", "regex_output.decision", "regex_output.reason")


@query
def first_abort(spark, folder):
    df = inspection.scope_drift(chunk_rows(spark, folder))
    return inspection.abort_metadata(df, "scope_drift").select(
        "request_id", "chunks_delivered", "abort_chunk", "at_end_of_stream"
    )


def consent_rows(spark, folder):
    c = T.load(spark, folder, "conversations").select("conv_id").distinct()
    conv = F.col("conv_id")
    off = c.where("conv_id % 4 = 1").select(
        conv.alias("request_id"), F.timestamp_seconds(F.lit(1_704_067_200) + 90).alias("ts"),
        F.lit(False).alias("granted"))
    on = c.where("conv_id % 8 = 1").select(
        conv.alias("request_id"), F.timestamp_seconds(F.lit(1_704_067_200) + 200).alias("ts"),
        F.lit(True).alias("granted"))
    return off.unionByName(on)


@query
def continuing_consent(spark, folder):
    df = inspection.continuing_consent(
        chunk_rows(spark, folder), consent_rows(spark, folder), every=2
    )
    return df.select("request_id", "chunk_idx", "continuing_consent.decision", "continuing_consent.reason")


def registry_rows(spark, folder):
    p = T.load(spark, folder, "part").where("p_partkey % 10 <> 9")
    return p.select(
        F.col("p_partkey").alias("tool_name"), (F.col("p_size") % 4).alias("risk_tier"),
        (F.col("p_partkey") % 2 == 1).alias("irreversible"),
        (F.col("p_partkey") % 3 == 0).alias("dryrun_supported"),
    )


def call_rows(spark, folder):
    li = T.load(spark, folder, "lineitem")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("call_id"),
        F.col("l_partkey").alias("tool_name"),
        F.array(F.concat(F.lit("human:s"), F.col("l_suppkey").cast("string"))).alias("approval_chain"),
    )


@query
def tool_gate(spark, folder):
    df = commitment.tool_gate(call_rows(spark, folder), registry_rows(spark, folder))
    return df.select(
        "call_id", "tool_name", "tool_call_inspector.decision", "tool_call_inspector.reason",
        F.col("tool_call_inspector")["metadata"]["current_approver"].alias("approver"),
    )


@query
def sandbox_preview(spark, folder):
    calls = T.load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("tool_name"),
        (F.col("o_custkey") % 5 != 0).alias("dryrun_supported"),
    )
    o = T.load(spark, folder, "orders").where("o_orderkey % 13 <> 0")
    previews = o.select(
        F.col("o_orderkey").alias("call_id"), F.lit(True).alias("ok"),
        F.when(F.col("o_orderstatus") == "F", F.lit("would Delete rows")).otherwise("reads rows").alias("effect"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit("timeout")).alias("error"),
    )
    df = commitment.sandbox_preview(calls, previews)
    return df.select("call_id", "sandbox_preview.decision", "sandbox_preview.reason")


@query
def tribunal(spark, folder):
    o = T.load(spark, folder, "orders").select(F.col("o_orderkey").alias("request_id"), "o_orderpriority", "o_orderstatus")
    a = o.where("request_id % 11 <> 0").select(
        "request_id", F.when(F.col("o_orderstatus") == "F", "I would block this").otherwise("Allow it").alias("reply"))
    b = o.select("request_id", F.when(F.col("o_orderpriority") < "3", "ALLOW")
                 .when(F.col("o_orderpriority") < "4", "unsure").otherwise("allow, not block").alias("reply"))
    df = commitment.tribunal_join(o.select("request_id"), a, b)
    return df.select("request_id", "tribunal.decision", "tribunal.reason")


# --------------------------------------------------------------------------
# Metrics
# --------------------------------------------------------------------------


@query
def decision_counters(spark, folder):
    return metrics.decision_counters(T.decisions(spark, folder))


@query
def latency_histogram(spark, folder):
    d = T.decisions(spark, folder).withColumn("seconds", F.col("latency_ms") / 100)
    return metrics.latency_histogram(d, ["check_name", "stage", "decision"], "seconds").withColumn(
        "total_seconds", F.round("total_seconds", 4)
    )


@query
def latency_percentiles(spark, folder):
    p = metrics.percentiles(T.decisions(spark, folder), ["stage"], "latency_ms")
    return p.select("stage", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "max")], "count")


@query
def latency_overhead(spark, folder):
    d = T.decisions(spark, folder).select("latency_ms", "seq")
    p = metrics.overhead(d.where("seq % 2 = 0"), d.where("seq % 2 = 1"), "latency_ms")
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


@query
def session_summary(spark, folder):
    e = T.load(spark, folder, "events")
    s = metrics.session_summary(e, "user_id", "ts", (F.col("event_id") % 5).cast("int"))
    return s.select(
        "user_id", F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("last_seen_at").alias("last_seen_us"), "request_count", "high_water_mark",
    )


@query
def check_latency(spark, folder):
    s = T.decisions(spark, folder).select(F.create_map("check_name", "latency_ms").alias("check_s"))
    p = metrics.check_latency(s)
    return p.select("check_name", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "max")], "count")


@query
def stage_latency(spark, folder):
    s = T.decisions(spark, folder).select(F.create_map("stage", "latency_ms").alias("stage_s"))
    p = metrics.stage_latency(s)
    return p.select("stage", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "max")], "count")


@query
def latency_gate(spark, folder):
    d = T.decisions(spark, folder).select((F.col("latency_ms") / 1000).alias("seconds"))
    rows = gates.apply_gate(d, "seconds", gates.parse_gate("p50=40ms, p95=0.2s,p99=150000us"))
    return rows.select("percent", F.round("limit_seconds", 9).alias("limit_seconds"),
                       F.round("observed", 6).alias("observed"), "passed")


@query
def realtime_totals(spark, folder):
    e = T.load(spark, folder, "events")
    rows = e.select(
        F.col("user_id").alias("session_id"), "ts",
        F.when(F.col("event_id") % 50 == 0, "end").otherwise("checkpoint").alias("kind"),
        (F.col("event_id") % 17).alias("close_code"),
        F.timestamp_seconds(F.lit(1_704_067_200)).alias("started_at"),
        *[(F.col("event_id") + i).alias(c) for i, c in enumerate(metrics.REALTIME_COUNTERS)],
    )
    t = metrics.realtime_totals(rows)
    return t.select("session_id", "function_calls_count", "binary_frames_received", "close_code",
                    "complete", F.round("duration_seconds", 3).alias("duration_seconds"))


# --------------------------------------------------------------------------
# Requests, replies and events
# --------------------------------------------------------------------------


def request_rows(spark, folder):
    """One request per conversation turn; some bodies and headers are broken."""
    c = T.load(spark, folder, "conversations")
    rid = F.col("conv_id") * 100 + F.col("turn")
    fine = F.to_json(F.struct(
        F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"),
        F.lit(64).alias("max_tokens"),
    ))
    k = rid % 12
    body = (
        F.when(k == 0, "").when(k == 1, "[1]").when(k == 2, F.concat(fine, F.lit("}")))
        .when(k == 3, '{"a":NaN}').when(k == 4, F.concat(F.repeat(F.lit("["), 70), F.repeat(F.lit("]"), 70)))
        .otherwise(fine)
    )
    session = F.when(rid % 5 == 1, "bad id!").otherwise(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")))
    return c.select(
        rid.alias("request_id"), body.cast("binary").alias("body"),
        F.create_map(F.lit("x-session-id"), session).alias("headers"), "role", "text",
    )


@query
def preflight(spark, folder):
    _, refused = requests.read_requests(request_rows(spark, folder))
    return refused.select("request_id", "refusal_kind")


@query
def refusals_by_kind(spark, folder):
    _, refused = requests.read_requests(request_rows(spark, folder))
    return metrics.refusals_by_kind(refused)


@query
def request_messages(spark, folder):
    ok, _ = requests.read_requests(request_rows(spark, folder).drop("role", "text"))
    m = requests.extract_messages(ok, roles=("user", "assistant"))
    return m.select("request_id", "pos", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def mixed_messages(spark, folder):
    """Contents as clients send them: strings, part lists, and values that are no text."""
    d = T.load(spark, folder, "documents")
    line = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.substring(line, F.lit(6), F.length(line) - 6)
    listed = F.concat(
        F.lit('[{"type":"text","text":'), quoted, F.lit('},{"type":"image_url","image_url":{"url":"x"}},"loose",'),
        F.lit('{"type":"text","text":"[tail]"},{"type":"text"}]'))
    content = (
        F.when(F.col("doc_id") % 6 == 1, listed).when(F.col("doc_id") % 6 == 2, F.col("doc_id").cast("string"))
        .when(F.col("doc_id") % 6 == 3, F.concat(F.lit('{"a":'), quoted, F.lit("}"))).when(F.col("doc_id") % 6 == 4, "null")
        .otherwise(quoted))
    body = F.concat(
        F.lit('{"messages":["none",{"role":"user","content":'), content,
        F.lit('},{"role":"tool","content":"seen"},{"role":"assistant","content":["'), F.lit('x"]}]}'))
    rows = d.where("text is not null").select(F.col("doc_id").alias("request_id"), body.alias("body"))
    m = requests.extract_messages(spread(rows, cores(spark)), roles=("user", "assistant"))
    return m.select("request_id", "pos", "part", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def scan_text(spark, folder):
    ok, _ = requests.read_requests(request_rows(spark, folder))
    return ok.select("request_id", F.md5(requests.scan_text(F.col("body")).cast("binary")).alias("scan_md5"))


@query
def reply_problems(spark, folder):
    o = T.load(spark, folder, "orders")
    key = F.col("o_orderkey")
    body = (
        F.when(key % 7 == 1, '{"choices":7}').when(key % 7 == 2, '{"choices":[3]}').when(key % 7 == 3, "oops")
        .when(key % 7 == 4, "[]")
        .otherwise(F.concat(F.lit('{"choices":[{"message":{"content":"'), key.cast("string"), F.lit('"}}]}')))
    )
    problem = requests.reply_problem(
        F.when(key % 11 == 0, 302).otherwise(200),
        F.when(key % 13 == 0, "text/html").otherwise("application/json; charset=utf-8"), body,
    )
    return o.select(key.alias("request_id"), problem.alias("problem"),
                    requests.response_text(body).alias("content"))


@query
def frame_events(spark, folder):
    """Each event is cut over three frames at fixed offsets."""
    e = T.load(spark, folder, "events")
    text = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), F.col("event_id").cast("string"),
                    F.lit('"}}]}\r\n\r\n'))
    parts = F.array(F.left(text, F.lit(9)), F.substring(text, 10, 30), F.substr(text, F.lit(40)))
    frames = e.select(
        (F.col("event_id") % 50).alias("request_id"),
        F.floor(F.col("event_id") / 50).alias("_n"), F.posexplode(parts).alias("_i", "text"),
    ).select("request_id", (F.col("_n") * 3 + F.col("_i")).alias("frame_idx"), "text")
    ev = streams.assemble_frames(frames)
    return ev.select("request_id", "event_idx", "malformed", streams.delta_text(F.col("data")).alias("content"))


@query
def event_strings(spark, folder):
    e = T.load(spark, folder, "events")
    data = F.concat(
        F.lit('{"object":"'), F.when(F.col("event_id") % 9 == 0, "odd").otherwise("chat.completion.chunk"),
        F.lit('","choices":[{"index":0,"delta":{"role":"assistant","content":"'), F.col("event_type"),
        F.lit('","x":{"y":["'), F.col("user_id").cast("string"), F.lit('"]}}}]}'),
    )
    s = streams.collect_event_strings(e.select("event_id", data.alias("data")))
    return s.select("event_id", F.array_join("strings", "|").alias("strings"), "abort")


@query
def sibling_inspection(spark, folder):
    d = T.load(spark, folder, "events")
    s = d.select("event_id", F.when(F.col("event_id") % 7 == 2, F.concat(F.lit("x (ts) "), "event_type"))
                 .otherwise(F.col("event_type")).alias("value"),
                 F.when(F.col("event_id") % 31 == 0, "too deep").alias("abort"))
    r = inspection.inspect_sibling_strings(s)
    return r.select("event_id", "sibling_inspection.decision",
                    F.col("sibling_inspection")["metadata"]["smuggled_via_sibling_field"].alias("smuggled"))


@query
def realtime_tool_calls(spark, folder):
    li = T.load(spark, folder, "lineitem")
    data = F.concat(
        F.lit('{"type":"'), F.when(F.col("l_linenumber") % 2 == 1, streams.TOOL_CALL_EVENT).otherwise("response.text.delta"),
        F.lit('","name":"'), F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.col("l_partkey").cast("string")),
        F.lit('","call_id":"c'), F.col("l_orderkey").cast("string"), F.lit('-'), F.col("l_linenumber").cast("string"),
        F.lit('","arguments":'), F.when(F.col("l_partkey") % 3 == 0, '{"q":1}').otherwise('"[7]"'), F.lit("}"),
    )
    calls = streams.route_realtime_events(li.select(data.alias("data")))["tool_call"]
    return streams.extract_tool_calls(calls).select("call_id", "tool_name", "arguments")


# --------------------------------------------------------------------------
# Pipeline, receipts and archives
# --------------------------------------------------------------------------

QUOTA = 20


def admission_checks():
    def quota(df):
        return limits.hard_quota(df, QUOTA, "c_mktsegment", "request_id", "request_id").withColumn(
            "segment_quota", F.when(F.col("allowed"), results.allow("quota ok")).otherwise(results.block("quota used up"))
        )

    return [
        checks.Check("segment_quota", "admission", 100, table=quota, stateful=True),
        checks.Check("owner_resolution", "admission", table=admission.owner_resolution),
        checks.Check("classification_gate", "admission",
                     column=lambda: admission.classification_gate(F.col("headers"))),
    ]


def evaluated(spark, folder):
    seg = T.load(spark, folder, "customer").select(F.col("c_custkey").alias("request_id"), "c_mktsegment")
    rows = header_rows(spark, folder).join(seg, "request_id")
    return checks.evaluate(rows, admission_checks())


@query
def admission_pipeline(spark, folder):
    v = F.col("verdict")
    return evaluated(spark, folder).select(
        "request_id", v["decision"].alias("decision"), v["reason"].alias("reason"),
        v["metadata"]["_check_name"].alias("fired"),
    )


@query
def pipeline_decisions(spark, folder):
    df = checks.shadow(evaluated(spark, folder)).withColumn("ts", F.timestamp_seconds(F.col("request_id")))
    rows = checks.to_decisions(df)
    return rows.groupBy("check_name", "decision", "owner_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.get_json_object("metadata", "$.shadow") == "true", 1)).alias("shadowed"),
    )


@query
def receipt_verify(spark, folder):
    rows = sealed(spark, folder).select("entry_id", "raw_line")
    r = receipts.issue_receipts(rows, RING)
    n = F.substring("entry_id", 2, 20).cast("long") % 7
    bent = (
        F.when(n == 1, F.regexp_replace("header", "sig=.", "sig=x"))
        .when(n == 2, F.regexp_replace("header", "key=k1", "key=k9"))
        .when(n == 3, F.regexp_replace("header", "alg=[^;]*; ", ""))
        .when(n == 4, F.regexp_replace("header", "alg=[^;]*", "alg=none"))
        .when(n == 5, F.regexp_replace("header", "=v1", "=v2"))
        .otherwise(F.col("header"))
    )
    v = receipts.verify_receipts(r.withColumn("header", bent), rows, RING)
    return v.select("entry_id", "valid", "problem")


@query
def archive_header(spark, folder):
    """Header of the range before a cutoff, over stand-in MACs."""
    from gateledger.operators import archive

    d = T.decisions(spark, folder).where(
        filters.before_cutoff(F.col("ts_ns"), datetime(2024, 1, 11))
    ).withColumn("hmac", F.sha2(F.col("seq").cast("string"), 256))
    stats = archive.archive_stats(d)
    root = merkle.merkle_roots(d, "chain_id", "seq", "hmac").select(F.col("root").alias("merkle_root"))
    return stats.withColumn("_j", F.lit(1)).join(root.withColumn("_j", F.lit(1)), "_j").drop("_j")


# --------------------------------------------------------------------------
# Streams (run over what is there, then read back)
# --------------------------------------------------------------------------


@query
def stream_token_bucket(spark, folder):
    runner.use_durable_state(spark)
    e = runner.table_stream(spark, folder, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner_key"),
        "ts", F.col("event_id").alias("request_id"))
    out = runner.run_available(state.live_rate_limit(e, BUCKET_CAPACITY, BUCKET_RATE))
    return out.select("owner_key", "request_id", "allowed", "tokens_remaining")


@query
def stream_inspection(spark, folder):
    runner.use_durable_state(spark)
    c = runner.table_stream(spark, folder, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.concat(
        F.when((conv % 5 == 1) & (turn == 1), "FORN ").otherwise(""), F.col("text"),
        F.when((conv % 5 == 1) & (turn == 0), " SECRET//NO")
        .when((conv + turn) % 7 == 3, " (U) fouo").otherwise(""),
    )
    chunks = c.select(conv.alias("request_id"), turn.cast("int").alias("chunk_idx"), text.alias("text"),
                      (100 + conv % 7 * 100).cast("int").alias("max_tokens"),
                      (conv % 3).cast("int").alias("request_level"))
    out = runner.run_available(state.live_inspection(chunks))
    return out.select("request_id", "chunk_idx", "decision", "kind")


@query
def stream_decision_rates(spark, folder):
    e = runner.table_stream(spark, folder, "events").select(
        "ts", F.col("event_type").alias("decision"), F.lit("all").alias("stage"),
        T.pick(T.CHECKS, F.col("event_id") % 5).alias("check_name"))
    closed = rates.decision_rates(e, "1 day", "1 hour")
    out = runner.run_available(closed)
    return out.select(F.unix_seconds("start").alias("start_s"), "check_name", "decision", "decisions")


@query
def stream_chain_links(spark, folder):
    runner.use_durable_state(spark)
    e = runner.table_stream(spark, folder, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("chain_id"),
        F.col("event_id").alias("seq"),
        F.lit("").alias("prev_hmac"), F.col("event_type").alias("hmac"))
    out = runner.run_available(state.live_chain_links(e))
    return out.select("chain_id", "seq", "link_ok")

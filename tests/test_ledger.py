"""Seal, tamper, verify; read and write logs; archives and receipts."""

import gzip
import hashlib
import hmac
import json
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gateledger.functions.crypto import KeyRing, SigningKey, canonical_json
from gateledger.operators import archive, ledger, merkle, receipts
from gateledger.sources import archives, decisions

KEY = SigningKey("k1", b"0123456789abcdef0123456789abcdef")
RING = KeyRing(KEY)


def fresh(prefix="spark-"):
    return tempfile.mkdtemp(prefix=prefix, dir="/tmp")


def plain_rows(n):
    return [
        {
            "approval_chain": [f"human:u{i}"], "check_name": "rate_limit", "decision": "allow",
            "entry_id": f"id-{i}", "metadata": {"n": i, "f": 1.0, "é": "x\u0001", "hmac": "deadbeef"},
            "owner_id": f"u{i}", "owner_type": "human", "reason": f'say "{i}"', "request_fingerprint": "",
            "ts_ns": 1_700_000_000_000_000_000 + i * 10**9,
        }
        for i in range(n)
    ]


def seal_lines(rows, key=KEY):
    """Reference sealing in plain Python."""
    prev, lines = "", []
    for row in rows:
        row = {**row, "metadata": {**row["metadata"], "_signing_key_id": key.key_id,
                                   "_anchor": {"backend": "noop", "success": True}}, "prev_hmac": prev}
        prev = hmac.new(key.secret, canonical_json(row).encode(), hashlib.sha256).hexdigest()
        lines.append(canonical_json({**row, "hmac": prev}))
    return lines


def write(lines, bom=False):
    path = fresh() + "/log.jsonl"
    with open(path, "wb") as out:
        out.write(b"\xef\xbb\xbf" if bom else b"")
        for line in lines:
            out.write((line if isinstance(line, bytes) else line.encode()) + b"\n")
    return path


def breaks(spark, lines, ring=RING, **options):
    good, bad = decisions.read_decisions(spark, write(lines, options.pop("bom", False)))
    rows = ledger.verify_chain(good, ring, bad, **options).collect()
    return [(r["index"], r.kind) for r in rows]


def edit(line, **changes):
    row = json.loads(line)
    row.update(changes)
    return canonical_json(row)


def test_spark_seal_equals_plain_seal(spark):
    rows = plain_rows(12)
    df = spark.createDataFrame(
        [("main", i, r["approval_chain"], r["check_name"], r["decision"], r["entry_id"],
          json.dumps(r["metadata"]), r["owner_id"], r["owner_type"], r["reason"], "", r["ts_ns"])
         for i, r in enumerate(rows)],
        "chain_id string, seq long, approval_chain array<string>, check_name string, decision string, "
        "entry_id string, metadata string, owner_id string, owner_type string, reason string, "
        "request_fingerprint string, ts_ns long",
    )
    got = [r.raw_line for r in ledger.seal(df, RING).orderBy("seq").collect()]
    assert got == seal_lines(rows)
    first = ledger.seal(df.where("seq < 5"), RING)
    link = ledger.next_link(first)
    rest = ledger.seal(df.where("seq >= 5"), RING, links=link)
    assert [r.raw_line for r in rest.orderBy("seq").collect()] == seal_lines(rows)[5:]


@pytest.fixture(scope="module")
def lines():
    return seal_lines(plain_rows(8))


CASES = {
    "clean": (lambda x: x, []),
    "edited": (lambda x: [*x[:3], edit(x[3], reason="Say"), *x[4:]], [(3, "self_mismatch")]),
    "swapped": (lambda x: [x[0], x[2], x[1], *x[3:]],
                [(1, "link_mismatch"), (2, "link_mismatch"), (3, "link_mismatch")]),
    "deleted": (lambda x: [*x[:4], *x[5:]], [(4, "link_mismatch")]),
    "forged": (lambda x: [*x[:2], edit(x[2], hmac="0" * 64, entry_id="zz"), *x[2:]],
               [(2, "self_mismatch"), (3, "link_mismatch")]),
    "bad link": (lambda x: [*x[:2], edit(x[2], prev_hmac="1" * 64), *x[3:]], [(2, "link_mismatch")]),
    "cut line": (lambda x: [*x[:7], x[7][:40]], [(7, "malformed_line")]),
    "bad utf-8": (lambda x: [*x[:2], b"\xff\xfe", *x[2:]], [(2, "malformed_line")]),
    "missing field": (lambda x: [*x[:1], '{"ts_ns":1}', *x[1:]], [(1, "malformed_line")]),
    "bad enum": (lambda x: [*x[:1], edit(x[1], decision="maybe"), *x[2:]], [(1, "malformed_line")]),
    "nan": (lambda x: [*x[:1], x[1].replace('"n":1', '"n":NaN'), *x[2:]], [(1, "malformed_line")]),
    "trailing text": (lambda x: [*x[:1], x[1] + "}", *x[2:]], [(1, "malformed_line")]),
    "bool time": (lambda x: [edit(x[0], ts_ns=True), *x[1:]], [(0, "malformed_line")]),
    "huge time": (lambda x: [edit(x[0], ts_ns=10**19 + 1), *x[1:]], [(0, "malformed_line")]),
    "list owner": (lambda x: [edit(x[0], owner_id=["a"]), *x[1:]], [(0, "malformed_line")]),
    "chain of ints": (lambda x: [edit(x[0], approval_chain=[1]), *x[1:]], [(0, "malformed_line")]),
    "short mac": (lambda x: [edit(x[0], hmac="ab"), *x[1:]], [(0, "malformed_line")]),
    "blank lines": (lambda x: [x[0], "", "  ", *x[1:]], []),
    "reformatted": (lambda x: [x[0], json.dumps(json.loads(x[1]), indent=None), *x[2:]], []),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_tamper_matrix(spark, lines, case):
    change, expected = CASES[case]
    assert breaks(spark, change(list(lines))) == expected


def test_bom_and_line_numbers(spark, lines):
    assert breaks(spark, lines, bom=True) == []
    good, bad = decisions.read_decisions(spark, write([lines[0], "", "oops", lines[1]]), "skip")
    assert good.count() == 2
    assert [r.line_number for r in bad.collect()] == [3]


def test_key_problems(spark):
    rows = plain_rows(3)
    sealed = seal_lines(rows)
    other = KeyRing(SigningKey("k9", b"f" * 32))
    assert breaks(spark, sealed, other) == [(i, "unknown_key") for i in range(3)]
    meta = json.loads(sealed[1])["metadata"]
    dropped = {k: v for k, v in meta.items() if k != "_signing_key_id"}
    assert breaks(spark, [sealed[0], edit(sealed[1], metadata=dropped), sealed[2]]) == [(1, "missing_key_id")]
    listed = {**meta, "_signing_key_id": ["k1"]}
    assert breaks(spark, [sealed[0], edit(sealed[1], metadata=listed), sealed[2]]) == [(1, "malformed_line")]


def test_rotation(spark):
    new = SigningKey("k2", b"n" * 32)
    rows = plain_rows(6)
    old = seal_lines(rows[:3])
    prev = json.loads(old[-1])["hmac"]
    later = []
    for row in rows[3:]:
        row = {**row, "metadata": {**row["metadata"], "_signing_key_id": "k2"}, "prev_hmac": prev}
        prev = hmac.new(new.secret, canonical_json(row).encode(), hashlib.sha256).hexdigest()
        later.append(canonical_json({**row, "hmac": prev}))
    ring = KeyRing(KEY)
    ring.rotate(new)
    assert breaks(spark, old + later, ring) == []
    good, _ = decisions.read_decisions(spark, write(old + later))
    eras = {r.key_id: (r.rows, r.first_seq, r.failed) for r in ledger.key_eras(good, ring).collect()}
    assert eras == {"k1": (3, 0, 0), "k2": (3, 3, 0)}
    assert ledger.unknown_key_rows(good, KeyRing(KEY)).count() == 3


def test_cascades_collapse(spark, lines):
    bent = [lines[0], *[edit(x, prev_hmac="2" * 64) for x in lines[1:5]], *lines[5:]]
    assert breaks(spark, bent, compact_breaks=True, block_rows=2) == [
        (1, "link_mismatch"), (2, "cascade_suppressed")]


def test_report_counts_good_rows_under_link_breaks(spark, lines):
    good, _ = decisions.read_decisions(spark, write([*lines[:4], *lines[5:]]))
    r = ledger.verification_report(good, RING).first()
    assert (r.total_entries, r.breaks, r.last_good_index, r.ok) == (7, 1, 6, False)
    wrong = ledger.verification_report(good, KeyRing(SigningKey("k1", b"w" * 32))).first()
    assert (wrong.last_good_index, wrong.last_good_hmac) == (-1, "")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1024, 1025, 3000])
def test_merkle_root(spark, n):
    level = [hashlib.sha256(f"m{i}".encode()).digest() for i in range(n)]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest()
                 for i in range(0, len(level), 2)]
    df = spark.range(n).select(F.lit("g").alias("g"), "id", F.concat(F.lit("m"), "id").alias("mac"))
    assert merkle.merkle_roots(df, "g", "id", "mac").first().root == level[0].hex()


def archive_file(lines, magic=archives.MAGIC, spoil=False):
    leaves = [hashlib.sha256(json.loads(x)["hmac"].encode()).digest() for x in lines]
    root = archives.pairwise_root(leaves)
    tree = b"MERKLE-V1\n" + len(leaves).to_bytes(4, "big") + (64).to_bytes(4, "big")
    tree += b"".join(x.hex().encode() for x in leaves) + (64).to_bytes(4, "big") + root.encode()
    header = {"archive_format_version": 1, "range_start": "a", "range_end": "b",
              "entry_count": len(lines), "merkle_root": root}
    body = gzip.compress(("\n".join(lines) + "\n").encode(), mtime=0)
    if spoil:
        body = body[:30] + b"\0\0\0\0" + body[34:]
    return (magic + b"1\n" + canonical_json(header).encode() + b"\nMERKLE-START\n" + tree
            + b"\nMERKLE-END\nENTRIES-START\n" + body + b"\nENTRIES-END\n")


def test_archive_import(spark, lines):
    folder = fresh()
    for name, data in (("a.bin", archive_file(lines[:5])), ("b.bin", archive_file(lines[:5], spoil=True)),
                       ("c.bin", b"nothing")):
        with open(f"{folder}/{name}", "wb") as out:
            out.write(data)
    headers, entries = archives.read_archives(spark, folder)
    state = {r.archive_path[-5:]: r for r in headers.collect()}
    assert state["a.bin"].error is None and state["a.bin"].entry_count == 5
    assert "corrupt" in state["b.bin"].error and "magic" in state["c.bin"].error
    assert [r.entry_id for r in entries.orderBy("archive_seq").collect()] == [f"id-{i}" for i in range(5)]


def test_compaction_and_verification_across_archives(spark):
    good, _ = decisions.read_decisions(spark, write(seal_lines(plain_rows(40))))
    cut = datetime.fromtimestamp(1_700_000_000 + 15)
    done = archive.compact(good, cut, RING, "/logs/a1", 1_700_000_100_000_000_000)
    assert done.header.first().entry_count == 15
    assert archive.compact(good, datetime(2000, 1, 1), RING, "/logs/a0", 1) is None
    path = fresh()
    archives.write_archive_dataset(done.entries, done.header, path, "a1")
    headers, entries = archives.read_archive_dataset(spark, path)
    live = done.live.cache()
    kinds = lambda h, e, l=live: [(r["index"], r.kind) for r in
                                  archive.verify_with_archives(l, h, e, RING, block_rows=8).collect()]
    assert kinds(headers, entries) == []
    assert archive.untrusted_markers(live, RING).count() == 0
    assert archive.untrusted_markers(live, KeyRing(SigningKey("k1", b"q" * 32))).count() == 1
    assert kinds(headers.where("false"), entries.where("false")) == [(0, "archive_missing"), (1, "link_mismatch")]
    broken = headers.withColumn("error", F.lit("bad gzip"))
    assert kinds(broken, entries.where("false")) == [(0, "archive_format_invalid")]
    spoiled = entries.withColumn("hmac", F.when(F.col("archive_seq") == 3, "0" * 64).otherwise(F.col("hmac")))
    assert kinds(headers, spoiled) == [(3, "self_mismatch"), (4, "link_mismatch"), (15, "merkle_mismatch")]
    with pytest.raises(ValueError, match="marker"):
        archive.compact(live, datetime(2100, 1, 1), RING, "/logs/a2", 1)
    trimmed = archive.trim_before(good, 38)
    assert [r.entry_id for r in trimmed.orderBy("seq").collect()] == ["id-38", "id-39"]
    with pytest.raises(ValueError):
        archive.trim_before(good, -1)
    appended = ledger.next_link(done.live.where("seq = 0")).first().link
    assert appended == good.where("seq = 14").first().hmac


def test_receipts(spark, lines):
    good, _ = decisions.read_decisions(spark, write(lines))
    r = receipts.issue_receipts(good, RING)
    assert receipts.verify_receipts(r, good, RING).where("not valid").count() == 0
    header = r.first().header
    sig = hmac.new(KEY.secret, canonical_json({k: v for k, v in json.loads(lines[0]).items() if k != "hmac"}).encode(),
                   hashlib.sha256).hexdigest()
    assert any(sig in x.header for x in r.collect()) and header.startswith("gateledger=v1; alg=hmac-sha256; entry=")


def test_write_and_read_back(spark, lines):
    good, _ = decisions.read_decisions(spark, write(lines))
    path = fresh() + "/copy"
    decisions.write_decisions(good, path)
    again, bad = decisions.read_decisions(spark, path)
    assert [r.raw_line for r in again.orderBy("seq").collect()] == lines and bad.count() == 0
    decisions.write_decision_table(good, path + "-table")
    assert spark.read.parquet(path + "-table").count() == len(lines)

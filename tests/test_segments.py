"""Linked segments: what the chain of heads shows."""

from gateledger.functions.crypto import KeyRing, SigningKey
from gateledger.operators import ledger, segments
from gateledger.session import durable_table

RING = KeyRing(SigningKey("k1", b"0123456789abcdef0123456789abcdef"))
SCHEMA = (
    "chain_id string, seq long, ts_ns long, owner_type string, owner_id string, approval_chain array<string>, check_name string,"
    "decision string, reason string, entry_id string, request_fingerprint string, metadata string"
)


def kinds(df):
    return sorted((r.chain_id, r["index"], r.kind) for r in df.collect())


def test_linked_segments(spark):
    rows = [(c, i, 1000 + i, "agent", "a", ["agent:a"], "x", "allow", "r", f"{c}{i}", "", "{}") for c in ("a", "b") for i in range(23)]
    sealed = durable_table(ledger.seal(spark.createDataFrame(rows, SCHEMA), RING, segment_rows=5))
    heads = durable_table(segments.seal_heads(sealed, RING))
    assert heads.count() == 2 * 6
    assert kinds(segments.verify_linked(sealed, heads, RING)) == []
    gone = sealed.where("chain_id <> 'a/00000004'")  # the last one, heads kept
    assert kinds(segments.verify_linked(gone, heads, RING)) == [("a/00000004", 4, "segment_missing")]
    # its head gone too: the chain of heads has a gap before its closing row
    cut = heads.where("entry_id <> 'a/4'")
    found = kinds(segments.verify_linked(gone, cut, RING))
    assert ("a/heads", 5, "link_mismatch") in found and ("a/heads", 4, "heads_open") in found
    # all of the end gone: no closing row is left
    cut = heads.where("not (chain_id = 'a/heads' and seq >= 4)")
    assert kinds(segments.verify_linked(gone, cut, RING)) == [("a/heads", 4, "heads_open")]
    # sealed again under the same key, with a row less
    other = ledger.seal(spark.createDataFrame([r for r in rows if r[1] != 7], SCHEMA), RING, segment_rows=5)
    swapped = sealed.where("chain_id <> 'b/00000001'").unionByName(other.where("chain_id = 'b/00000001'"))
    assert ("b/00000001", 1, "segment_changed") in kinds(segments.verify_linked(swapped, heads, RING))
    assert kinds(segments.verify_linked(sealed.limit(0), heads.limit(0), RING)) == []


def test_sealing_walks_batches_in_slices(monkeypatch):
    """A batch's rows become Python values a slice at a time, with one MAC carried over slices and batches."""
    import hashlib
    import hmac

    import pyarrow as pa

    from gateledger.operators import ledger

    monkeypatch.setattr(ledger, "SLICE_ROWS", 4)
    rows = [("a" if i < 13 else "b", "x" if i == 0 else "", f"é{i}<", "|", f">{i}") for i in range(20)]
    names = ["chain_id", "link", "before", "middle", "after"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in part]) for part in (rows[:11], rows[11:])]
    out = list(ledger._chain_macs(b"secret")(iter(batches)))
    assert max(b.num_rows for b in out) == 4
    prev, want = "x", []
    for i, (_, _, before, middle, after) in enumerate(rows):
        prev = "" if i == 13 else prev
        mac = hmac.new(b"secret", f"{before}{middle}{prev}{after}".encode(), hashlib.sha256).hexdigest()
        want.append((prev, mac))
        prev = mac
    assert [(r["prev_hmac"], r["hmac"]) for b in out for r in b.to_pylist()] == want

"""Order-dependent operators against plain Python, with one hot key."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger.operators import limits
from gateledger.operators.joins import asof_join
from gateledger.operators.ordered import (
    carry_sum, dense_position, halo_blocks, ordered_fold, range_chunks, running_sum,
)


def hot_rows(n=3000, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(10**6), i)
            for i in range(n)]


def test_fold_is_exact_when_one_key_spans_many_chunks(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, t long, id long")

    def step(state, row):
        total = (state[0] if state else 0) + row.t % 7
        total = 0 if total > 50 else total
        return (total,), (total,)

    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = ordered_fold(df, ["k"], ["t", "id"], step, [T.StructField("s", T.LongType())])
        got = {r.id: r.s for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, states = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total = states.get(k, 0) + t % 7
        states[k] = 0 if total > 50 else total
        want[i] = states[k]
    assert got == want


def bucket(rows, capacity, rate):
    state, out = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        tokens, last = state.get(k, (float(capacity), t))
        tokens = min(float(capacity), tokens + max(0, t - last) / 1e6 * rate)
        ok = tokens >= 1 - 1e-9
        state[k] = (tokens - 1 if ok else tokens, t)
        out[i] = ok
    return out


def test_token_bucket_matches_plain_fold_for_any_chunking(spark):
    rows = [(k, t * 97, i) for k, t, i in hot_rows(2000, 3)]
    df = spark.createDataFrame(rows, "owner_key string, us long, request_id long").withColumn(
        "ts", F.timestamp_micros("us")
    )
    want = bucket(rows, 5, 3.0)
    for parts in ("2", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.request_id: r.allowed for r in limits.rate_limit(df, 5, 3.0).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    quota = {r.request_id: r.allowed for r in limits.hard_quota(df, 7).collect()}
    seen = {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        assert quota[i] == (seen[k] <= 7)


def test_token_bucket_reports_wait_and_zero_refill(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1_000_000, 2)], "owner_key string, us long, request_id long")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    slow = {r.request_id: r for r in limits.rate_limit(df, 1, 0.5).collect()}
    assert slow[1].allowed and not slow[2].allowed
    assert slow[2].retry_after_seconds == 1.0
    none = {r.request_id: r for r in limits.rate_limit(df, 1, 0).collect()}
    assert not none[2].allowed and none[2].retry_after_seconds is None


def test_token_budget_releases_reservations_and_rolls(spark):
    s = 1_000_000
    admits = [("a", 0, "r1", 60), ("a", 1 * s, "r2", 60), ("a", 10 * s, "r3", 60), ("a", 61 * s, "r4", 90)]
    done = [("a", 5 * s, "r1", 10), ("a", 6 * s, "r2", 99)]
    mk = lambda rows: spark.createDataFrame(rows, "owner_key string, us long, request_id string, amount long").withColumn("ts", F.timestamp_micros("us"))
    out = limits.token_budget(mk(admits), mk(done), 100, "minute")
    got = {(r.request_id, r.kind): (r.ok, r.budget_used, r.budget_reserved) for r in out.collect()}
    assert got[("r1", "admit")] == (True, 0, 60)
    assert got[("r2", "admit")] == (False, 0, 60)
    assert got[("r1", "complete")] == (True, 10, 0)
    assert got[("r2", "complete")] == (False, 10, 0)
    assert got[("r3", "admit")] == (True, 10, 60)
    assert got[("r4", "admit")] == (True, 0, 90)


def test_blocks_positions_and_sums(spark):
    rows = hot_rows(500, 5)
    df = spark.createDataFrame(rows, "k string, t long, id long")
    placed = dense_position(df, ["id"], F.floor(F.col("id") / 40), "pos", ["k"])
    summed = running_sum(placed, ["k"], "pos", F.col("t"), "total", block_rows=16)
    got = {r.id: (r.pos, r.total) for r in summed.collect()}
    pos, total = {}, {}
    for k, t, i in sorted(rows, key=lambda r: r[2]):
        pos[k] = pos.get(k, -1) + 1
        total[k] = total.get(k, 0) + t
        assert got[i] == (pos[k], total[k])
    halo = halo_blocks(placed, "pos", 3, 16)
    assert halo.where("not _context").count() == 500
    chunks = range_chunks(df, ["k", "t", "id"])
    run = {r.id: r.s for r in carry_sum(chunks, ["k"], ["t", "id"], F.col("t"), "s").collect()}
    acc = {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        acc[k] = acc.get(k, 0) + t
        assert run[i] == acc[k]


def test_asof_join_with_hot_key(spark):
    left = hot_rows(800, 7)
    right = [(k, t, i % 2 == 0) for k, t, i in hot_rows(200, 8)]
    dl = spark.createDataFrame(left, "k string, t long, id long")
    dr = spark.createDataFrame(right, "k string, at long, on boolean")
    got = {r.id: r.v for r in asof_join(dl, dr, "k", "t", "at", "on", "id", "v").collect()}
    times = {}
    for k, at, on in right:
        times.setdefault(k, {}).setdefault(at, set()).add(on)
    for k, t, i in left:
        past = [a for a in times.get(k, {}) if a <= t]
        assert (got[i] is None) if not past else (got[i] in times[k][max(past)])


def test_fold_of_one_key_over_many_chunks(spark):
    """One owner in 40 chunks, with and without pauses that refill the bucket."""
    rows = [("hot", k * 150_000 + (k // 100) * 4_000_000 * (k % 7 > 2), k) for k in range(400)]
    rows += [("hot", 200_000_000 + k * 90_000, 1000 + k) for k in range(400)] + [("b", k, 3000 + k) for k in range(5)]
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    df = spark.createDataFrame(rows, "owner_key string, us long, request_id long").withColumn("ts", F.timestamp_micros("us"))
    want = bucket(rows, 5, 3.0)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {r.request_id: r for r in limits.rate_limit(df, 5, 3.0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: r.allowed for k, r in out.items()} == want

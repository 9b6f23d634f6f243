"""Conversation structure repair: the cheapest edits that give well-formed turns.

A conversation of n rows is a lattice: (rows read, last initial), crossed by
keeping, re-roling, deleting or inserting a row.  The cheapest way through it is
searched from both ends (``cheapest``): two heaps meet, all crossings of equal
cost are finished, and of these the least audit string is taken.

No conversation is given to one task for this: rows are sorted by range, so a
long conversation lies over several partitions, and every partition cuts its rows
into blocks of ``block`` rows at most.  A block's result is the cheapest audit
from each state to each state; blocks are joined by adding costs and audits.
Equal rows of one turn are counted before anything is sorted, so a row that
repeats a million times is one item.  What cannot be cut is the SHA-256 of a
repaired conversation: its rows stream through one task in order, of which only
one batch is held; and a conversation's audit, a letter for each row, is one value.

Defined results: a null id, turn, role or text is read as one space, but null
turns stay null where rows are ordered (first) and gaps counted (ignored); rows of
one turn are ordered by role and text; a null id is a conversation of its own;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm.common import settled, table

STOPS = "[.!?]"
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
# States are the last initial given out: none yet, s, u or a.
STATES = 4
NEXT = (2, 2, 3, 2)  # what has to follow when it isn't kept: u, or a after u
ENDS = (0, 3)
SYMBOL = {"s": 1, "u": 2, "a": 3}
ROLE = {2: "user", 3: "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows that are left."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return (
        conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
        .where(F.col("kind") != 0)
        .select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", STOPS, ""))
            .otherwise(F.col("text")).alias("text"),
            F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))
    )


def faulty(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with their number, and its fault.

    fault is b (blank), d (seen in an earlier turn), t (truncated) or empty; of
    equal rows all but the first are duplicates, unless they are blank.
    """
    items = settled(
        rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
        .withColumn("hash", F.unhex(F.md5(F.col("text").cast("binary")))))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = (
        items.groupBy("conv_id", "role", "hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns"))
        .where(F.col("turns") > 1)
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "first")
    )
    seen = F.col("first").isNotNull() & (place > F.col("first"))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    return (
        items.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")), "left")
        .select(
            "conv_id", "turn", "role", "text", "copies",
            F.when(last == "", "b").when(seen, "d").when(~last.isin(".", "!", "?"), "t").otherwise("").alias("fault"))
    )


def _steps(item: tuple[str, str, int], state: int) -> list[tuple[int, str, int]]:
    """(cost, audit, state after) of passing one item from a state."""
    initial, fault, copies = item
    if fault in ("b", "d"):
        return [(DELETE * copies, "D" * copies, state)]
    rest, tail = DELETE * (copies - 1), "D" * (copies - 1)
    extra = TRUNCATED if fault == "t" else 0
    found = [(DELETE + rest, "D" + tail, state), (REROLE + extra + rest, "R" + tail, NEXT[state])]
    to = SYMBOL.get(initial)
    if to == NEXT[state] or (state == 0 and to == 1):
        found.append((KEEP + extra + rest, "K" + tail, to))
    return found


def cheapest(items: list[tuple[str, str, int]], start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest way through ``items`` from a state to one of ``goals``.

    Dijkstra from both ends.  Free edges only lead to the next row, so heaps in
    order of (cost, rows passed) settle a node after all its equal predecessors
    and its audit is the least of its cost.  No audit of a node is the beginning
    of another one there (a cycle is an insertion and costs), so least parts give
    least wholes.  The search goes on while the heaps may still meet at the best cost.
    """
    n = len(items)
    ahead = [[_steps(item, s) for s in range(STATES)] for item in items]
    behind: list[list[list[tuple[int, str, int]]]] = [[[] for _ in range(STATES)] for _ in range(n)]
    for i in range(n):
        for s in range(STATES):
            for cost, letters, to in ahead[i][s]:
                behind[i][to].append((cost, letters, s))
    inserts_to: list[list[int]] = [[s for s in range(STATES) if NEXT[s] == to] for to in range(STATES)]
    left: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    right: dict[tuple[int, int], tuple[int, str]] = {(n, g): (0, "") for g in goals}
    heaps = [[(0, 0, start)], [(0, 0, g) for g in goals]]
    heapq.heapify(heaps[1])
    done: tuple[set, set] = (set(), set())
    best = None

    def offer(labels: dict, heap: list, node: tuple[int, int], rows: int, cost: int, audit: str) -> None:
        known = labels.get(node)
        if known is None or (cost, audit) < known:
            labels[node] = (cost, audit)
            if known is None or cost < known[0]:
                heapq.heappush(heap, (cost, rows, node[1]))

    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        cost, rows, state = heapq.heappop(heaps[side])
        i = rows if side == 0 else n - rows
        node = (i, state)
        labels = (left, right)[side]
        if node in done[side] or labels[node][0] < cost:
            continue
        done[side].add(node)
        audit = labels[node][1]
        other = (right, left)[side].get(node)
        if other is not None and (best is None or cost + other[0] < best):
            best = cost + other[0]
        if side == 0:
            offer(left, heaps[0], (i, NEXT[state]), rows, cost + INSERT, audit + "I")
            for more, letters, to in ahead[i][state] if i < n else ():
                offer(left, heaps[0], (i + 1, to), rows + 1, cost + more, audit + letters)
        else:
            for before in inserts_to[state]:
                offer(right, heaps[1], (i, before), rows, cost + INSERT, "I" + audit)
            for more, letters, before in behind[i - 1][state] if i else ():
                offer(right, heaps[1], (i - 1, before), rows + 1, cost + more, letters + audit)
    found = [(a[0] + right[node][0], a[1] + right[node][1]) for node, a in left.items() if node in right]
    return min(found) if found else None


@lru_cache(maxsize=1 << 14)
def _short(items: tuple, start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    return cheapest(list(items), start, goals)


def ways(items: list[tuple[str, str, int]], starts: bool, ends: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) through one block; after is -1 where the conversation ends."""
    found = []
    for start in (0,) if starts else range(STATES):
        for after, goals in ((-1, ENDS),) if ends else tuple((g, (g,)) for g in range(STATES)):
            way = _short(tuple(items), start, goals) if len(items) <= 32 else cheapest(items, start, goals)
            if way is not None:
                found.append((start, after, *way))
    return found


_CUT = (
    "conv_id long, part int, block long, at long, turn long, role string, text string, copies long, fault string, ways string"
)
_CUT_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()),
    ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("fault", pa.string()), ("ways", pa.string()),
])


def blocks(items: DataFrame, block: int = 512, parts: int | None = None) -> DataFrame:
    """The rows of ``faulty`` in order and in blocks, and behind each block a row (at -1) with its ways.

    Partition, block and position are the order over all.  A block that is known to
    hold all of its conversation has one way; others, which may go on in another
    block or partition, give the ways from each state to each state.
    """
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    ordered = (items.repartitionByRange(parts, *keys) if parts else items.repartitionByRange(*keys))
    ordered = ordered.sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "copies", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, held, out = 0, [], []
        opened, first = False, True  # whether the conversation's start is known to be here; its first block here

        def close(ended: bool, last: bool) -> None:
            nonlocal number, held
            lattice = [(r[2][:1], r[5], r[4]) for r in held]
            initials = [x[0] for x in lattice]
            wrong = sum(_illegal(a, b) for a, b in zip(initials, initials[1:], strict=False))
            wrong += sum((r[4] - 1) * _illegal(x, x) for r, x in zip(held, initials, strict=True))
            told = json.dumps({
                "whole": ways(lattice, True, True) if first and last else None,
                "ways": None if opened and first and ended else ways(lattice, False, False),
                "first": initials[0], "last": initials[-1], "illegal": wrong})
            out.extend((r[0], part, number, at, *r[1:], None) for at, r in enumerate(held))
            out.append((held[0][0], part, number, -1, None, None, None, None, None, told))
            number, held = number + 1, []

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    close(True, True)
                    opened, first = True, True
                elif len(held) >= block:
                    close(False, False)
                    first = False
                held.append(row)
                size += len(row[3])
                if len(out) >= 2000 or size > 1 << 23:
                    yield _batch(out, _CUT_ARROW)
                    out, size = [], 0
        if held:
            close(False, True)
        yield _batch(out, _CUT_ARROW)

    return ordered.mapInArrow(run, _CUT)


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_FOUND = "conv_id long, cost long, illegal long, audit string, pieces array<struct<part:int,block:long,state:int,audit:string>>"
_FOUND_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()),
    ("pieces", pa.list_(pa.struct([("part", pa.int32()), ("block", pa.int64()), ("state", pa.int32()), ("audit", pa.string())]))),
])


def joined(told: list[dict]) -> tuple[int, int, str, list[tuple[int, str]]]:
    """Cost, illegal neighbours, audit and (state before, audit) of each block, from a conversation's blocks in order."""
    illegal = sum(t["illegal"] for t in told)
    illegal += sum(_illegal(a["last"], b["first"]) for a, b in zip(told, told[1:], strict=False))
    if len(told) == 1:
        _, _, cost, audit = told[0]["whole"][0]
        return cost, illegal, audit, [(0, audit)]
    # best way to each state: cost, audit, and the blocks' parts as a linked list
    best: dict[int, tuple] = {0: (0, "", None)}
    for t in told:
        after: dict[int, tuple] = {}
        for start, to, cost, audit in t["ways"]:
            if start in best:
                way = (best[start][0] + cost, best[start][1] + audit, (best[start][2], start, audit))
                if to not in after or way[:2] < after[to][:2]:
                    after[to] = way
        best = after
    cost, audit, link = min((best[s] for s in ENDS if s in best), key=lambda w: w[:2])
    pieces = []
    while link is not None:
        link, start, part = link
        pieces.append((start, part))
    return cost, illegal, audit, pieces[::-1]


def audits(cut: DataFrame) -> DataFrame:
    """conv_id, cost, illegal, audit and the audit of each block, one row per conversation."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group[c].to_pylist() for c in ("part", "block", "ways", "conv_id")), strict=True))
        cost, illegal, audit, pieces = joined([json.loads(r[2]) for r in rows])
        found = [(rows[0][3], cost, illegal, audit, [
            {"part": r[0], "block": r[1], "state": s, "audit": a} for r, (s, a) in zip(rows, pieces, strict=True)])]
        return pa.Table.from_batches([_batch(found, _FOUND_ARROW)])

    told = cut.where(F.col("at") == -1).select("conv_id", "part", "block", "ways")
    return told.groupBy("conv_id").applyInArrow(run, _FOUND)


_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def repaired_lines(rows: list[tuple], state: int, audit: str) -> list[str]:
    """The ``role:text`` lines of one block: rows are (role, text, copies), in order."""
    lines, at = [], 0
    for role, text, copies in rows:
        while audit[at] == "I":
            state, at = NEXT[state], at + 1
            lines.append(f"{ROLE[state]}:")
        letter, at = audit[at], at + copies  # further copies are always deleted
        if letter == "K":
            state = SYMBOL[role[0]]
            lines.append(f"{role}:{text}")
        elif letter == "R":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:{text}")
    for _ in audit[at:]:
        state = NEXT[state]
        lines.append(f"{ROLE[state]}:")
    return lines


def digests(cut: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of each repaired conversation, streamed in order."""
    pieces = found.select("conv_id", F.explode("pieces").alias("p")).select(
        "conv_id", "p.part", "p.block", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.col("p.state").cast("long").alias("copies"), F.col("p.audit").alias("audit"))
    rows = cut.where(F.col("at") >= 0).select(
        "conv_id", "part", "block", "at", "role", "text", "copies", F.lit(None).cast("string").alias("audit"))
    order = ["conv_id", "part", "block", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, first, out = None, None, True, []
        state, audit, held = 0, "", []

        def flush() -> None:
            nonlocal first, held
            for line in repaired_lines(held, state, audit):
                digest.update((line if first else f"\n{line}").encode("utf-8", "surrogatepass"))
                first = False
            held = []

        for batch in batches:
            for c, _, _, at, role, text, copies, piece in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at == -1:
                    if digest is not None:
                        flush()
                    if digest is None or c != conv:
                        if digest is not None:
                            out.append((conv, digest.hexdigest()))
                        conv, digest, first = c, hashlib.sha256(), True
                    state, audit = copies, piece
                else:
                    held.append((role, text, copies))
            if len(out) > 1000:
                yield _batch(out, _DIGEST_ARROW)
                out = []
        if digest is not None:
            flush()
            out.append((conv, digest.hexdigest()))
        yield _batch(out, _DIGEST_ARROW)

    ordered = pieces.union(rows).repartition("conv_id").sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame, block: int = 512, parts: int | None = None) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, copies): faults, cost, audit and digest."""
    items = settled(faulty(conversations))
    cut = settled(blocks(items, block, parts))
    found = settled(audits(cut))
    counts = items.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1).alias("span"), F.countDistinct("turn").alias("turns"),
        F.sum(F.when(F.col("fault") == "b", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "b", 0).otherwise(F.col("copies") - 1 + (F.col("fault") == "d").cast("long"))).alias("duplicate"),
        F.sum((F.col("fault") == "t").cast("long")).alias("truncated"))
    on = lambda df, name: F.col("conv_id").eqNullSafe(df[name])
    made = found.select(F.col("conv_id").alias("c1"), "cost", "illegal", "audit")
    digest = digests(cut, found).withColumnRenamed("conv_id", "c2")
    return (
        counts.join(made, on(made, "c1")).join(digest, on(digest, "c2"))
        .select(
            "conv_id", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate",
            "truncated", "illegal", "cost", "audit", "repaired_sha256")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    done = repair(damaged(conversations)).withColumnRenamed("conv_id", "c")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))

"""First matches of patterns without a length bound, over text that grows by chunks.

A pattern becomes a deterministic automaton.  A stretch of chunks is then a map
from the state it is entered with to the state it is left with, and maps of
neighbouring stretches compose.  Chunks are range-sorted, so a response of any
size spreads over tasks: each task walks its stretch once, and a response is a
fold over one map for each task that holds a part of it.

Patterns are what automata can express: characters, classes, groups,
alternatives and repeats, with the meaning that Java gives them.  Anchors,
look-around, back references and possessive forms raise ValueError.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MAX_STATES = 512  # bounds the maps that travel
SLICE = 1 << 20  # characters walked at a time
LAST = 0x10FFFF

Ranges = list[tuple[int, int]]

# What Java's classes and dot cover.
DIGITS: Ranges = [(0x30, 0x39)]
SPACES: Ranges = [(0x09, 0x0D), (0x20, 0x20)]
WORDS: Ranges = [(0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A)]
LINE_ENDS: Ranges = [(0x0A, 0x0A), (0x0D, 0x0D), (0x85, 0x85), (0x2028, 0x2029)]


def longest_match(pattern: str) -> int | None:
    """Most characters a match can have; None without a (practical) bound."""
    width = parser.parse(pattern).getwidth()[1]
    return int(width) if width <= 65_536 else None


def outside(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for low, high in sorted(ranges):
        if low > at:
            out.append((at, low - 1))
        at = max(at, high + 1)
    return out + ([(at, LAST)] if at <= LAST else [])


def both_cases(ranges: Ranges) -> Ranges:
    """With the other case of ASCII letters."""
    out = list(ranges)
    for low, high in ranges:
        for first, shift in ((0x41, 32), (0x61, -32)):
            a, b = max(low, first), min(high, first + 25)
            if a <= b:
                out.append((a + shift, b + shift))
    return out


CATEGORIES = {  # by the name that the parser prints
    "CATEGORY_DIGIT": DIGITS, "CATEGORY_NOT_DIGIT": outside(DIGITS),
    "CATEGORY_SPACE": SPACES, "CATEGORY_NOT_SPACE": outside(SPACES),
    "CATEGORY_WORD": WORDS, "CATEGORY_NOT_WORD": outside(WORDS),
}


class Automaton:
    """Finds a pattern anywhere in a text: states and one row of successors for each.

    State 0 is the start; ``final`` is reached with the first match and kept.
    """

    def __init__(self, pattern: str, max_states: int = MAX_STATES):
        self.free: list[list[int]] = [[]]  # steps that read nothing
        self.reads: list[tuple[Ranges, int] | None] = [None]
        tree = parser.parse(pattern)
        end = self._sequence(tree, 0, tree.state.flags)
        edges = {0}
        for read in self.reads:
            for low, high in read[0] if read else ():
                edges |= {low, high + 1}
        self.edges = np.array(sorted(edges), np.uint32)
        self._determine(end, pattern, max_states)
        del self.free, self.reads  # the rows tell all

    def _node(self) -> int:
        self.free.append([])
        self.reads.append(None)
        return len(self.free) - 1

    def _read(self, ranges: Ranges, at: int, flags: int) -> int:
        after = self._node()
        here = self._node()
        self.free[at].append(here)
        self.reads[here] = (both_cases(ranges) if flags & re.IGNORECASE else ranges, after)
        return after

    def _sequence(self, items, at: int, flags: int) -> int:
        for kind, value in items:
            at = self._item(kind, value, at, flags)
        return at

    def _item(self, kind, value, at: int, flags: int) -> int:
        if kind is C.LITERAL:
            return self._read([(value, value)], at, flags)
        if kind is C.NOT_LITERAL:
            hit = [(value, value)]
            return self._read(outside(both_cases(hit) if flags & re.IGNORECASE else hit), at, 0)
        if kind is C.ANY:
            return self._read([(0, LAST)] if flags & re.DOTALL else outside(LINE_ENDS), at, 0)
        if kind is C.IN:
            return self._class(value, at, flags)
        if kind is C.BRANCH:
            after = self._node()
            for option in value[1]:
                first = self._node()
                self.free[at].append(first)
                self.free[self._sequence(option, first, flags)].append(after)
            return after
        if kind is C.SUBPATTERN:
            _, added, removed, inner = value
            return self._sequence(inner, at, (flags | added) & ~removed)
        if kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            return self._repeat(*value, at, flags)
        raise ValueError(f"no automaton for {kind} in a pattern of unbounded length")

    def _class(self, members, at: int, flags: int) -> int:
        ranges: Ranges = []
        for kind, value in members:
            if kind is C.LITERAL:
                ranges.append((value, value))
            elif kind is C.RANGE:
                ranges.append(value)
            elif kind is C.CATEGORY:
                ranges += CATEGORIES[repr(value)]
        if flags & re.IGNORECASE:
            ranges = both_cases(ranges)
        return self._read(outside(ranges) if members[0][0] is C.NEGATE else ranges, at, 0)

    def _repeat(self, low: int, high: int, inner, at: int, flags: int) -> int:
        for _ in range(low):
            at = self._sequence(inner, at, flags)
        after = self._node()
        self.free[at].append(after)
        if high is C.MAXREPEAT:
            self.free[self._sequence(inner, after, flags)].append(after)
            return after
        for _ in range(high - low):
            at = self._sequence(inner, at, flags)
            self.free[at].append(after)
        return after

    def _closure(self, nodes) -> frozenset[int]:
        seen, open_ = set(nodes), list(nodes)
        while open_:
            for node in self.free[open_.pop()]:
                if node not in seen:
                    seen.add(node)
                    open_.append(node)
        return frozenset(n for n in seen if self.reads[n] or not self.free[n])

    def _determine(self, end: int, pattern: str, max_states: int) -> None:
        """States are sets of nodes; the start is in every one, as matches begin anywhere."""
        ending = self._node()
        self.free[end].append(ending)
        start = self._closure([0])
        names, rows, todo = {start: 0}, [], [start]
        done = frozenset([ending])
        if ending in start:
            self.final, self.rows = 0, [[0] * (len(self.edges) + 1)]
            return
        while todo:
            state = todo.pop(0)
            row = [0]  # below the first edge there is no character
            for code in self.edges.tolist():
                to = {self.reads[n][1] for n in state if self.reads[n]
                      and any(a <= code <= b for a, b in self.reads[n][0])}
                after = self._closure(to) | start if to else start
                if ending in after or state == done:
                    after = done
                if after not in names:
                    names[after] = len(names)
                    if len(names) > max_states:
                        raise ValueError(f"pattern {pattern!r} needs more than {max_states} states")
                    todo.append(after)
                row.append(names[after])
            rows.append(row)
        self.rows, self.final = rows, names.get(done, -1)

    def classes(self, text: str) -> Iterator[list[int]]:
        for at in range(0, len(text), SLICE):
            codes = np.frombuffer(text[at:at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
            yield np.searchsorted(self.edges, codes, side="right").tolist()

    def walk(self, states: Sequence[int], text: str) -> list[int]:
        """Where each of ``states`` gets to; states that meet go on as one."""
        ends = list(states)
        for part in self.classes(text):
            reached = {}
            for state in set(ends):
                s = state
                for c in part:
                    s = self.rows[s][c]
                reached[state] = s
            ends = [reached[s] for s in ends]
        return ends


class Stretch:
    """What the chunks of one response in one task do to each state they may be entered with."""

    def __init__(self, automaton: Automaton, at: int, entered: int):
        self.automaton, self.at = automaton, at
        self.ends, self.since = list(range(entered)), [None] * entered

    def add(self, chunk: int, text: str) -> None:
        live = sorted(set(self.ends) - {self.automaton.final})
        if self.ends and self.automaton.final == 0:  # an empty match
            self.since = [chunk if s is None else s for s in self.since]
        if not text or not live:
            return
        to = dict(zip(live, self.automaton.walk(live, text), strict=True))
        for k, state in enumerate(self.ends):
            if state in to:
                self.ends[k] = to[state]
                if to[state] == self.automaton.final:
                    self.since[k] = chunk


def first_matches(
    chunks: DataFrame, patterns: Sequence[str], key: str = "request_id", order: str = "chunk_idx",
    text: str = "text", parts: int | None = None,
) -> DataFrame:
    """(key, pattern, since): the first chunk with which the text so far matches.

    ``pattern`` is the place in ``patterns``; pairs without a match have no row.
    Null texts count as empty, rows without an order value do not count, and
    rows that share one are taken in order of their texts.
    """
    automata = [Automaton(p) for p in patterns]
    key_type = chunks.schema[key].dataType
    out = T.StructType([
        T.StructField(key, key_type), T.StructField("pattern", T.IntegerType()),
        T.StructField("at", T.LongType()), T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("sinces", T.ArrayType(T.LongType()))])
    arrow = pa.schema([
        (key, to_arrow_type(key_type)), ("pattern", pa.int32()), ("at", pa.int64()),
        ("ends", pa.list_(pa.int32())), ("sinces", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, first = None, None, True

        def told(last: bool) -> Iterator[pa.RecordBatch]:
            # A response inside the task needs no row unless it matches.
            rows = [(name, k, s.at, s.ends, s.since) for k, s in enumerate(held)
                    if first or last or s.since[0] is not None]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            for row_key, at, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or row_key != name:
                    if held is not None:
                        yield from told(False)
                        first = False
                    name = row_key
                    # The task's first response may have begun before it.
                    held = [Stretch(a, at, len(a.rows) if first else 1) for a in automata]
                for stretch in held:
                    stretch.add(at, body)
        if held is not None:
            yield from told(True)

    slim = chunks.where(F.col(order).isNotNull()).select(
        key, F.col(order).cast("long").alias("_at"), F.coalesce(text, F.lit("")).alias("_text"))
    by = [F.col(key), F.col("_at")]
    dealt = slim.repartitionByRange(parts, *by) if parts else slim.repartitionByRange(*by)
    pieces = dealt.sortWithinPartitions(key, "_at", "_text").mapInArrow(run, out)
    # One piece for each task that holds a part of the response.
    listed = pieces.groupBy(key, "pattern").agg(
        F.sort_array(F.collect_list(F.struct("at", "ends", "sinces"))).alias("pieces"))
    start = F.struct(F.lit(0).alias("state"), F.lit(None).cast("long").alias("since"))
    folded = F.aggregate("pieces", start, lambda so_far, piece: F.struct(
        F.get(piece["ends"], so_far["state"]).alias("state"),
        F.coalesce(so_far["since"], F.get(piece["sinces"], so_far["state"])).alias("since")))
    return listed.select(key, "pattern", folded["since"].alias("since")).where("since is not null")

"""Removal of repeated byte strings with a logarithmic family of suffix indexes.

A string of ``length`` bytes that also starts earlier is found through sampled
suffixes.  In every window of that length the suffix whose first ``GRAM`` bytes
hash lowest is sampled, so equal windows sample the same place wherever they
stand, and one suffix in about thirty-five is kept.  A suffix is known by the
hash of its first bytes (key) and the hash of all bytes that a window through
it can reach on either side (context).

The index is a family of levels, each a table of suffixes sorted by key and
context that holds the first place of every context.  A batch of documents is
sorted the same way and merge-scanned with all levels in one pass: a suffix
whose context is known lies wholly in earlier text.  Levels of equal size and
the batch become one larger level in that same pass, as in a binary counter.

Contexts that share a key but are not equal may still share windows; they occur
where repeats begin and end.  They are put aside, and resolved once with their
bytes: all windows of a key are hashed side by side and each takes the first
place where it occurs.  Keys with very many contexts are dealt out by window
instead.  The order of the tables is that of hashes, not of bytes: a scan needs
equal suffixes next to each other, and hashes keep partitions even.

Suffixes are first compared within a task, so what shuffles holds each context
about once per task.  Strings are judged on the input texts.

Defined results: null and empty texts have no bytes; texts below ``length``
bytes lose nothing; repeated rows of one id count as one document and get one
result each; a null id comes before all others; an empty table gives no rows.
"""

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm.common import slices, slim, table
from gateledger.session import ensure_checkpoint_dir

U = np.uint64
GRAM = 32
BASE = U(0x9E3779B97F4A7C15)
PIECE = 1 << 20
CROWDED = 4096  # contexts of one key beyond which its windows are dealt out
NEW, MERGED, SPAN, ASIDE, STAYS = 0, 1, 2, 3, 4
ROWS = "key long, ctx long, doc long, pos long, kind int"
NO_ID = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """Minimum or maximum of every ``width`` values in a row."""
    y, k = x, 1
    while 2 * k <= width:
        y, k = least(y[:-k], y[k:]), 2 * k
    n = len(x) - width + 1
    return least(y[:n], y[width - k:width - k + n])


class Hasher:
    """Hashes of byte ranges from prefix sums modulo 2^64."""

    def __init__(self):
        self.letters = mix(np.arange(1, 257, dtype=U))
        self.grow(PIECE + 1024)

    def grow(self, n: int) -> None:
        inverse = pow(int(BASE), -1, 1 << 64)
        steps = np.full(n, BASE, U)
        steps[0] = 1
        self.up = np.cumprod(steps)
        steps = np.full(n, inverse, U)
        steps[0] = 1
        self.down = np.cumprod(steps)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.grow(2 * len(data))
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(self.letters[data] * self.down[:len(data)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.up[start]


def sample(hasher: Hasher, data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int):
    """Sampled suffixes of texts that lie side by side: place, text, key, context."""
    reach = length - GRAM  # bytes that a window can reach before its suffix
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    sums = hasher.prefix(data)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * hasher.up[:len(data) - GRAM + 1])
    top = U(2**64 - 1)
    # grams across the end of a text stand for nothing
    across = (end[:, None] - np.arange(1, GRAM)[None, :]).ravel()
    grams[across[(across >= 0) & (across < len(grams))]] = top
    lowest = slide(grams, reach + 1, np.minimum)
    padded = np.concatenate([np.zeros(reach, U), lowest, np.zeros(reach, U)])
    at = np.flatnonzero((grams == slide(padded, reach + 1, np.maximum)[:len(grams)]) & (grams != top))
    text = np.searchsorted(start, at, "right") - 1
    left, right = np.maximum(start[text], at - reach), np.minimum(end[text], at + length)
    context = mix(mix(hasher.ranges(sums, left, right)) ^ ((at - left).astype(U) << U(32)) ^ (right - at).astype(U))
    return at, text, grams[at].view(np.int64), context.view(np.int64)


def pieces(texts: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, int, int, bytes]]]:
    """Groups of (document, offset, first, end, bytes) of about PIECE bytes; long texts
    are cut with overlap, and suffixes are taken from [first, end) only."""
    held, size = [], 0
    for doc, data in texts:
        for low in range(0, len(data), PIECE):
            high = min(len(data), low + PIECE)
            a, b = max(0, low - 1024), min(len(data), high + 1024)
            part = (doc, a, low - a, high - a, data[a:b])
            if held and size + b - a > PIECE:
                yield held
                held, size = [], 0
            held.append(part)
            size += b - a
    if held:
        yield held


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document joined where they touch or overlap."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    change = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    rank = np.zeros(len(doc), np.int64)
    rank[change] = 1
    rank = np.cumsum(rank) - 1
    # a running maximum that starts anew with each document
    shift = rank * (int(end.max()) + 2)
    reached = np.maximum.accumulate(end + shift)
    opens = np.concatenate([[True], (start + shift)[1:] > reached[:-1]])
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], (reached - shift)[last]


def leaders(opens: np.ndarray) -> np.ndarray:
    """For each row the last row at or before it that opens a group (0 if there is none)."""
    return np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))


def rows_out(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate([np.broadcast_to(p[k], len(p[2])) for p in parts]) for k in range(5)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(np.int64)) for c in columns[:4]] + [pa.array(columns[4].astype(np.int32))],
        ["key", "ctx", "doc", "pos", "kind"])


def span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
    doc, start, end = merged(doc, start, end)
    return mix(doc.astype(np.int64).view(U)).view(np.int64), end, doc, start, SPAN


def covered(pos: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all windows through suffixes at ``pos`` (empty if there is none)."""
    low, high = np.maximum(0, pos - (length - GRAM)), np.minimum(pos, size - length)
    return low, np.where(high >= low, high + length, low)


def suffixes(docs: DataFrame, length: int, flush: int = 1_000_000) -> DataFrame:
    """Sampled suffixes of a batch, and spans that repeat text of the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[tuple] = []
        n = 0

        def out():
            key, ctx, doc, pos, size = (np.concatenate([h[k] for h in held]) for k in range(5))
            order = np.lexsort((pos, doc, ctx, key))
            key, ctx, doc, pos, size = (v[order] for v in (key, ctx, doc, pos, size))
            again = np.concatenate([[False], (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1])])
            lead = leaders(~again)
            same = (doc == doc[lead]) & (pos == pos[lead])  # a repeated row is no earlier text
            key, ctx, doc, pos, size, again = (v[~same | ~again] for v in (key, ctx, doc, pos, size, again))
            low, high = covered(pos, size, length)
            fine = again & (high > low)
            parts = [(key[~again], ctx[~again], doc[~again], pos[~again], NEW)]
            if fine.any():
                parts.append(span_rows(doc[fine], low[fine], high[fine]))
            return rows_out(parts)

        for batch in batches:
            for part in slices(batch):
                texts = [(d, t) for d, t in zip(
                    part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)
                    if len(t) >= length]
                whole = {}
                for d, t in texts:
                    whole[d] = len(t)
                for group in pieces(list(dict(texts).items())):
                    data = np.frombuffer(b"".join(g[4] for g in group), np.uint8)
                    sizes = np.array([len(g[4]) for g in group])
                    end = np.cumsum(sizes)
                    at, text, key, ctx = sample(hasher, data, end - sizes, end, length)
                    doc, offset, first, last = (np.array([g[k] for g in group]) for k in range(4))
                    local = at - (end - sizes)[text]
                    keep = (local >= first[text]) & (local < last[text])
                    text, local = text[keep], local[keep]
                    held.append((key[keep], ctx[keep], doc[text], offset[text] + local,
                                 np.array([whole[d] for d in doc.tolist()])[text]))
                    n += len(text)
                if n >= flush:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return docs.mapInArrow(run, ROWS)


def scan(rows: DataFrame, length: int) -> DataFrame:
    """One pass over sorted suffixes of levels and batch.

    Gives the batch's spans of known contexts, the entries of the next level,
    and the contexts put aside.  State is one row, so a key may have any number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, int] | None = None  # key and context of the last row
        lead_at = (0, 0)  # document and place where that context came first
        first: tuple[int, int, int, int] | None = None  # lone first suffix of the last key
        for batch in batches:
            key, ctx, doc, pos, kind = (batch.column(k).to_numpy() for k in range(5))
            parts = []
            passed = kind == SPAN
            if passed.any():
                parts.append((key[passed], ctx[passed], doc[passed], pos[passed], SPAN))
                key, ctx, doc, pos, kind = (v[~passed] for v in (key, ctx, doc, pos, kind))
            if len(key):
                other = np.concatenate([[before is None or before[0] != key[0]], key[1:] != key[:-1]])
                fresh = other | np.concatenate([[before is None or before[1] != ctx[0]], ctx[1:] != ctx[:-1]])
                lead = leaders(fresh)
                led = fresh[lead]  # else the context began in an earlier batch
                lead_doc, lead_pos = np.where(led, doc[lead], lead_at[0]), np.where(led, pos[lead], lead_at[1])
                again = ~fresh & (kind == NEW) & ((doc != lead_doc) | (pos != lead_pos))
                lead_at = (lead_doc[-1], lead_pos[-1])
                if again.any():  # ends are cut to the text when spans are applied
                    low = np.maximum(0, pos[again] - (length - GRAM))
                    parts.append(span_rows(doc[again], low, pos[again] + length))
                entry = fresh & (kind != STAYS)
                parts.append((key[entry], ctx[entry], doc[entry], pos[entry], MERGED))
                at = np.flatnonzero(fresh)
                if len(at):
                    opens = other[at]
                    if first is not None and not opens[0]:
                        parts.append(tuple(np.array([v]) for v in first) + (ASIDE,))
                    more = np.concatenate([~opens[1:], [False]])
                    mixed = ~opens | more
                    group = np.cumsum(opens)
                    young = np.zeros(group[-1] + 1, bool)
                    np.logical_or.at(young, group, kind[at] == NEW)
                    young[[group[0], group[-1]]] = True  # may go on in other batches
                    mixed &= young[group]
                    m = at[mixed]
                    parts.append((key[m], ctx[m], doc[m], pos[m], ASIDE))
                    z = at[-1]
                    first = (key[z], ctx[z], doc[z], pos[z]) if opens[-1] else None
                before = (key[-1], ctx[-1])
            parts = [p for p in parts if len(p[2])]
            if parts:
                yield rows_out(parts)

    return rows.repartition("key").sortWithinPartitions("key", "ctx", "doc", "pos").mapInArrow(run, ROWS)


class LogIndex:
    """The family of levels.  Batches come in ascending document id."""

    def __init__(self, spark: SparkSession, length: int = 100):
        if length < 2 * GRAM:
            raise ValueError(f"length must be {2 * GRAM} at least")
        self.spark, self.length, self.batches = spark, length, 0
        self.levels: list[tuple[int, str]] = []  # (rank, path), largest first
        self.tables: list[str] = []

    def write(self, df: DataFrame) -> str:
        """A table in the shared folder; its shuffle files go once it stands."""
        path = f"{ensure_checkpoint_dir(self.spark)}/suffixes-{uuid.uuid4()}"
        option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = self.spark.conf.get(option, "false")
        self.spark.conf.set(option, "true")
        try:
            df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
        finally:
            self.spark.conf.set(option, was)
        return path

    def read(self, path: str, kind: int) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(path).where(F.col("kind") == kind)

    def add(self, docs: DataFrame) -> None:
        """Scan a batch (doc_id, text) against all levels and take it in."""
        rank, merging = 0, []
        while len(self.levels) > len(merging) and self.levels[-1 - len(merging)][0] == rank:
            merging.append(self.levels[-1 - len(merging)])
            rank += 1
        staying = self.levels[:len(self.levels) - len(merging)]
        rows = suffixes(docs, self.length)
        for held, kind in ((merging, MERGED), (staying, STAYS)):
            for _, path in held:
                rows = rows.unionByName(
                    self.read(path, MERGED).select("key", "ctx", "doc", "pos", F.lit(kind).alias("kind")))
        path = self.write(scan(rows, self.length))
        self.tables.append(path)
        self.levels = [*staying, (rank, path)]
        for _, old in merging:
            self.drop(old, MERGED)

    def drop(self, path: str, kind: int) -> None:
        """Remove a level that has been merged; spans beside it stay."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def of_kind(self, kind: int) -> DataFrame:
        found = self.read(self.tables[0], kind)
        for path in self.tables[1:]:
            found = found.unionByName(self.read(path, kind))
        return found

    def spans(self, docs: DataFrame) -> DataFrame:
        """All repeated spans (doc, start, end); ends may pass the text's end."""
        known = self.of_kind(SPAN).select("doc", F.col("pos").alias("start"), F.col("ctx").alias("end"))
        return known.unionByName(self.resolve(docs))

    def resolve(self, docs: DataFrame) -> DataFrame:
        aside = self.of_kind(ASIDE).select("key", "doc", "pos").distinct()
        crowded = aside.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select(
            "key", F.lit(True).alias("dealt"))
        marked = aside.join(crowded, "key", "left").groupBy("doc").agg(
            # as many suffixes as a text of its length has
            F.collect_list(F.struct("key", "pos", F.coalesce("dealt", F.lit(False)).alias("dealt"))).alias("found"))
        with_text = docs.join(marked, docs.doc_id == marked.doc).select("doc", "text", "found")
        contexts = windows(with_text, self.length)
        return compared(
            contexts.repartition("key").sortWithinPartitions("key", "doc", "pos"), self.length)


def windows(rows: DataFrame, length: int) -> DataFrame:
    """Bytes around each suffix; of crowded keys the hash of every window instead."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch):
                docs = part.column(0).to_pylist()
                texts = part.column(1).cast(pa.binary()).to_pylist()
                for doc, text, found in zip(docs, texts, part.column(2), strict=True):
                    found = found.values
                    key, pos = found.field("key").to_numpy(), found.field("pos").to_numpy()
                    dealt = found.field("dealt").to_numpy(zero_copy_only=False)
                    out = []
                    for k in np.flatnonzero(~dealt):
                        p = int(pos[k])
                        left = max(0, p - reach)
                        out.append((key[k], p, p - left, text[left:p + length]))
                    for k in np.flatnonzero(dealt):
                        p = int(pos[k])
                        low, high = max(0, p - reach), min(p, len(text) - length)
                        if high < low:
                            continue
                        data = np.frombuffer(text[low:high + length], np.uint8)
                        start = np.arange(high - low + 1)
                        hashes = mix(hasher.ranges(hasher.prefix(data), start, start + length)).view(np.int64)
                        out += [(h, low + s, -1, None) for s, h in zip(start.tolist(), hashes, strict=True)]
                    if out:
                        yield pa.RecordBatch.from_arrays([
                            pa.array([o[0] for o in out], pa.int64()), pa.array([doc] * len(out), pa.int64()),
                            pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int32()),
                            pa.array([o[3] for o in out], pa.binary()),
                        ], ["key", "doc", "pos", "left", "ctx"])

    return rows.mapInArrow(run, "key long, doc long, pos long, left int, ctx binary")


def compared(rows: DataFrame, length: int) -> DataFrame:
    """Spans of windows that start earlier, from sorted contexts and dealt-out windows."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[pa.RecordBatch] = []
        last = None  # key, document and place that opened the last group of dealt-out windows
        for batch in batches:
            single = batch.column(3).to_numpy() < 0
            if single.any():
                part = batch.filter(pa.array(single))
                key, doc, pos = (part.column(k).to_numpy() for k in range(3))
                opens = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
                lead = leaders(opens)
                led = opens[lead]
                first_doc = np.where(led, doc[lead], last[1] if last else 0)
                first_pos = np.where(led, pos[lead], last[2] if last else 0)
                again = ~opens & ((doc != first_doc) | (pos != first_pos))
                last = (key[-1], first_doc[-1], first_pos[-1])
                if again.any():
                    yield spans(doc[again], pos[again], pos[again] + length)
                batch = batch.filter(pa.array(~single))
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks()
            key = whole.column("key").to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1]) + 1
            upto = int(change[-1]) if len(change) else 0
            if upto:
                yield from match(hasher, whole.slice(0, upto))
            held = whole.slice(upto).to_batches()
        if held:
            yield from match(hasher, pa.Table.from_batches(held).combine_chunks())

    def match(hasher: Hasher, whole: pa.Table, chunk: int = 8192) -> Iterator[pa.RecordBatch]:
        key = whole.column("key").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        low = 0
        while low < len(key):
            high = int(cuts[np.searchsorted(cuts, min(len(key), low + chunk), "right") - 1])
            if high <= low:
                high = int(cuts[np.searchsorted(cuts, low, "right")])
            found = one(hasher, whole.slice(low, high - low), key[low:high])
            if found is not None:
                yield found
            low = high

    def one(hasher: Hasher, rows_: pa.Table, key: np.ndarray) -> pa.RecordBatch | None:
        n, width = len(key), reach + length
        doc, pos, left = (rows_.column(k).to_numpy() for k in ("doc", "pos", "left"))
        texts = rows_.column("ctx").to_pylist()
        data = np.zeros((n, width), np.uint8)
        for i, (t, l) in enumerate(zip(texts, left.tolist(), strict=True)):
            data[i, reach - l:reach - l + len(t)] = np.frombuffer(t, np.uint8)
        right = np.array([len(t) for t in texts]) - left
        sums = np.zeros((n, width + 1), U)
        np.cumsum(hasher.letters[data] * hasher.down[:width], axis=1, out=sums[:, 1:])
        start = np.arange(reach + 1)  # window starts within the row
        hashes = (sums[:, start + length] - sums[:, start]) * hasher.up[start]
        hashes = mix(mix(hashes) ^ mix(key.view(U))[:, None] ^ mix(start.astype(U) + U(1))[None, :])
        before = reach - start  # bytes of a window before the suffix
        real = (before[None, :] <= left[:, None]) & (length - before[None, :] <= right[:, None])
        flat = np.flatnonzero(real.ravel())
        values = hashes.ravel()[flat]
        # rows stand in order of document and place, so the first of equals is the earliest
        _, first, inverse = np.unique(values, return_index=True, return_inverse=True)
        row, lead = flat // (reach + 1), flat[first[inverse]] // (reach + 1)
        again = flat[(doc[row] != doc[lead]) | (pos[row] != pos[lead])]
        if not len(again):
            return None
        row, at = again // (reach + 1), again % (reach + 1)
        begin = pos[row] - reach + at
        return spans(doc[row], begin, begin + length)

    def spans(doc, start, end) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v) for v in merged(doc, start, end)], ["doc", "start", "end"])

    return rows.mapInArrow(run, "doc long, start long, end long")


def usable(spans, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans within a text from its gathered ones."""
    low = spans.field("start").to_numpy()
    high = np.minimum(spans.field("end").to_numpy(), size)
    fine = high > low
    return merged(np.zeros(int(fine.sum()), np.int64), low[fine], high[fine])[1:]


def without(text: bytes, low: np.ndarray, high: np.ndarray) -> bytes:
    kept, at = [], 0
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def gathered(spans: DataFrame) -> DataFrame:
    # at most as many spans as a text of its length has suffixes
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Counts of what the spans remove, and the digest of the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                texts = part.column(1).cast(pa.binary()).to_pylist()
                for text, found in zip(texts, part.column(2), strict=True):
                    none = np.zeros(0, np.int64)
                    low, high = usable(found.values, len(text)) if found.is_valid else (none, none)
                    rows.append((len(text), int((high - low).sum()), len(low), without(text, low, high)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                    + [pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = gathered(spans)
    joined = docs.join(found, docs.doc_id == found.doc, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_spans(source: DataFrame, length: int, batches: int) -> DataFrame:
    """Spans (doc, start, end) of repeated strings; ``source`` has doc_id and text."""
    shares = [k / batches for k in range(1, batches)]
    cuts = source.agg(F.percentile_approx("doc_id", shares, 10_000).alias("at")).first()["at"] if shares else []
    edges = [None, *sorted(set(cuts or [])), None]
    index = LogIndex(source.sparkSession, length)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = source
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        index.add(batch)
    return index.spans(source)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return slim(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID).cast("long")))


def remove_repeats(
    docs: DataFrame, length: int = 100, batches: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    source = numbered(docs, id_col, text_col)
    return digests(source, repeated_spans(source, length, batches)).withColumn(
        "doc_id", F.nullif("doc_id", F.lit(NO_ID).cast("long")))


def strip_repeats(
    docs: DataFrame, length: int = 100, batches: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows with all their columns, and texts without their repeated strings.

    A character of which a span takes only some bytes stays.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            if text is None or found is None:
                out.append(text)
                continue
            data = text.encode("utf-8", "surrogatepass")
            ends = pa.array(list(found), pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            low, high = usable(ends, len(data))
            inside = (np.frombuffer(data, np.uint8) & 0xC0) == 0x80
            starts = np.flatnonzero(~np.append(inside, False))  # character starts and the end
            low = starts[np.searchsorted(starts, low)]
            high = np.maximum(low, starts[np.searchsorted(starts, high, "right") - 1])
            out.append(without(data, low, high).decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    found = gathered(repeated_spans(numbered(docs, id_col, text_col), length, batches)).toDF("_doc_", "_spans_")
    key = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID).cast("long"))
    joined = docs.join(found, key == found["_doc_"], "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col("_spans_"))).select(docs.columns)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))

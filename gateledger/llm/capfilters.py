"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the code words of a random product code: a direction is a
tuple of unit vectors, one per block of coordinates.  A vector is list-decoded
to every direction within the cap: tuples are extended block by block and
dropped as soon as the best remaining blocks cannot reach the threshold, so
directions far away are never looked at.  Vectors that share a direction are
compared exactly, in double precision; a pair that shares several is counted in
the first of them, where the linked pairs are joined on the spot.  Caps get narrower as the number of vectors grows, so the
number of vectors in a cap stays about ``per_cap``.

Exact copies are one class with a multiplicity, so they are never paired.  A
cap with more than ``block`` classes is cut into blocks, and pairs of blocks are
separate groups; only sums per vector and one edge per vector, which together
connect what the group's links connect, leave a group.

Defined results: null, zero and non-finite vectors (or ones with null
components) link with nothing and are kept; vectors of different lengths never
link; repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm.common import table
from gateledger.llm.components import components
from gateledger.session import durable_table


class CapCode:
    """The product code for vectors of one length; the same in every task."""

    def __init__(self, dims: int, vectors: int, caps: float, per_cap: float, seed: int = 11):
        self.dims = dims
        wanted = max(64.0, vectors * caps / per_cap)
        self.blocks = max(1, min(dims // 2 or 1, math.ceil(math.log(wanted) / math.log(512))))
        self.words = max(2, math.ceil(wanted ** (1 / self.blocks)))
        self.cuts = np.linspace(0, dims, self.blocks + 1).astype(int)
        rng = np.random.default_rng(seed + dims)
        turn, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        self.turn = turn
        self.books = []
        for low, high in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            book = rng.standard_normal((self.words, high - low))
            book /= np.linalg.norm(book, axis=1, keepdims=True)
            self.books.append(book.T / math.sqrt(self.blocks))
        self.threshold = self.cap(min(0.5, caps / self.words ** self.blocks))

    def cap(self, share: float) -> float:
        """The height above which a cap holds ``share`` of the sphere."""
        t = np.linspace(-1, 1, 200_001)
        density = np.clip(1 - t * t, 0, None) ** ((self.dims - 3) / 2) if self.dims > 2 else np.ones_like(t)
        mass = np.cumsum(density[::-1])
        return float(t[::-1][np.searchsorted(mass, share * mass[-1])])

    def decode(self, unit: np.ndarray, least: int = 6) -> list[np.ndarray]:
        """Sorted filter numbers of each vector: all above the threshold, ``least`` at least."""
        turned = unit @ self.turn
        scores = [turned[:, low:high] @ book for low, high, book in
                  zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        return [self.decode_one([s[i] for s in scores], least) for i in range(len(unit))]

    def decode_one(self, scores: list[np.ndarray], least: int) -> np.ndarray:
        best = [s.max() for s in scores]
        rest = [sum(best[k + 1:]) for k in range(self.blocks)]
        least = min(least, self.words ** self.blocks)
        threshold = self.threshold
        while True:
            sums, numbers = np.zeros(1), np.zeros(1, np.int64)
            for k, s in enumerate(scores):
                at = np.flatnonzero(s >= threshold - rest[k] - sums.max(initial=-9.0))
                total = sums[:, None] + s[at][None, :]
                row, col = np.nonzero(total >= threshold - rest[k])
                sums, numbers = total[row, col], numbers[row] * self.words + at[col]
            if len(numbers) >= least:
                return np.sort(numbers)
            threshold -= 0.02  # a vector far from all directions takes its nearest


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can be compared and their unit vectors, all of one length."""
    lists = column.to_pylist()
    good = [i for i, v in enumerate(lists) if v and None not in v]
    x = np.array([lists[i] for i in good], np.float64)
    # squares of very large or small components would leave the range of a double
    most = np.abs(x).max(axis=1, keepdims=True) if len(good) else np.zeros((0, 1))
    x = np.divide(x, most, out=np.zeros_like(x), where=np.isfinite(most) & (most > 0))
    norm = np.linalg.norm(x, axis=1) if len(good) else np.zeros(0)
    fine = np.isfinite(norm) & (norm > 0)
    return np.array(good, np.int64)[fine], x[fine] / norm[fine][:, None]


def usable(column: str):
    c = F.col(column)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda v: v != 0), F.lit(False))


def caps_of(classes: DataFrame, sizes: dict[int, int], caps: float, per_cap: float) -> DataFrame:
    """Classes with their unit vector and the filters that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, CapCode] = {}
        for batch in batches:
            dims = np.array([len(v) for v in batch.column(2)])
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                if d not in codes:
                    codes[d] = CapCode(int(d), sizes[int(d)], caps, per_cap)
                at, unit = unit_rows(part.column(2))
                part = part.take(pa.array(at))
                found = [f + (int(d) << 48) for f in codes[d].decode(unit)] if len(at) else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                    ["rep", "copies", "unit", "filters"])

    return classes.mapInArrow(run, "rep long, copies long, unit binary, filters array<long>")


def compare(rows: DataFrame, cosine: float) -> DataFrame:
    """Per group: each class's linked vectors (a sum), and the least class its links lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table_ = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = np.stack([table_.column(k).to_numpy() for k in ("filter", "one", "two")])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            last = int(change[-1]) if len(change) else 0
            if last:
                yield from groups(table_.slice(0, last), np.concatenate([[0], change]))
            held = table_.slice(last).to_batches()
        if held:
            table_ = pa.Table.from_batches(held).combine_chunks()
            yield from groups(table_, np.array([0, table_.num_rows]))

    def groups(table_: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = table_.column("rep").to_numpy()
        copies = table_.column("copies").to_numpy()
        own = table_.column("block").to_numpy()
        filters = table_.column("filters").to_pylist()
        filter_of = table_.column("filter").to_numpy()
        one, two = table_.column("one").to_numpy(), table_.column("two").to_numpy()
        units = table_.column("unit").to_pylist()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if high - low < 2:
                continue
            x = np.frombuffer(b"".join(units[low:high])).reshape(high - low, -1)
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            if one[low] != two[low]:  # two blocks: only pairs across them
                linked &= own[low:high][:, None] != own[low:high][None, :]
            if not linked.any():
                continue
            linked &= ~met_before(filters[low:high], int(filter_of[low]), linked)
            at = np.flatnonzero(linked.any(axis=1))
            own_ids = ids[low:high][at]
            out.append((own_ids, linked[at] @ copies[low:high], least_reached(linked[np.ix_(at, at)], own_ids)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["rep", "n_links", "least"])

    return rows.mapInArrow(run, "rep long, n_links long, least long")


def least_reached(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each row's links lead to, over any number of steps."""
    least, open_ = ids.copy(), np.ones(len(ids), bool)
    for start in range(len(ids)):
        if not open_[start]:
            continue
        reached = np.zeros(len(ids), bool)
        reached[start] = True
        front = np.array([start])
        while len(front):
            fresh = linked[front].any(axis=0) & ~reached
            reached |= fresh
            front = np.flatnonzero(fresh)
        least[reached] = ids[reached].min()
        open_ &= ~reached
    return least


def met_before(filters: list[list[int]], now: int, linked: np.ndarray) -> np.ndarray:
    """Pairs that share a filter below ``now``."""
    rows = np.flatnonzero(linked.any(axis=1))
    owner = np.repeat(rows, [len(filters[i]) for i in rows])
    values = np.concatenate([filters[i] for i in rows]).astype(np.int64)
    low = values < now
    owner, values = owner[low], values[low]
    kinds, place, times = np.unique(values, return_inverse=True, return_counts=True)
    often = times[place] > 1
    member = np.zeros((len(filters), len(kinds)), np.float32)
    member[owner[often], place[often]] = 1
    return member @ member.T > 0


def link_vectors(
    vectors: DataFrame, cosine: float = 0.95, caps: float = 20.0, per_cap: float = 4.0, block: int = 1024,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    good = source.where(usable("vector")).withColumn(
        "h", F.sha2(F.to_json(F.struct("vector")), 256))
    classes = durable_table(
        good.groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    held = durable_table(caps_of(classes.select("rep", "copies", "vector"), sizes, caps, per_cap))
    spread = held.select("rep", "filters").select(F.explode("filters").alias("filter"))
    crowded = spread.groupBy("filter").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(
        "filter", F.ceil(F.col("n") / block).alias("parts"))
    rows = (
        held.withColumn("filter", F.explode("filters")).join(crowded, "filter")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
        .select("filter", "one", "two", "block", "rep", "copies", "unit", "filters")
        .repartition("filter", "one", "two").sortWithinPartitions("filter", "one", "two")
    )
    found = durable_table(compare(rows, cosine))
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("n"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    per_class = (
        classes.select("h", "rep", "copies").join(counts, "rep", "left")
        .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select("h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id")))
    linked = good.select("vec_id", "h").join(per_class, "h").select("vec_id", "n_links", "component_id")
    alone = source.where(~usable("vector")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))

"""Similarity join of shingle sets with signature trees.

Two documents link when the Jaccard similarity of their shingle sets reaches a
threshold t.  The join is exact up to 64-bit shingle hashes:

1. Equal sets form one class with a representative.
2. Each set is routed to trees.  Linked sets of a size class differ in at most D
   shingles, so when the hash space is cut into more than D segments, some
   segment agrees.  A tree is named by a size class, a segment and the hash of
   what the set has there.  (Segments without shingles may agree too; a set with
   more of them than spare segments also goes to one common tree of its class.)
3. A tree's leaves are sets with a bitmap of their shingles; inner nodes hold
   the OR of the bitmaps, the range of sizes and the most shingles that bitmaps
   hide by collisions.  Two nodes are searched together from the roots down; a
   pair is dropped when the largest overlap its bitmaps and sizes allow is below
   what t asks for, or when all leaves below both are in one component already.
4. Surviving leaf pairs are verified with their sets and joined on the spot, so
   a large group of near copies yields one edge per set and never its pairs.
   Each set names its most common tree; the trees so named are searched with all
   their members, which covers nearly every pair that shares a tree.  The other
   trees then list, without sets, the pairs that met in none of those and are
   not connected; the few that are left are verified in a join.
5. Before any set is moved, trees lose the sets that can link with none there.  A
   sketch has one bit per place, the parity of a set's shingles at it, so two sets
   differ in at least as many shingles as their sketches do in bits.  Texts that
   merely share a line or a phrase go here, for an eighth of a byte a shingle.

Trees beyond ``block`` shingles or LEAVES sets are cut into blocks, and every two
blocks of a tree are searched together, so a task's memory has a bound.

Tree names are walked in ranges.  Each range is reduced to trees that sets share,
and its shuffle is freed, before the next; the trees to search are walked in
ranges too, and after each one trees whose sets are all in one component are left
out of those to come: the names of the others are sent to the blocks.  The links found are the same; peak disk falls with the
number of ranges.

Defined results: null and empty texts have no shingles and are alone; repeated
rows have equal sets and so one component; ties and extra columns have no
effect; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm.common import dropped, few_files, settled, slices, slim, table
from gateledger.llm.components import components
from gateledger.session import fresh_path

U = np.uint64
FANOUT = 8
BLOCK = 2_000_000  # shingles of a block
LEAVES = 4096  # sets of a block
ROOM = 32  # bits of a bitmap for each shingle
NAME_RANGES = 6  # of tree names
SEARCH_RANGES = 4  # of trees searched with their sets
TEXT_RANGES = 3  # of texts made sets of
STRIPE = 256  # rows compared at a time
FEW = 32  # sets of a tree that is compared side by side with others
PIECE = 1 << 22  # bytes of a matrix that is made on the way
WORD_LIMIT = 1_000_000


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str, size: int, hashes: Words) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words in a row; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    codes = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    size = min(size, len(codes))
    value = np.full(len(codes) - size + 1, size, U)
    for k in range(size):
        value = mix(value ^ codes[k:k + len(value)])
    value.sort()
    return value[np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))]


class Router:
    """Tree names of sets, for a threshold ``num/den``."""

    def __init__(self, num: int, den: int, growth: float = 1.6):
        self.num, self.den = num, den
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, int(np.ceil(bounds[-1] * growth))))
        self.bounds = np.array(bounds)

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def segments(self, cls: int) -> tuple[int, int]:
        """Number of segments of a size class, and how many of them may be empty."""
        largest = int(self.bounds[cls + 1]) - 1
        differ = (self.den - self.num) * 2 * largest // (self.den + self.num)
        if not differ:
            return 0, 0  # only equal sets link
        spare = 2 + differ // 8
        return differ + 1 + spare, spare

    def trees(self, shingles: np.ndarray) -> np.ndarray:
        n, out = len(shingles), []
        if not n:
            return np.zeros(0, np.int64)
        for cls in range(self.size_class(n), self.size_class(n * self.den // self.num) + 1):
            count, spare = self.segments(cls)
            if not count:
                continue
            segment = (shingles >> U(32)) % U(count)
            order = np.argsort(segment.astype(np.uint32), kind="stable")
            segment = segment[order]
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            held = np.add.reduceat(mix(shingles)[order], first)
            out.append(mix(held ^ mix(segment[first] + (U(cls) << U(40)))))
            if count - len(first) > spare:
                out.append(mix(np.array([(cls << 40) + (1 << 39)], U)))
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit per shingle, with room for few collisions; a power of two of words."""
    bits = max(256, 1 << int(np.ceil(np.log2(ROOM * max(1, len(shingles))))))
    flags = np.zeros(bits, np.uint8)
    flags[(shingles & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(U)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A shorter bitmap of the same set."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles at each place, with a place or two a shingle; a power of two of words."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    flags = np.bincount((shingles & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flags.astype(np.uint8), bitorder="little").view(U)


class Sketches:
    """Sketches of a block's sets, and which of these may link for a threshold ``num/den``."""

    def __init__(self, rows: list[np.ndarray], sizes: np.ndarray, num: int, den: int):
        self.sizes, self.most, self.all = sizes, den - num, den + num
        self.words, self.row, self.grids = np.array([len(r) for r in rows]), np.zeros(len(rows), np.int64), {}
        for words in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == words)
            self.row[at], self.grids[words] = np.arange(len(at)), np.stack([rows[i] for i in at])

    def folded(self, at: np.ndarray, words: int) -> np.ndarray:
        """Shorter sketches of the same sets."""
        out = np.empty((len(at), words), U)
        for wide in np.unique(self.words[at]).tolist():
            use = self.words[at] == wide
            grid = self.grids[wide][self.row[at[use]]]
            out[use] = np.bitwise_xor.reduce(grid.reshape(len(grid), -1, words), axis=1)
        return out

    def crossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of some sets may link with which of others."""
        out = np.zeros((len(a), len(b)), bool)
        for wide in np.unique(self.words[a]).tolist():
            for other in np.unique(self.words[b]).tolist():
                i, j = np.flatnonzero(self.words[a] == wide), np.flatnonzero(self.words[b] == other)
                words, apart = min(wide, other), np.zeros((len(i), len(j)), np.int32)
                left, right = self.folded(a[i], words).T, np.ascontiguousarray(self.folded(b[j], words).T)
                for k in range(words):
                    apart += np.bitwise_count(left[k][:, None] ^ right[k][None, :])
                both = self.sizes[a[i]][:, None] + self.sizes[b[j]][None, :]
                out[np.ix_(i, j)] = apart * self.all <= self.most * both
        return out

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs may link."""
        out, least = np.zeros(len(i), bool), np.minimum(self.words[i], self.words[j])
        for words in np.unique(least).tolist():
            use = np.flatnonzero(least == words)
            step = max(1, PIECE // (8 * words))
            for at in range(0, len(use), step):
                a, b = i[use[at:at + step]], j[use[at:at + step]]
                apart = np.bitwise_count(self.folded(a, words) ^ self.folded(b, words)).sum(axis=1, dtype=np.int64)
                out[use[at:at + step]] = apart * self.all <= self.most * (self.sizes[a] + self.sizes[b])
        return out

    def partnered(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which sets may link with one of the other side; the sides are the same or share none."""
        found, passed = np.zeros(len(self.sizes), bool), []

        def compare(here: np.ndarray, there: np.ndarray) -> None:
            here, there = (x[np.argsort(self.sizes[x], kind="stable")] for x in (here, there))
            sizes, step = self.sizes[there], max(1, min(STRIPE, PIECE // (8 * max(1, len(there)))))
            den, num = self.all + self.most, self.all - self.most  # twice as large, in proportion
            for at in range(0, len(here), step):
                stripe = here[at:at + step]
                # those that have a partner are not compared again
                passed.append(stripe[found[stripe]])
                stripe = stripe[~found[stripe]]
                if not len(stripe):
                    continue
                low = np.searchsorted(den * sizes, num * self.sizes[stripe[0]])
                high = np.searchsorted(num * sizes, den * self.sizes[stripe[-1]], "right")
                near = self.crossed(stripe, there[low:high]) & (stripe[:, None] != there[low:high][None, :])
                found[stripe] |= near.any(axis=1)
                found[there[low:high]] |= near.any(axis=0)

        compare(left, right)
        if left is not right:
            compare(right[~found[right]], np.concatenate(passed))
        return found


class Tree:
    """Leaves in an order that puts similar sets together, and the nodes above them.

    A level is (bitmaps, least sizes, largest sizes, hidden shingles).
    """

    def __init__(self, sets: list[np.ndarray], words: int):
        grid = np.stack([folded(bitmap(s), words) for s in sets])
        sizes = np.array([len(s) for s in sets])
        # near copies agree in most low words, so sorting by them brings them together
        self.order = np.lexsort((grid[:, 0], grid[:, min(1, words - 1)]))
        grid, sizes = grid[self.order], sizes[self.order]
        hidden = sizes - np.bitwise_count(grid).sum(axis=1, dtype=np.int64)
        self.levels = [(grid, sizes, sizes, hidden)]
        while len(self.levels[-1][0]) > 1:
            grid, low, high, hidden = self.levels[-1]
            cut = np.arange(0, len(grid), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(grid, cut, axis=0), np.minimum.reduceat(low, cut),
                np.maximum.reduceat(high, cut), np.maximum.reduceat(hidden, cut)))


def words_for(sets: list[np.ndarray]) -> int:
    """Words of the shortest bitmap; longer ones fold to it."""
    return len(bitmap(min(sets, key=len)))


class Union:
    def __init__(self, n: int):
        self.up, self.links = list(range(n)), 0

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, root: int, other: int) -> None:
        self.up[other] = root
        self.links += 1

    def roots(self) -> np.ndarray:
        up = np.array(self.up)
        while (up != up[up]).any():
            up = up[up]
        return up


class Joined:
    """Least and greatest component of the leaves below each node, as links are found."""

    def __init__(self, union: Union, trees: list[tuple[Tree, np.ndarray]]):
        # leaves of each tree as positions in the union
        self.union, self.leaves = union, [at[tree.order] for tree, at in trees]
        self.links, self.levels = -1, []

    def alike(self, k: int, i: np.ndarray, m: int, j: np.ndarray) -> np.ndarray:
        if self.links != self.union.links:
            self.links, roots = self.union.links, self.union.roots()
            self.levels = [self.bounds(roots[at]) for at in self.leaves]
        low, high = self.levels[0][k]
        other_low, other_high = self.levels[-1][m]
        return (low[i] == high[i]) & (low[i] == other_low[j]) & (low[i] == other_high[j])

    @staticmethod
    def bounds(roots: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        levels = [(roots, roots)]
        while len(levels[-1][0]) > 1:
            low, high = levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
        return levels


def search(
    one: Tree, two: Tree, num: int, den: int, joined: Joined, chunk: int = 8192,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs (positions in the input) that may link, by dual traversal.

    Links that the caller adds to ``joined.union`` on the way prune what follows.
    Long sets have wide bitmaps, so fewer of their pairs are compared at a time.
    """
    itself = one is two
    chunk = max(1, min(chunk, PIECE // (8 * one.levels[0][0].shape[1])))
    stack = [(len(one.levels) - 1, len(two.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, m, i, j = stack.pop()
        if len(i) > chunk:
            for at in range(0, len(i), chunk):
                stack.append((k, m, i[at:at + chunk], j[at:at + chunk]))
            continue
        a, b = one.levels[k], two.levels[m]
        keep = (den * a[2][i] >= num * b[1][j]) & (den * b[2][j] >= num * a[1][i])
        keep &= ~joined.alike(k, i, m, j)
        i, j = i[keep], j[keep]
        common = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(a[3][i], b[3][j]), np.minimum(a[2][i], b[2][j]))
        keep = most * (num + den) >= num * (a[1][i] + b[1][j])
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if k == 0 and m == 0:
            yield one.order[i], two.order[j]
            continue
        if k >= m:
            i, j = children(i, j, len(one.levels[k - 1][0]))
            k -= 1
        if m > k:
            j, i = children(j, i, len(two.levels[m - 1][0]))
            m -= 1
        if itself and k == m:
            keep = (i < j) if k == 0 else (i <= j)
            i, j = i[keep], j[keep]
        stack.append((k, m, i, j))


def children(i: np.ndarray, j: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    deeper = (i[:, None] * FANOUT + np.arange(FANOUT)[None, :]).ravel()
    other = np.repeat(j, FANOUT)
    real = deeper < below
    return deeper[real], other[real]


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return den * common >= num * (len(a) + len(b) - common)


def whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in whole groups, however batches cut them, and where groups end; each group is bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        values = np.stack([rows.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        if len(cuts):
            yield rows.slice(0, int(cuts[-1])), cuts
        held = rows.slice(int(cuts[-1]) if len(cuts) else 0).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, np.array([rows.num_rows])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of sorted rows, one by one."""
    for rows, ends in whole(batches, keys):
        for low, high in zip([0, *ends[:-1]], ends, strict=True):
            yield rows.slice(int(low), int(high - low))


def edges_out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (tree, held, weight, rep, ...) dealt to every pair of blocks of their tree."""
    parts = F.greatest(F.ceil(F.col("weight") / block), F.ceil(F.col("held") / LEAVES))
    return (
        rows.withColumn("part", F.pmod(F.xxhash64("rep"), parts))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other"))
        .drop("other", "held", "weight")
    )


def together(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "one", "two").sortWithinPartitions("tree", "one", "two")


def sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two blocks of a group; the same twice for one block."""
    part = rows.column("part").to_numpy()
    one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
    left = np.flatnonzero(part == one)
    return left, left if one == two else np.flatnonzero(part == two)


def open_blocks(trees: DataFrame, block: int) -> DataFrame:
    """A row without a set for every two blocks of the trees (tree, held, weight) still to search."""
    parts = F.greatest(F.ceil(F.col("weight") / block), F.ceil(F.col("held") / LEAVES))
    return (
        trees.withColumn("one", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .withColumn("two", F.explode(F.sequence(F.col("one"), parts - 1)))
        .select("tree", "one", "two", F.lit(None).cast("long").alias("part"),
                F.lit(None).cast("long").alias("rep"), F.lit(None).cast("binary").alias("shingles")))


def with_partners(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (tree, rep, n) of sets that may link with another of their tree, by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, ends in whole(batches, ["tree", "one", "two"]):
            held = np.diff(ends, prepend=0)
            found, group = np.zeros(rows_.num_rows, bool), np.repeat(np.arange(len(ends)), held)
            # most trees are small, and those are compared side by side
            few = np.flatnonzero((held[group] <= FEW) & (rows_.column("one").to_numpy() == rows_.column("two").to_numpy()))
            if len(few):
                found[few] = neighbours(block_of(rows_.take(few), num, den), group[few])
            done = np.zeros(len(ends), bool)
            done[group[few]] = True
            for k in np.flatnonzero(~done):
                low = ends[k] - held[k]
                part = rows_.slice(int(low), int(held[k]))
                left, right = sides(part)
                if len(left) and len(right):
                    found[low:ends[k]] = block_of(part, num, den).partnered(left, right)
            if found.any():
                yield from rows_.select(["tree", "rep", "n"]).filter(pa.array(found)).combine_chunks().to_batches()

    # a set may have partners in several blocks
    return rows.mapInArrow(run, "tree long, rep long, n long").distinct()


def neighbours(sketches: Sketches, group: np.ndarray) -> np.ndarray:
    """Which sets may link with another of their group; groups are small and stand side by side."""
    found = np.zeros(len(group), bool)
    for k in range(1, FEW):
        i = np.flatnonzero(group[k:] == group[:-k])
        if not len(i):
            break
        i = i[sketches.may_link(i, i + k)]
        found[i] = found[i + k] = True
    return found


def block_of(rows: pa.Table, num: int, den: int) -> Sketches:
    column = rows.column("sketch").combine_chunks()
    return Sketches([np.frombuffer(s.as_buffer(), U) for s in column], rows.column("n").to_numpy(), num, den)


def join_trees(rows: DataFrame, num: int, den: int, marked: bool = False) -> DataFrame:
    """Edges that connect the linked sets of every two blocks, verified where they are found.

    ``marked``: only blocks with a row of ``open_blocks`` are searched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in grouped(batches, ["tree", "one", "two"]):
            if marked:
                real = rows_.column("rep").is_valid()
                if rows_.column("rep").null_count == 0 or rows_.column("rep").null_count == rows_.num_rows:
                    continue
                rows_ = rows_.filter(real).combine_chunks()
            left, right = sides(rows_)
            if rows_.num_rows < 2 or not len(left) or not len(right):
                continue
            ids = rows_.column("rep").to_pylist()
            sets = [np.frombuffer(s.as_buffer(), U) for s in rows_.column("shingles").combine_chunks()]
            words = words_for(sets)
            one = Tree([sets[i] for i in left], words)
            two = one if left is right else Tree([sets[i] for i in right], words)
            union, pairs = Union(len(sets)), []
            joined = Joined(union, [(one, left)] if two is one else [(one, left), (two, right)])
            for i, j in search(one, two, num, den, joined):
                for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
                    p, q = union.root(x), union.root(y)
                    if p != q and links(sets[x], sets[y], num, den):
                        union.link(p, q)
                        pairs.append((ids[x], ids[y]))
            if pairs:
                yield edges_out(pairs)

    return rows.mapInArrow(run, "a long, b long")


def meeting(stripe: np.ndarray, right: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows of a stripe share a place with which rows of the other side.

    The matrices are as wide as some of the stripe's places, a piece after another.
    """
    out = np.zeros((len(stripe), len(right)), bool)
    names = np.unique(place[np.isin(owner, stripe)])
    if not len(names):
        return out
    column = np.minimum(np.searchsorted(names, place), len(names) - 1)
    known = names[column] == place
    owner, column = owner[known], column[known]
    spots = []
    for rows in (stripe, right):
        spot = np.full(int(max(owner.max(), rows.max())) + 1, -1)
        spot[rows] = np.arange(len(rows))
        use = spot[owner] >= 0
        at = column[use]
        order = np.argsort(at, kind="stable")
        spots.append((spot[owner[use]][order], at[order]))
    wide = max(1, PIECE // (4 * max(len(stripe), len(right))))
    for low in range(0, len(names), wide):
        high, grids = min(low + wide, len(names)), []
        for rows, (row, at) in zip((stripe, right), spots, strict=True):
            own = slice(*np.searchsorted(at, [low, high]))
            grid = np.zeros((len(rows), high - low), np.float32)
            grid[row[own], at[own] - low] = 1
            grids.append(grid)
        out |= grids[0] @ grids[1].T > 0
    return out


def not_met(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a tree across components that met in no searched tree and fit by size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in grouped(batches, ["tree", "one", "two"]):
            left, right = sides(rows_)
            groups = rows_.column("component").to_numpy()
            if not len(left) or not len(right) or (groups == groups[0]).all():
                continue
            ids, sizes = rows_.column("rep").to_numpy(), rows_.column("n").to_numpy()
            met = rows_.column("met").combine_chunks()
            place = met.values.slice(met.offsets[0].as_py(), met.offsets[-1].as_py() - met.offsets[0].as_py()).to_numpy()
            ends = met.offsets.to_numpy() - met.offsets[0].as_py()
            sketches = block_of(rows_, num, den)
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            for at in range(0, len(left), STRIPE):
                stripe = left[at:at + STRIPE]
                open_ = groups[stripe][:, None] != groups[right][None, :]
                small = np.minimum(sizes[stripe][:, None], sizes[right][None, :])
                open_ &= den * small >= num * np.maximum(sizes[stripe][:, None], sizes[right][None, :])
                if left is right:
                    open_ &= stripe[:, None] < right[None, :]
                if open_.any():
                    open_ &= ~meeting(stripe, right, owner, place)
                i, j = np.nonzero(open_)
                may = sketches.may_link(stripe[i], right[j])
                i, j = i[may], j[may]
                if len(i):
                    a, b = ids[stripe[i]], ids[right[j]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(s.as_buffer(), U) for s in batch.column(k)] for k in (2, 3))
            keep = [links(x, y, num, den) for x, y in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def routed(docs: DataFrame, num: int, den: int, shingle: int) -> DataFrame:
    """Set size, digest, sketch and trees of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, router = Words(), Router(num, den)
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, shingle, hashes) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([sketch(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    pa.array([router.trees(s) for s in sets], pa.list_(pa.int64())),
                ], ["doc_id", "n", "digest", "sketch", "trees"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, sketch binary, trees array<long>")


def shared_trees(rows: DataFrame) -> DataFrame:
    """Rows (tree, rep) of trees with two sets or more, with the tree's size and a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted rows: a row stays if its neighbour before or after has its tree.
        tail: pa.RecordBatch | None = None
        joins = False  # the kept last row has a partner already

        def cut(rows_: pa.Table, joined_before: bool, final: bool):
            trees = rows_.column("tree").to_numpy()
            same = trees[1:] == trees[:-1]
            keep = np.zeros(len(trees), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if joined_before:
                keep[0] = True
            upto = len(trees) if final else len(trees) - 1
            out = rows_.slice(0, upto).filter(pa.array(keep[:upto]))
            return out, bool(keep[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows_ = pa.Table.from_batches([tail, batch] if tail is not None else [batch]).combine_chunks()
            out, joins = cut(rows_, joins, False)
            yield from out.to_batches()
            tail = rows_.slice(rows_.num_rows - 1).combine_chunks().to_batches()[0]
        if tail is not None:
            out, _ = cut(pa.Table.from_batches([tail]), joins, True)
            yield from out.to_batches()

    return rows.repartition("tree").sortWithinPartitions("tree").mapInArrow(run, "tree long, rep long, n long")


def jaccard_components(
    docs: DataFrame, num: int = 85, den: int = 100, shingle: int = 4, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text", spent: list[str] | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    ``spent`` gets the paths of large tables that the result does not read.
    """
    spark, source = docs.sparkSession, slim(docs, id_col, text_col)
    # Trees are needed until the shared ones stand; their table goes then.
    path = fresh_path(spark)
    named_sets = settled(routed(source, num, den, shingle), path)
    marked = settled(few_files(named_sets.select("doc_id", "n", "digest"), named_sets.count()))
    classes = marked.where(F.col("n") > 0).groupBy("digest").agg(F.min("doc_id").alias("rep"))
    # The representative's row carries the trees; of equal ids any row will do.
    own = named_sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    leads = classes.select(F.col("rep").alias("doc_id"), "digest")
    shared, parts = None, []
    for k in range(NAME_RANGES):
        mine = F.filter("trees", lambda t: F.pmod(F.xxhash64(t, F.lit(1)), F.lit(NAME_RANGES)) == k)
        rows = (
            own.select("doc_id", "digest", "n", F.array_distinct(mine).alias("trees"))
            .join(leads, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"])
            .select(F.explode("trees").alias("tree"), F.col("doc_id").alias("rep"), "n"))
        parts.append(fresh_path(spark))
        part = settled(shared_trees(rows), parts[-1])
        shared = part if shared is None else shared.union(part)
    sketches = own.select("doc_id", "digest", "sketch").join(leads, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"])
    sketches = settled(sketches.select(F.col("doc_id").alias("rep"), "sketch"))
    dropped(spark, path)

    alike = settled(few_files(of_each(shared), shared.count()))
    for path in parts:
        dropped(spark, path)
    left = None
    for k in range(SEARCH_RANGES):
        part = in_blocks(alike.where(in_range("tree", k)), block).join(sketches, "rep")
        part = settled(with_partners(
            together(part.select("tree", "one", "two", "part", "rep", "n", "sketch")), num, den))
        left = part if left is None else left.union(part)
    trees = settled(few_files(of_each(left), left.count()))
    n_rows = trees.count()

    named = trees.groupBy("rep").agg(F.max(F.struct("held", "tree")).alias("home")).select("home.tree").distinct()
    searched = settled(few_files(trees.join(named, "tree").select("tree", "held", "weight", "rep"), n_rows))
    # Each set carries its searched trees, so a range moves only the sets that it needs; they
    # meet the text before it becomes a set, since sets take more room than texts.
    at = searched.select("rep", F.struct("tree", "held", "weight").alias("t"))
    near = settled(few_files(
        trees.select("rep").distinct().select("rep", F.lit(None).cast(at.schema["t"].dataType).alias("t")).union(at)
        .groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list("t").alias("at")), n_rows))
    sets, known = None, None
    for k in range(TEXT_RANGES):
        texts = source.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(TEXT_RANGES)) == k)
        path = fresh_path(spark)
        part = settled(sets_of(texts.join(near, "doc_id"), shingle), path)
        sets = part if sets is None else sets.union(part)
        if spent is not None:
            spent.append(path)
    for k in range(SEARCH_RANGES):
        part = sets.select("rep", "shingles", F.explode(F.filter("at", lambda t: in_range(t["tree"], k))).alias("t")).select(
            "t.tree", "t.held", "t.weight", "rep", "shingles")
        part = in_blocks(part, block).select("tree", "one", "two", "part", "rep", "shingles")
        if known is not None:
            # Sets are moved once: what is left to search comes to the blocks, not the sets to it.
            part = part.union(open_blocks(apart(searched.where(in_range("tree", k)), known), block))
        found = settled(join_trees(together(part), num, den, known is not None))
        known = settled(grown(known, found))

    # at most the trees of one set
    met = searched.groupBy("rep").agg(F.collect_list("tree").alias("met"))
    others = settled(few_files(trees.join(named, "tree", "left_anti"), n_rows))
    others = others.join(apart(others, known).select("tree"), "tree").join(known, "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    left_over = settled(not_met(together(
        in_blocks(others, block).join(met, "rep").join(sketches, "rep")
        .select("tree", "one", "two", "part", "rep", "n", "component", "met", "sketch")), num, den).distinct())
    # The sets of such pairs are few, and only those are moved to either side.
    ends = settled(few_files(
        left_over.select(F.col("a").alias("rep")).union(left_over.select("b")).distinct(), 2 * left_over.count()))
    path = fresh_path(spark)
    few = settled(sets.select("rep", "shingles").join(ends, "rep", "left_semi"), path)
    second = settled(verified(left_over, few, num, den))
    dropped(spark, path)
    final = grown(known, second)
    groups = classes.join(final, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return marked.select("doc_id", "n", "digest").join(groups, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def of_each(rows: DataFrame) -> DataFrame:
    """Rows (tree, rep, n) with their tree's sets and shingles; of trees with the same sets one is enough."""
    sizes = rows.groupBy("tree").agg(
        F.count("*").alias("held"), F.sum("n").alias("weight"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("mark"))
    single = sizes.groupBy("held", "weight", "mark").agg(F.min("tree").alias("tree")).select("tree", "held", "weight")
    return rows.join(single, "tree")


def in_range(tree: Column | str, k: int) -> Column:
    """Whether a tree is of the k-th range of those searched."""
    return F.pmod(F.xxhash64(tree, F.lit(2)), F.lit(SEARCH_RANGES)) == k


def grown(known: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components (rep, component) after more links; those known count as one link for each set."""
    if known is not None:
        found = known.select(F.col("rep").alias("a"), F.col("component").alias("b")).union(found)
    return components(found, found.count()).withColumnRenamed("id", "rep")


def apart(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Trees (tree, held, weight) whose sets are in two components or more."""
    group = F.coalesce("component", "rep")
    return rows.join(known, "rep", "left").groupBy("tree", "held", "weight").agg(
        F.min(group).alias("low"), F.max(group).alias("high")).where("low < high").select("tree", "held", "weight")


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """Sets of documents (doc_id, text, at); what is in ``at`` goes with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, shingle, hashes) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), part.column(2),
                ], ["rep", "shingles", "at"])

    kind = docs.schema["at"].dataType.simpleString()
    return docs.select("doc_id", "text", "at").dropDuplicates(["doc_id"]).mapInArrow(
        run, f"rep long, shingles binary, at {kind}")


def one_of_each(docs: DataFrame, num: int = 85, den: int = 100, shingle: int = 4,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose document leads its component.

    Of rows that repeat an id one stays; rows with a null id stay.
    """
    spent: list[str] = []
    found = jaccard_components(docs, num, den, shingle, BLOCK, id_col, text_col, spent)
    for path in spent:
        dropped(docs.sparkSession, path)
    leading = found.where(F.col("doc_id") == F.col("component_id")).select(
        F.col("doc_id").alias("_lead_")).distinct()
    kept = docs.join(leading, docs[id_col].cast("long") == leading["_lead_"], "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))

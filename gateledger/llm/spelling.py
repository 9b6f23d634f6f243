"""Spelling variants: near words found in a trie over letter-group counts.

A word's counts of ``GROUPS`` (its length first) are its path in a trie.  One
inserted letter raises one count, one replaced letter raises one and lowers
another or changes none, so a search carries a budget of one surplus and one
deficit down the trie and reaches every near word; words at the leaves are
compared letter by letter.

The upper levels of the trie are keys of a shuffle: a word lies under its own
path and visits the paths that its budget reaches.  A subtree with more than
``crowd`` words is cut ``STEP`` levels deeper, again and again, so no task holds
more than a bounded subtree; below that a task walks its subtree depth first,
with all visitors of a node at once.  Each pair is met once: the longer word is
reached from the shorter one, and of two words of one length the surplus comes
first.  Leaves with many words (anagrams of each other) are joined by equal
first or second halves, of which one edit leaves one as it was.

Defined results: null and empty texts have no words; a null id counts as an
empty one where ids are hashed; repeated rows count as often as they stand
there; equal counts are settled by code-point order; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm.common import settled, slim, table

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letter groups, frequent letters alone; all other characters are one more group.
GROUPS = ("e", "a", "i", "n", "t", "o", "r", "s", "h", "d", "l", "u", "cm", "bgp", "fvw", "jkqxyz")
LEVELS = len(GROUPS) + 2  # length, groups, others
FIRST, STEP = 4, 5
# What may still be spent: nothing yet of two, a deficit, a surplus, nothing more.
EITHER, DEFICIT, SURPLUS, NONE = 0, 1, 2, 3


def noisy_words(docs: DataFrame, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run of letters (lower-cased), where one in ``every`` hashed runs has lost a letter."""
    runs = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
        .select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    )
    hashed = runs.select("run", F.crc32(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of words that are long and frequent enough."""
    return (
        words.where(F.length("word") >= letters)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    )


_GROUP_OF = np.full(0x110000, len(GROUPS) + 1, np.int8)
for _i, _letters in enumerate(GROUPS):
    for _letter in _letters:
        _GROUP_OF[ord(_letter)] = _i + 1


def points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word starts (one more for the end)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return flat, np.concatenate([[0], ends])


def counts(words: list[str]) -> np.ndarray:
    """The path of each word: length, then letters of each group."""
    flat, at = points(words)
    owner = np.repeat(np.arange(len(words)), np.diff(at))
    found = np.bincount(owner * LEVELS + _GROUP_OF[flat], minlength=len(words) * LEVELS)
    found = found.reshape(len(words), LEVELS)
    found[:, 0] = np.diff(at)
    return found


def targets(vector: list[int], start: int, stop: int, state: int) -> list[tuple[list[int], int]]:
    """Paths of levels start..stop that a search can be on, with what it may still spend.

    Nothing is spent on the length (level 0): it is its own step before.
    """
    found = [(vector[start:stop], state)]
    for i in range(start, stop):
        if state in (EITHER, SURPLUS):
            more = list(vector[start:stop])
            more[i - start] += 1
            left = DEFICIT if state == EITHER else NONE
            found.append((more, left))
            if left == DEFICIT:
                for j in range(i + 1, stop):
                    if more[j - start] > 0:
                        less = list(more)
                        less[j - start] -= 1
                        found.append((less, NONE))
        elif state == DEFICIT and vector[i] > 0:
            less = list(vector[start:stop])
            less[i - start] -= 1
            found.append((less, NONE))
    return found


_ROUTED = "path string, visits boolean, state int, word string, n long"


def _routed(words: DataFrame, stop: int) -> DataFrame:
    """Each word under its own path of ``stop`` levels, and on every path it has to visit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for word, n, vector in zip(frame.word, frame.n, counts(list(frame.word)).tolist(), strict=True):
                rows.append((_text(vector[:stop]), False, NONE, word, n))
                for longer, state in ((0, EITHER), (1, SURPLUS)):
                    for path, left in targets(vector, 1, stop, state):
                        rows.append((_text([vector[0] + longer, *path]), True, left, word, n))
            yield pd.DataFrame(rows, columns=["path", "visits", "state", "word", "n"])

    return words.mapInPandas(run, _ROUTED)


def _deeper(rows: DataFrame, start: int, stop: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[tuple] = []
            vectors = counts(list(frame.word)).tolist()
            for path, visits, state, word, n, vector in zip(
                    frame.path, frame.visits, frame.state, frame.word, frame.n, vectors, strict=True):
                if not visits:
                    found.append((f"{path}.{_text(vector[start:stop])}", False, state, word, n))
                else:
                    found += [(f"{path}.{_text(p)}", True, left, word, n)
                              for p, left in targets(vector, start, stop, state)]
            yield pd.DataFrame(found, columns=["path", "visits", "state", "word", "n"])

    return rows.mapInPandas(run, _ROUTED)


def _text(path: list[int]) -> str:
    return ".".join(map(str, path))


class Subtree:
    """The words under one path, in path order, and a walk of visitors through them."""

    def __init__(self, words: list[str], start: int):
        own = counts(words)
        order = np.lexsort(own.T[::-1])
        self.words = np.array(words, object)[order]
        self.own = own[order]
        self.start = start

    def near(self, visitors: list[str], states: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in words, position in visitors) of near pairs, in parts."""
        self.visitors = np.array(visitors, object)
        self.theirs = counts(visitors)
        yield from self._walk(0, len(self.words), self.start, np.arange(len(visitors)), states)

    def _walk(self, low: int, high: int, level: int, who: np.ndarray, states: np.ndarray):
        if low == high or not len(who):
            return
        if level == LEVELS or (high - low) * len(who) <= 2048:
            yield from self._leaf(low, high, level, who, states)
            return
        column = self.own[low:high, level]
        values, first = np.unique(column, return_index=True)
        ends = np.append(first[1:], high - low)
        theirs = self.theirs[who, level]
        for value, a, b in zip(values, first, ends, strict=True):
            step = value - theirs
            more = (step == 1) & ((states == EITHER) | (states == SURPLUS))
            less = (step == -1) & (states == DEFICIT)
            on = (step == 0) | more | less
            if on.any():
                after = np.where(more & (states == EITHER), DEFICIT, np.where(more | less, NONE, states))
                yield from self._walk(low + a, low + b, level + 1, who[on], after[on])

    def _leaf(self, low: int, high: int, level: int, who: np.ndarray, states: np.ndarray):
        """Pairs whose remaining counts agree with the budget, verified."""
        if (high - low) * len(who) > 1 << 20:
            pairs = self._by_halves(low, high, who)
        else:
            pairs = np.repeat(np.arange(low, high), len(who)), np.tile(np.arange(len(who)), high - low)
        for at in range(0, len(pairs[0]), 1 << 16):
            x, k = pairs[0][at:at + (1 << 16)], pairs[1][at:at + (1 << 16)]
            q, state = who[k], states[k]
            step = self.own[x, level:] - self.theirs[q, level:]
            up, down = np.maximum(step, 0).sum(1), np.maximum(-step, 0).sum(1)
            # a same-length pair is met from the side on which the surplus stands first
            first = np.take_along_axis(step, (step != 0).argmax(1)[:, None], 1)[:, 0] if step.shape[1] else up
            fits = (
                ((state == NONE) & (up == 0) & (down == 0))
                | ((state == SURPLUS) & (up == 1) & (down == 0))
                | ((state == DEFICIT) & (up == 0) & (down == 1))
                | ((state == EITHER) & (up == 1) & (down == 1) & (first > 0))
            )
            alike = (state == EITHER) & (up == 0) & (down == 0)
            fits |= alike & (self.words[x] > self.visitors[q])
            x, q = x[fits], q[fits]
            if len(x):
                good = one_edit(self.visitors[q].tolist(), self.words[x].tolist())
                if good.any():
                    yield x[good], q[good]

    def _by_halves(self, low: int, high: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that share their first or their second half, as one edit leaves it."""
        halves = [len(w) // 2 for w in self.visitors[who]]
        kinds = {(len(w), h) for w, h in zip(self.visitors[who], halves, strict=True)}
        theirs = pd.DataFrame({
            "k": np.arange(len(who)), "size": [len(w) for w in self.visitors[who]],
            "head": [w[:h] for w, h in zip(self.visitors[who], halves, strict=True)],
            "tail": [w[h:] for w, h in zip(self.visitors[who], halves, strict=True)],
        })
        parts = []
        for size, half in kinds:
            ours = pd.DataFrame({
                "x": np.arange(low, high), "head": [w[:half] for w in self.words[low:high]],
                "tail": [w[len(w) - (size - half):] for w in self.words[low:high]],
            })
            some = theirs[theirs["size"] == size]
            by_head = some[["k", "head", "tail"]].merge(ours, on="head", suffixes=("", "_x"))
            by_tail = some[["k", "head", "tail"]].merge(ours, on="tail", suffixes=("", "_x"))
            parts += [by_head[["x", "k"]], by_tail.loc[by_tail["head"] != by_tail["head_x"], ["x", "k"]]]
        pairs = pd.concat(parts)
        return pairs["x"].to_numpy(), pairs["k"].to_numpy()


def one_edit(short: list[str], long: list[str]) -> np.ndarray:
    """Whether each pair (second of equal length or one longer) differs by exactly one edit."""
    out = np.zeros(len(short), bool)
    sizes = np.fromiter(map(len, long), np.int64, len(long))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, (1 << 21) // max(1, int(size)))
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            b = points([long[i] for i in part])[0].reshape(len(part), size)
            lengths = np.fromiter((len(short[i]) for i in part), np.int64, len(part))
            for less in (0, 1):
                pick = np.flatnonzero(lengths == size - less)
                if not len(pick):
                    continue
                a = points([short[part[i]] for i in pick])[0].reshape(len(pick), size - less)
                other = b[pick]
                if not less:
                    out[part[pick]] = (a != other).sum(1) == 1
                    continue
                head = np.logical_and.accumulate(a == other[:, :-1], 1).sum(1)
                tail = np.logical_and.accumulate((a == other[:, 1:])[:, ::-1], 1).sum(1)
                out[part[pick]] = head + tail >= size - 1
    return out


def near_pairs(words: DataFrame, crowd: int = 20_000) -> DataFrame:
    """(word, near, near_n), both ways, for words (word, n) that differ by one edit."""
    depth, open_rows, parts = FIRST, _routed(words, FIRST), []
    while True:
        if depth < LEVELS:
            open_rows = settled(open_rows)
            big = (
                open_rows.where(~F.col("visits")).groupBy("path").agg(F.count(F.lit(1)).alias("size"))
                .where(F.col("size") > crowd).select("path")
            )
            crowded = not big.isEmpty()
        else:
            crowded = False
        parts.append(_walked(open_rows.join(big, "path", "left_anti") if crowded else open_rows, depth))
        if not crowded:
            break
        deeper = min(depth + STEP, LEVELS)
        open_rows = _deeper(open_rows.join(big, "path", "left_semi"), depth, deeper)
        depth = deeper
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def _walked(rows: DataFrame, depth: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        own = group.filter(pc.invert(group["visits"])).to_pydict()
        there = group.filter(group["visits"]).to_pydict()
        found: dict[str, list] = {"word": [], "near": [], "near_n": []}
        if own["word"] and there["word"]:
            tree = Subtree(own["word"], depth)
            own_n = dict(zip(own["word"], own["n"], strict=True))
            their_n = np.array(there["n"])
            for x, q in tree.near(there["word"], np.array(there["state"])):
                a, b = tree.words[x].tolist(), tree.visitors[q].tolist()
                found["word"] += a + b
                found["near"] += b + a
                found["near_n"] += their_n[q].tolist() + [own_n[w] for w in a]
        return pa.Table.from_pydict(found, _PAIRS)

    return rows.groupBy("path").applyInArrow(run, "word string, near string, near_n long")


_PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form; each round doubles the steps that are taken.

    A form is at least twice as frequent as its word, so chains are short and
    never come back.
    """
    state = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.toDF("at", "next")
        step = settled(
            state.join(ahead, F.col("root") == F.col("at"), "left")
            .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = step.select("word", "root")
        if step.where("moved").isEmpty():
            return state


def variants(vocabulary: DataFrame, crowd: int = 20_000) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of (word, n)."""
    words = settled(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    best = (
        near_pairs(words, crowd).groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("top"))
    )
    frequent = -F.col("top.minus") >= 2 * F.col("n")
    known = settled(words.join(best, "word", "left").select(
        "word", F.when(frequent, F.col("top.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, -F.col("top.minus")).alias("form_n")))
    last = roots(known.where(F.col("form").isNotNull()))
    return known.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(noisy_words(slim(table(spark, sf_dir, "documents")))))

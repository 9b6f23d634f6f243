"""Quality rules: boosted trees over document statistics, flattened to arrays.

Statistics are counted over whole texts.  Trees are grown by histograms on a
bounded sample of labelled rows (``max_rows``; statistics only, no texts reach
the driver).  Chosen statistics are constrained: more symbols, repeats or
duplicate lines can never raise the score.  A fitted forest is five node arrays
that score a whole batch per step, with no walk over single rows.

Defined results: null or empty texts have zero statistics and fail the base
rule; repeated rows score alike; without labels of both classes the base rule
alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm.common import per_text, slim, table, text_column

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Features of the trees; +1: the score may only rise with it, -1: only fall.
FEATURES = {
    "words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1,
    "repeat_share": -1, "distinct_share": 1, "upper_share": -1, "exclaim_per_word": -1,
    "longest_run_share": -1, "words_per_line": 0,
}


def word_codes(words: list) -> np.ndarray:
    """Small integers that are equal for equal words."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(codes)
    if n < 4:
        return 0
    base = int(codes.max()) + 1
    windows = codes[:-2] * base + codes[1:-1]
    # two steps keep the product small for any number of words
    _, windows = np.unique(windows, return_inverse=True)
    _, inverse, counts = np.unique(windows * base + codes[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    cover = np.zeros(n, bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def statistics(text: str) -> tuple:
    """The five counts, then the features, of one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    dups = len(lines) - len(set(lines))
    if not n:
        return (0, chars, symbols, dups, 0) + (0.0,) * len(FEATURES)
    codes = word_codes(words)
    repeats = repeated_words(codes)
    edge = np.flatnonzero(np.diff(codes))
    run = int(np.diff(np.concatenate([[-1], edge, [n - 1]])).max())
    upper = sum(map(bytes.isupper, words)) / n
    return (
        n, chars, symbols, dups, repeats,
        np.log1p(n), chars / n, symbols / n, dups / len(lines), repeats / n,
        (int(codes.max()) + 1) / n, upper, text.count("!") / n, run / n, n / len(lines),
    )


@dataclass
class Forest:
    """Trees as arrays over all nodes; a leaf points at itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            low = x[rows, self.feature[node]] <= self.cut[node]
            node = np.where(low, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x))) if len(x) else np.zeros(0)


def grow(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4,
    rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0,
) -> Forest:
    """Boost logistic loss by histogram trees under monotone constraints.

    A split keeps the order that its sign asks for, and hands its two sides the
    middle of their values as a bound, so no later split can break the order.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = [np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)]
    rate0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(rate0 / (1 - rate0)))
    margin = np.full(n, base)
    nodes: list[list] = []  # feature, cut, left, right, value
    roots = []

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + ridge), low, high))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        root = len(nodes)
        nodes.append([0, np.inf, root, root, 0.0])
        roots.append(root)
        open_ = [(root, np.arange(n), -np.inf, np.inf)]
        for level in range(depth + 1):
            following = []
            for at, rows, low, high in open_:
                g, h = grad[rows].sum(), hess[rows].sum()
                own = leaf(g, h, low, high)
                best = (1e-6, None)
                for f in range(width) if level < depth else ():
                    size = len(cuts[f]) + 1
                    if size < 2:
                        continue
                    gl = np.cumsum(np.bincount(binned[f][rows], grad[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(binned[f][rows], hess[rows], size))[:-1]
                    vl = np.clip(-gl / (hl + ridge), low, high)
                    vr = np.clip(-(g - gl) / (h - hl + ridge), low, high)
                    # gain of the (bounded) values over the parent's
                    def part(v, a, b):
                        return -(a * v + 0.5 * (b + ridge) * v * v)
                    gain = part(vl, gl, hl) + part(vr, g - gl, h - hl) - part(own, g, h)
                    wrong = (hl < least) | (h - hl < least) | (signs[f] * (vr - vl) < 0)
                    gain[wrong] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, vl[k], vr[k]))
                if best[1] is None:
                    nodes[at][4] = rate * own
                    margin[rows] += rate * own
                    continue
                f, k, vl, vr = best[1]
                left, right = len(nodes), len(nodes) + 1
                nodes.append([0, np.inf, left, left, 0.0])
                nodes.append([0, np.inf, right, right, 0.0])
                nodes[at][:4] = [f, cuts[f][k], left, right]
                side = binned[f][rows] <= k
                middle = (vl + vr) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)),
                          0: ((low, high), (low, high))}[int(signs[f])]
                following += [(left, rows[side], *bounds[0]), (right, rows[~side], *bounds[1])]
            open_ = following
    flat = [np.array([node[i] for node in nodes]) for i in range(5)]
    return Forest(flat[0].astype(np.int64), flat[1].astype(float), flat[2].astype(np.int64),
                  flat[3].astype(np.int64), flat[4].astype(float), np.array(roots), depth, base)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and features (one array) of each document."""
    return scored(docs, None, 0.5, id_col, text_col)


def judge(texts: list[str], forest: Forest | None, threshold: float) -> dict[str, list]:
    """Counts, base rule, score and verdict of each text; features too without a forest."""
    rows = [statistics(t) for t in texts]
    found = {c: [r[i] for r in rows] for i, c in enumerate(COUNTS)}
    x = np.array([r[len(COUNTS):] for r in rows], float).reshape(len(rows), len(FEATURES))
    failed = [r[0] < 50 or 100 * r[4] > 50 * r[0] for r in rows]
    chance = forest.probability(x) if forest else np.ones(len(rows))
    found["base_failed"] = failed
    found["kept"] = [not f and c >= threshold for f, c in zip(failed, chance.tolist(), strict=True)]
    found["score"] = chance
    if not forest:
        found["features"] = x.tolist()
    return found


def scored(
    docs: DataFrame, forest: Forest | None, threshold: float, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    def make():
        return lambda texts: judge(texts, forest, threshold)

    schema = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return per_text(docs, make, schema + ("" if forest else ", features array<double>"), id_col, text_col)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Forest | None:
    """A forest from a hash-chosen sample of about ``max_rows`` labelled documents."""
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
    )
    have = marked.count()
    if have > max_rows:
        part = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20))
        marked = marked.where(part < int((1 << 20) * max_rows / have))
    rows = slim(docs).join(marked, "doc_id").select("doc_id", "text")
    sample = (
        features(rows).join(marked, "doc_id").where(~F.col("base_failed"))
        .select("features", "quality").toPandas()
    )
    if len(sample) < 40 or sample.quality.nunique() < 2:
        return None
    x = np.array(sample.features.tolist(), float)
    return grow(x, sample.quality.to_numpy(float), np.array(list(FEATURES.values())))


def rules(
    docs: DataFrame, forest: Forest | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: the counts, base_failed, score and kept."""
    return scored(docs, forest, threshold, id_col, text_col).drop("features")


def without_poor(docs: DataFrame, forest: Forest | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the rules keep."""
    return docs.where(text_column(lambda: lambda texts: judge(texts, forest, threshold)["kept"], "boolean", text_col))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules(docs, fit(docs, table(spark, sf_dir, "labels")))

"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Texts are lower-cased, look-alike letters and digit substitutions are folded
one character to one, and lexicon terms are matched at word borders of the
unfolded text; a term that ends in ``*`` is a stem and matches word beginnings.
Accented letters are letters of their languages and stay.  A match inside an exception phrase does not count.  The sum of
weights is divided by the length in words and turned into a probability by a
monotone table fitted to labelled rows.

Weights are learned from labelled rows: term counts by class are Spark
aggregates over a bounded sample (``max_rows``), and only the strongest
``max_terms`` terms and the per-row densities of that sample reach the driver.

Defined results: null or empty text scores as a text without matches; repeated
rows score alike; with no labelled rows the seed terms and a fixed table are
used; null labels are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm.common import per_text, slim, table, text_column

# Letters of other scripts that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ſ": "s",
}
SUBSTITUTED = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "i", "+": "t",
}
SEEDS = {
    "idiot": 2.0, "idiots": 2.0, "moron": 2.0, "morons": 2.0, "imbecile": 2.0, "stupid": 1.5,
    "scum": 2.0, "worthless": 1.5, "pathetic": 1.5, "disgusting": 1.5, "loser": 1.5,
    "trash": 1.0, "clown": 1.0, "dumbass": 2.5, "asshole": 3.0, "bastard": 2.5, "bitch": 3.0,
    "retard": 3.0, "subhuman": 3.0, "vermin": 2.0,
}
EXCEPTIONS = (
    "trash can", "trash bag", "trash bin", "clown fish", "circus clown", "sore loser",
    "rat bastard brewery", "son of a bitch stew",
)
HELD_OUT_OF = 5
STEMS = range(4, 9)


def fold_table() -> dict[int, str]:
    wide = {chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)}
    fold = {**wide, **LOOK_ALIKE, **SUBSTITUTED}
    # full-width digits and signs fold like the plain ones
    return {ord(k): SUBSTITUTED.get(v, v) for k, v in fold.items()}


def fold(text: str, chars: dict[int, str]) -> str:
    return text.translate(chars)


def lowered(text: str) -> str:
    """Lower case that keeps one character per character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[:1] for c in text)


@dataclass
class Lexicon:
    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    edges: list[float] = field(default_factory=lambda: [0.0, 1.0, 4.0])
    chances: list[float] = field(default_factory=lambda: [0.02, 0.55, 0.9])

    def probability(self, density: np.ndarray) -> np.ndarray:
        return np.interp(density, self.edges, self.chances)


class Matcher:
    """Weighted matches of whole texts; built once per task."""

    def __init__(self, lexicon: Lexicon):
        self.chars = fold_table()
        self.auto = ahocorasick.Automaton()
        words: dict[str, list[tuple[float | None, bool]]] = {}
        for term, weight in lexicon.terms.items():
            stem = term.endswith("*")
            word = fold(lowered(term[:-1] if stem else term), self.chars)
            words.setdefault(word, []).append((weight, stem))
        for phrase in lexicon.exceptions:
            words.setdefault(fold(lowered(phrase), self.chars), []).append((None, False))
        for word, kinds in words.items():
            if word:
                self.auto.add_word(word, (len(word), kinds))
        if len(self.auto):
            self.auto.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        if not len(self.auto) or not text:
            return []
        raw = lowered(text)
        found, spared, n = [], [], len(raw)
        for last, (length, kinds) in self.auto.iter(fold(raw, self.chars)):
            start, end = last + 1 - length, last + 1
            if start and raw[start - 1].isalnum():
                continue
            closed = end == n or not raw[end].isalnum()
            for weight, stem in kinds:
                if not (stem or closed):
                    continue
                if weight is None:
                    spared.append((start, end))
                else:
                    found.append((start, end, weight))
        if spared:
            found = [m for m in found if not any(s <= m[0] and m[1] <= e for s, e in spared)]
        return found

    def weigh(self, text: str) -> tuple[int, float]:
        """Number of matches, and their weight per hundred words."""
        found = self.matches(text)
        if not found:
            return 0, 0.0
        return len(found), 100 * sum(m[2] for m in found) / max(len(text.split()), 1)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF) == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Texts with a label outside the held-out part, a hash-chosen sample of about max_rows."""
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(~held_out())
    )
    have = marked.count()
    if have > max_rows:
        part = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20))
        marked = marked.where(part < int((1 << 20) * max_rows / have))
    # A text that occurs many times counts once.
    return (
        slim(docs).join(marked, "doc_id")
        .withColumn("h", F.sha2(F.col("text"), 256))
        .dropDuplicates(["h", "toxic"])
        .select("doc_id", "text", "toxic")
    )


def learn_terms(rows: DataFrame, max_terms: int, min_docs: int, min_odds: float) -> dict[str, float]:
    """Terms that mark the toxic class: smoothed log odds of document counts."""
    pair = rows.select(F.struct("toxic", "text").alias("row"))

    def terms(batches):
        import pyarrow as pa

        chars = fold_table()
        for batch in batches:
            out: dict[tuple[str, int], int] = {}
            for row in batch.column(0).to_pylist():
                raw = lowered(row["text"])
                words = {fold(w.strip("\"'.,;:!?()[]{}#*$%&|<>"), chars) for w in raw.split()}
                stems = {w[:k] + "*" for w in words for k in STEMS if len(w) > k}
                for word in stems | {w for w in words if 2 < len(w) <= 40}:
                    key = (word, row["toxic"])
                    out[key] = out.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in out], pa.string()),
                 pa.array([k[1] for k in out], pa.int32()),
                 pa.array(list(out.values()), pa.int64())], ["term", "toxic", "n"])

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    counted = (
        pair.mapInArrow(terms, "term string, toxic int, n long")
        .groupBy("term")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("b"),
             F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("g"))
        .where(F.col("b") >= min_docs)
        .withColumn("odds", F.log((F.col("b") + 0.5) / (bad + 1.0)) - F.log((F.col("g") + 0.5) / (good + 1.0)))
        .where(F.col("odds") >= min_odds)
    )
    best = {r["term"]: float(r["odds"]) for r in counted.orderBy(F.desc("b"), "term").limit(max_terms).collect()}
    # A stem speaks for the longer terms that it covers and that add no strength.
    kept: dict[str, float] = {}
    for term in sorted(best, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"))):
        word = term.rstrip("*")
        covered = (kept.get(word[:k] + "*") for k in range(2, len(word) + 1))
        if not any(c is not None and c >= best[term] - 1.5 for c in covered):
            kept[term] = best[term]
    return kept


def fit(
    docs: DataFrame,
    labels: DataFrame,
    seeds: dict[str, float] = SEEDS,
    exceptions: Iterable[str] = EXCEPTIONS,
    max_rows: int = 20_000,
    max_terms: int = 2_000,
    min_docs: int = 8,
    min_odds: float = 3.5,
) -> Lexicon:
    rows = training_rows(docs, labels, max_rows)
    learned = learn_terms(rows, max_terms, min_docs, min_odds)
    folded = {fold(lowered(k), fold_table()): v for k, v in seeds.items()}
    lexicon = Lexicon({**folded, **learned}, tuple(exceptions))
    sample = (
        densities(rows, lexicon)
        .join(rows.select("doc_id", "toxic"), "doc_id")
        .select("density", "toxic").toPandas()
    )
    if len(sample) and sample.toxic.nunique() == 2:
        lexicon.edges, lexicon.chances = monotone_table(
            sample.density.to_numpy(float), sample.toxic.to_numpy(float))
    return lexicon


def monotone_table(density: np.ndarray, toxic: np.ndarray, bins: int = 24):
    """Chance of the toxic class over density: pooled so that it never falls."""
    zero = density <= 0
    cuts = np.unique(np.quantile(density[~zero], np.linspace(0, 1, bins))) if (~zero).any() else np.array([])
    place = np.where(zero, 0, 1 + np.searchsorted(cuts, density, "right"))
    blocks: list[list[float]] = []  # [sum of marks, rows, sum of density]
    for b in np.unique(place):
        at = place == b
        blocks.append([toxic[at].sum(), at.sum(), density[at].sum()])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    edges = [b[2] / b[1] for b in blocks]
    chances = [(b[0] + 0.5) / (b[1] + 1) for b in blocks]
    if zero.any() and len(edges) > 1 and edges[0] == 0.0:
        # Any counted match lies beyond the texts without one.
        least = density[~zero].min()
        edges[1:1], chances[1:1] = [least * 0.5], [chances[0]]
        if edges[2] > least:
            edges[2:2], chances[2:2] = [least], [chances[2]]
    top = max(chances)
    edges.append(edges[-1] + 50 * math.log(2))
    chances.append(min(0.999, top + 0.5 * (1 - top)))
    return [float(e) for e in edges], [float(c) for c in np.maximum.accumulate(chances)]


def densities(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make():
        matcher = Matcher(lexicon)

        def compute(texts):
            got = [matcher.weigh(t) for t in texts]
            density = np.array([g[1] for g in got], float)
            return {
                "n_matches": [g[0] for g in got], "density": density,
                "score": lexicon.probability(density),
            }

        return compute

    return per_text(docs, make, "n_matches long, density double, score double", id_col, text_col)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: held_out, score, predicted, and what they rest on."""
    return densities(docs, lexicon, id_col, text_col).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_matches", "density",
    )


def without_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic."""

    def make():
        matcher = Matcher(lexicon)
        return lambda texts: lexicon.probability(np.array([matcher.weigh(t)[1] for t in texts], float)).tolist()

    return docs.where(text_column(make, "double", text_col) < 0.5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

"""Texts against a table of patterns, met through an index of literals.

A pattern that asks for one whole word, with no letter beside it, holds exactly
where the text's words hold that word: such rules and the words of the texts are
joined, and nothing is left to test.

Every other pattern is read once for a literal that every match must contain.  The
index maps one piece of that literal (six letters, three of a short one), that
which fewest rules share, to its rules.  A text meets a rule when it holds the piece; only such
pairs are tested, first for the whole literal, then with the pattern itself; a
text comes once to up to ``TOGETHER`` of its rules.  So
work grows with texts and hits, not with texts times rules.  Patterns without a
literal are tested against every text, which cannot be avoided, in one array
whose length is checked.

Equal texts are met and tested once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.session import durable_table

try:
    from re import _constants as sre, _parser as parser
except ImportError:  # older interpreters
    import sre_constants as sre
    import sre_parse as parser

PIECE, LONG = 3, 6
TOGETHER = 500
_LETTERS = r"(?:A-Za-z|a-zA-Z)"
# A word of plain letters between edges or other signs, as groups or as looks around.
WHOLE_WORD = re.compile(
    rf"(\(\?i\))?(?:\((?:\?:)?\^\|\[\^{_LETTERS}\]\)|\(\?<!\[{_LETTERS}\]\))"
    rf"([A-Za-z]+)(?:\((?:\?:)?\[\^{_LETTERS}\]\|\$\)|\(\?!\[{_LETTERS}\]\))")
# What case-insensitive matching also takes for i, s and k.
ODD, PLAIN = "İıſK", "iisk"


def required_literal(pattern: str) -> str | None:
    """The longest lower-case text that every match of ``pattern`` contains, if any of ``PIECE`` letters."""
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    found, run = [], []

    def close() -> None:
        found.append("".join(run))
        run.clear()

    def walk(items) -> None:
        for op, arg in items:
            if op is sre.LITERAL:
                run.append(chr(arg).lower())
            elif op is sre.SUBPATTERN:
                walk(arg[-1])
            elif op is sre.AT:
                continue
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)) and arg[0] >= 1:
                walk(arg[2])
                close()
            else:
                close()

    walk(tree)
    close()
    best = max(found, key=len)
    return best if len(best) >= PIECE and not set(best) & set(ODD) else None


def whole_word(pattern: str) -> tuple[str, bool] | None:
    """The word that a pattern asks for as a whole, and whether in any case of its letters."""
    found = WHOLE_WORD.fullmatch(pattern)
    if found is None:
        return None
    return (found[2].lower(), True) if found[1] else (found[2], False)


def indexed(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``rules`` with word and any_case, or with literal and piece; all null where a pattern requires no literal."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = [whole_word(p) for p in frame["pattern"]]
            yield pd.DataFrame({
                "pattern": frame["pattern"],
                "word": pd.Series([w and w[0] for w in words], index=frame.index, dtype=object),
                "any_case": pd.Series([w and w[1] for w in words], index=frame.index, dtype=object),
                "literal": pd.Series([None if w else required_literal(p) for w, p in zip(words, frame["pattern"])],
                                     index=frame.index, dtype=object)})

    known = rules.select(F.col(pattern).alias("pattern")).where("pattern is not null").distinct()
    # Read once; counts of pieces and pieces both come from it.
    literals = durable_table(known.mapInPandas(run, "pattern string, word string, any_case boolean, literal string"))
    literal = F.col("literal")
    own = F.when(F.length(literal) >= LONG, _pieces(literal, LONG)).otherwise(_pieces(literal, PIECE))
    pieces = literals.select("pattern", "literal", F.explode(F.array_distinct(own)).alias("piece"))
    shared = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("rules"))
    rarest = pieces.join(shared, "piece").groupBy("pattern").agg(
        F.min(F.struct("rules", "piece")).alias("best"))
    return literals.join(rarest, "pattern", "left").select(
        "pattern", "word", "any_case", "literal", F.col("best.piece").alias("piece"))


def _pieces(text: Column, size: int) -> Column:
    """All pieces of a text in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _word_matches(distinct: DataFrame, index: DataFrame) -> DataFrame:
    """(hash, pattern) of the rules that ask for a whole word."""
    words = index.where("word is not null")
    kinds = words.groupBy("any_case").agg(
        F.min(F.length("word")).alias("least"), F.max(F.length("word")).alias("most")).collect()  # two at most
    found = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))

    def own(any_case: bool, least: int, most: int) -> Column:
        fit = F.filter(found, lambda w: F.length(w).between(least, most))
        return F.transform(
            F.array_distinct(F.transform(fit, F.lower) if any_case else fit),
            lambda w: F.struct(F.lit(any_case).alias("any_case"), w.alias("word")))

    kept = [own(k.any_case, k.least, k.most) for k in kinds]
    if not kept:
        return distinct.select("hash", F.lit(None).cast("string").alias("pattern")).limit(0)
    return distinct.select("hash", F.inline(F.concat(*kept))).join(words, ["any_case", "word"]).select("hash", "pattern")


def rule_matches(
    texts: DataFrame, rules: DataFrame, key: str, text: str = "text", pattern: str = "pattern",
    carry: tuple[str, ...] = ("rule_id",), inline_limit: int = 1_000,
) -> DataFrame:
    """(key, carry): one row for each row of ``texts`` and each rule that matches it.

    Null texts match nothing; null patterns match nothing; equal patterns of
    several rules each give a row.  More than ``inline_limit`` patterns without a
    literal are refused.
    """
    index = durable_table(indexed(rules, pattern))
    plain = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    hashed = plain.withColumn("hash", F.sha2("text", 256))
    distinct = hashed.groupBy("hash").agg(F.first("text").alias("text"))
    tested = _word_matches(distinct, index)
    folded = F.lower(F.translate("text", ODD, PLAIN))
    sizes = [r.n for r in index.select(F.length("piece").alias("n")).where("n is not null").distinct().collect()]  # two at most
    if sizes:
        every = F.concat(*[F.array_distinct(_pieces(folded, n)) for n in sizes])
        pieces = distinct.select("hash", F.explode(every).alias("piece"))
        pairs = durable_table(pieces.join(index.where("piece is not null"), "piece").select("hash", "pattern", "literal"))
        groups = pairs.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("groups"))
        met = pairs.join(groups, "hash").groupBy("hash", F.pmod(F.xxhash64("pattern"), F.col("groups")).alias("group")).agg(
            F.collect_list(F.struct("pattern", "literal")).alias("met"))
        held = F.filter("met", lambda r: F.contains(F.col("folded"), r["literal"]))
        tested = tested.union(
            met.join(distinct.withColumn("folded", folded), "hash").select("hash", "text", F.explode(held["pattern"]).alias("pattern"))
            .where(F.rlike("text", F.col("pattern"))).select("hash", "pattern"))
    bare = [r.pattern for r in index.where("piece is null and word is null").select("pattern").limit(inline_limit + 1).collect()]
    if len(bare) > inline_limit:
        raise ValueError(f"over {inline_limit} patterns without a required literal")
    if bare:
        arms = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(p)) for p in sorted(bare)]))
        tested = tested.union(distinct.select("hash", F.explode(arms).alias("pattern")))
    named = tested.join(rules.select(F.col(pattern).alias("pattern"), *carry), "pattern").select("hash", *carry)
    return hashed.select(F.col("key").alias(key), "hash").join(named, "hash").select(key, *carry)

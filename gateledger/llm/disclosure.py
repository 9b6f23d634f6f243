r"""Personal data: patterns, and terms that give a protected value away.

Base spans are e-mail addresses, IP addresses, card and telephone numbers.  Each
value found is a protected entity.  The corpus tells how strongly a term reveals
an entity it stands near to: with N texts, ``PMI = log2(N n(t,e) / (n(t) n(e)))``
against the entity's own information ``IC = log2(N / n(e))``.  A term whose share
``PMI / IC`` reaches ``threshold``, seen with the entity in ``contexts`` different
surroundings at least, discloses it.  It is generalised to its stem (the first
half of its letters) where the stem stays below the threshold for every entity
concerned, and removed otherwise; that holds in all texts, whether they name
the entity or not.

Everything is column expressions.  Spark's regular expressions return no
positions, so a text is split at its matches and lengths are added up in blocks.
The patterns have no repeated group that can be given back and start only where
a run of their characters starts, so long runs cost neither stack nor time squared.
Counts are of different texts, so copies prove nothing.  A hot entity or term is
counted in partial sums; surroundings are at most ``WINDOW`` characters of the same
line to either side, so a mention has a bounded number of terms.

Defined results: null texts count as empty and have no spans; a null id is kept;
repeated rows have equal results; positions are code points, ends exclusive; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm.common import settled, slim, table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    TERM: r"\p{L}[\p{L}\p{N}]*+",
}
_PART = "0*+(?:[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?"
_ADDRESS = rf"^{_PART}(?:\.{_PART}){{3}}$"
WINDOW = 200
LETTERS = 4  # of a term at least
THRESHOLD = 0.95
CONTEXTS = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' weighted sum is a multiple of ten."""
    n = F.length(digits)

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, n - at, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(at % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _counts_in(low: int, high: int) -> Callable[[Column], Column]:
    return lambda value: F.length(_digits(value)).between(low, high)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda value: F.lit(True),
    "ip": lambda value: value.rlike(_ADDRESS),
    # 19 digits and 18 separators at most
    "card": lambda value: (F.length(value) <= 37) & _counts_in(16, 19)(value) & _luhn(_digits(value)),
    "phone": lambda value: _counts_in(8, 15)(value),
}
# What a text must hold for a pattern to be worth a try.
HINTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.contains(".") & text.rlike("[0-9]"),
    "card": lambda text: text.rlike("[0-9]"),
    "phone": lambda text: text.contains("+"),
}


def _long_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def _located(text: Column, pattern: str, found: Column, chosen: Column) -> Column:
    """Spans of the matches ``found`` whose positions are in ``chosen``, with the text on both sides.

    A start is the length of all before it: whole blocks of about the square root
    of their number, then matches within the block.
    """
    def spans(gaps: Column, lengths: Column, size: Column, blocks: Column) -> Column:
        heads = F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda j: _long_sum(F.slice(blocks, F.lit(1), j)))

        def span(head: Column) -> Column:
            def one(i: Column) -> Column:
                inside = _long_sum(F.slice(lengths, i - i % size + 1, i % size))
                at = F.get(head, (i / size).cast("int")) + inside + F.length(F.get(gaps, i))
                return F.struct(
                    at.alias("start"), (at + F.length(F.get(found, i))).alias("end"), F.get(found, i).alias("value"),
                    F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"))
            return F.transform(chosen, one)

        return let(heads, span)

    def with_lengths(gaps: Column) -> Column:
        def with_blocks(lengths: Column) -> Column:
            size = F.ceil(F.sqrt(F.size(lengths))).cast("int")
            parts = lambda s: F.transform(
                F.sequence(F.lit(0), ((F.size(lengths) - 1) / s).cast("int")),
                lambda j: _long_sum(F.slice(lengths, j * s + 1, s)))
            return let(size, lambda s: let(parts(s), lambda blocks: spans(gaps, lengths, s, blocks)))
        return let(F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long")), with_blocks)

    return let(F.split(text, pattern, -1), with_lengths)


_SPAN = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def located(text: Column, pattern: str, valid: Callable[[Column], Column], hint: Column) -> Column:
    """Spans of all valid matches of a pattern in a text."""
    def of(found: Column) -> Column:
        chosen = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: valid(F.get(found, i)))
        return F.when(F.size(found) > 0, let(
            chosen, lambda c: F.when(F.size(c) > 0, _located(text, pattern, found, c))))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(F.when(hint, let(matches, of)), F.array().cast(_SPAN))


def base_spans(kind: str, text: Column) -> Column:
    return located(text, PATTERNS[kind], VALID[kind], HINTS[kind](text))


def terms(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    words = F.regexp_extract_all(text, F.lit(PATTERNS[TERM]), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= LETTERS), F.lower))


def stem(term: Column) -> Column:
    """The more general form of a term: the first half of its letters."""
    return F.concat(F.left(term, F.ceil(F.length(term) / 2).cast("int")), F.lit("*"))


def with_stems(found: Column) -> Column:
    return let(found, lambda t: F.concat(t, F.array_distinct(F.transform(t, stem))))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def mentions(docs: DataFrame) -> DataFrame:
    """entity, context (left and right text) and key of the text, for each base span."""
    def side(gap: Column, left: bool) -> Column:
        near = (F.right if left else F.left)(gap, F.lit(WINDOW))
        # a word that the window cuts is left out
        whole = F.regexp_replace(near, r"^[\p{L}\p{N}]+" if left else r"[\p{L}\p{N}]+$", "")
        line = F.when(F.length(gap) > WINDOW, whole).otherwise(near)
        return F.substring_index(line, "\n", -1 if left else 1)

    def told(kind: str) -> Column:
        plain = {"email": F.lower, "ip": lambda v: v}.get(kind, _digits)
        return F.transform(base_spans(kind, F.col("text")), lambda s: F.struct(
            F.concat(F.lit(f"{kind}:"), plain(s["value"])).alias("entity"),
            side(s["before"], True).alias("left"), side(s["after"], False).alias("right")))

    spans = docs.select("text", F.explode(F.flatten(F.array(*map(told, KINDS)))).alias("m"))
    return spans.select("m.entity", "m.left", "m.right", _key(F.col("text")).alias("key"))


def disclosing(docs: DataFrame, threshold: float = THRESHOLD, contexts: int = CONTEXTS) -> DataFrame:
    """term, generalised (null: removed) and disclosure of each term that gives an entity of ``docs`` away."""
    texts = docs.select("text").distinct()
    total = docs.select(_key(F.col("text")).alias("key")).distinct().count()
    found = settled(mentions(docs).distinct())
    of_entity = found.groupBy("entity").agg(F.countDistinct("key").alias("n_entity"))
    near = found.select(
        "entity", "key", F.xxhash64("left", "right").alias("context"),
        F.explode(with_stems(terms(F.concat_ws(" ", "left", "right")))).alias("term"))
    together = (
        near.groupBy("entity", "term").agg(F.countDistinct("key").alias("n_both"), F.countDistinct("context").alias("contexts"))
        .where(F.col("contexts") >= contexts)
    )
    of_term = (
        texts.select(F.explode(with_stems(terms(F.col("text")))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    )
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    share = F.when(information > 0, 1 + F.log2(F.col("n_both") / F.col("n_term")) / information)
    measured = settled(
        together.join(of_term, "term").join(of_entity, "entity")
        .select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= threshold))
    plain = measured.where(~F.col("term").endswith("*")).withColumn("stem", stem(F.col("term")))
    stems = measured.where(F.col("term").endswith("*")).select("entity", F.col("term").alias("stem"), F.lit(True).alias("tells"))
    return (
        plain.join(stems, ["entity", "stem"], "left").groupBy("term", "stem")
        .agg(F.max("disclosure").alias("disclosure"), F.max(F.coalesce("tells", F.lit(False))).alias("tells"))
        .select("term", F.when(~F.col("tells"), F.col("stem")).alias("generalised"), "disclosure")
    )


_PLACED = "array<struct<kind:string,start:bigint,end:bigint,put:string>>"


def with_spans(docs: DataFrame, told: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``spans``: kind, start, end and what to put there, by kind and start.

    Texts meet the terms of ``told`` by their different terms; only texts that
    hold one are looked at for its positions.
    """
    keyed = docs.withColumn("key", _key(F.col("text")))
    held = (
        keyed.select("key", F.explode(terms(F.col("text"))).alias("term"))
        .join(told.select("term", "generalised"), "term").distinct()
        .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "generalised"))).alias("held"))
        .select(F.col("key").alias("held_key"), "held")
    )
    text = F.col("text")

    def placed(kind: str) -> Column:
        return F.transform(base_spans(kind, text), lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("put")))

    joined = keyed.join(held, F.col("key") == F.col("held_key"), "left").drop("key", "held_key")
    based = joined.withColumn("base", F.flatten(F.array(*map(placed, KINDS))))
    known = lambda word: F.map_contains_key(F.col("held"), F.lower(word))
    revealing = F.transform(
        F.filter(
            located(text, PATTERNS[TERM], known, F.col("held").isNotNull()),
            lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))),
        lambda s: F.struct(
            F.lit(TERM).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.coalesce(F.try_element_at(F.col("held"), F.lower(s["value"])), F.lit("")).alias("put")))
    return based.select("doc_id", "text", F.concat(F.col("base").cast(_PLACED), revealing.cast(_PLACED)).alias("spans"))


def sanitised(spanned: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with every span replaced; overlapping spans are one, with the first one's mark."""
    text, spans = F.col("text"), F.col("spans")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["put"].alias("put"))))

    def merge(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        grown = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"), last["put"].alias("put"))
        return F.when(
            (F.size(done) > 0) & (span["start"] < last["end"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))
        ).otherwise(F.concat(done, F.array(span)))

    apart = F.aggregate(ordered, F.array().cast("array<struct<start:bigint,end:bigint,put:string>>"), merge)

    def rebuilt(marks: Column) -> Column:
        def piece(mark: Column, i: Column) -> Column:
            before = F.coalesce(F.get(marks, i - 1)["end"], F.lit(0).cast("long"))
            return F.concat(F.substring(text, (before + 1).cast("int"), (mark["start"] - before).cast("int")), mark["put"])
        rest = F.substring(text, (F.get(marks, F.size(marks) - 1)["end"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(marks, piece), ""), rest)

    return spanned.select("doc_id", F.when(F.size(spans) == 0, text).otherwise(let(apart, rebuilt)).alias("text"))


def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = slim(table(spark, sf_dir, "documents"))
    spanned = with_spans(docs, settled(disclosing(docs)))
    told = lambda part: F.array_join(F.transform(part, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spanned.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"), number(TERM).alias("n_term"))

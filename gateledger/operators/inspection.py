"""Output checks over response chunks (request_id, chunk_idx, text).

``chunk_idx`` is dense and 0-based per response.  Running lengths and marker
tails use bounded blocks of it, so one very long response is not one task.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateledger import schema as S
from gateledger.functions import text as X
from gateledger.functions.principals import header_ci, parse_classification
from gateledger.functions.results import allow, block, quoted, say
from gateledger.operators import longmatch
from gateledger.operators.admission import ContentPattern, regex_content
from gateledger.operators.joins import asof_join
from gateledger.operators.ordered import BLOCK_ROWS, halo_blocks, running_sum

KEY = "request_id"


def char_cap(max_tokens: Column, chars_per_token: int = 4, tolerance: float = 0.10) -> Column:
    return F.floor(max_tokens * F.lit(chars_per_token) * F.lit(1 + tolerance))


def accumulated_chars(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``total_chars`` (uncapped), ``accumulated_chars`` and ``truncated``."""
    summed = running_sum(
        chunks, [KEY], "chunk_idx", F.length("text"), "total_chars", block_rows
    )
    return summed.withColumn(
        "accumulated_chars", F.least(F.col("total_chars"), F.lit(S.ACCUMULATED_TEXT_CHARS))
    ).withColumn("truncated", F.col("total_chars") > S.ACCUMULATED_TEXT_CHARS)


def scope_drift_length(max_tokens: Column, accumulated: Column) -> Column:
    cap = char_cap(max_tokens)
    return F.when(
        (max_tokens > 0) & (accumulated > cap),
        block(say("output character count ", accumulated, " exceeds scope-drift cap ", cap),
              drift_kind="token_count", accumulated_chars=accumulated, cap=cap),
    )


def marker_regex(markers: Mapping[str, int], case_sensitive: bool = False) -> str:
    """One alternation, longest marker first."""
    ordered = sorted(markers, key=len, reverse=True)
    body = "|".join(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", m) for m in ordered)
    return body if case_sensitive else f"(?i){body}"


def marker_tails(
    chunks: DataFrame, longest: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``scan_tail``: the chunk with the last ``longest-1`` characters before it.

    ``longest-1`` non-empty predecessors are enough context, whatever their
    length; empty chunks are numbered out of the way first.
    """
    need = longest - 1
    filled = chunks.withColumn("_filled", (F.length("text") > 0).cast("int"))
    placed = running_sum(filled, [KEY], "chunk_idx", F.col("_filled"), "_fpos", block_rows)
    solid = placed.where("_filled = 1").withColumn("_fpos", F.col("_fpos") - 1)
    blocks = halo_blocks(solid, "_fpos", need, max(block_rows, need))
    before = Window.partitionBy(KEY, "_block").orderBy("_fpos").rowsBetween(-need, -1)
    pieces = F.collect_list(F.right("text", F.lit(need))).over(before)
    return (
        blocks.withColumn("_before", F.right(F.array_join(pieces, ""), F.lit(need)))
        .where("not _context")
        .withColumn("scan_tail", F.concat("_before", "text"))
        .drop("_before", "_block", "_context", "_fpos", "_filled")
    )


def marker_level(
    tail: Column,
    markers: Mapping[str, int] = S.OUTPUT_MARKERS,
    first_only: bool = False,
    case_sensitive: bool = False,
) -> tuple[Column, Column]:
    """(marker, level) found in normalised text.

    All markers count and the highest decides; ``first_only`` looks at the
    first one alone, so a low marker can hide a higher one behind it.
    """
    pattern = marker_regex(markers, case_sensitive)
    fold = (lambda c: c) if case_sensitive else F.lower
    pairs: list[Column] = []
    for name, level in markers.items():
        pairs += [F.lit(name if case_sensitive else name.lower()), F.lit(level)]
    table = F.create_map(*pairs)
    if first_only:
        hit = F.nullif(F.regexp_extract(tail, pattern, 0), F.lit(""))
        return hit, F.try_element_at(table, fold(hit))
    found = F.transform(
        F.regexp_extract_all(tail, F.lit(pattern), 0),
        lambda m: F.struct(F.try_element_at(table, fold(m)).alias("level"), m.alias("marker")),
    )
    worst = F.array_max(found)
    return worst["marker"], worst["level"]


def scope_drift_marker(
    tail: Column,
    request_level: Column,
    markers: Mapping[str, int] = S.OUTPUT_MARKERS,
    first_only: bool = False,
) -> Column:
    """Block when the text carries a marker above the declared level."""
    clean = X.normalize_unicode(X.strip_zero_width(tail), "NFKC")
    marker, level = marker_level(clean, markers, first_only)
    return F.when(
        level > request_level,
        block(
            say("output marker ", quoted(marker), " implies classification level ", level,
                " > request-declared level ", request_level),
            drift_kind="classification", marker=marker, marker_level=level,
            request_level=request_level,
        ),
    )


def declared_level(headers: Column) -> Column:
    """The request's level; absent or unknown counts as 0."""
    return F.coalesce(parse_classification(header_ci(headers, "X-Classification")), F.lit(0))


def scope_drift(
    chunks: DataFrame,
    markers: Mapping[str, int] = S.OUTPUT_MARKERS,
    first_only: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``scope_drift`` per chunk; needs ``max_tokens`` and ``request_level``."""
    longest = max((len(m) for m in markers), default=1)
    sized = accumulated_chars(chunks, block_rows)
    tails = marker_tails(sized, longest, block_rows)
    empties = sized.where("text = '' or text is null").withColumn("scan_tail", F.lit(""))
    both = tails.unionByName(empties.select(tails.columns))
    outcome = F.coalesce(
        # the whole length: a cap on the kept text must not hide a long output
        scope_drift_length(F.col("max_tokens"), F.col("total_chars")),
        scope_drift_marker(F.col("scan_tail"), F.col("request_level"), markers, first_only),
        allow(),
    )
    return both.withColumn("scope_drift", outcome).drop("scan_tail")


def regex_output(
    chunks: DataFrame, patterns: Sequence[ContentPattern], overlap: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Content patterns over the response as it grows, one result per chunk.

    Each chunk is scanned with as much context as the longest match of the
    patterns needs.  Blocking patterns without a bound on their matches are
    followed by automata over the whole response (``longmatch``).  A pattern
    that allows neither (a redaction without bound, an unbounded pattern with
    look-around, or a form that only Java reads) raises ValueError unless
    ``overlap`` states how long its matches may be.  Once a chunk matches, every
    later chunk of the response reports a match as well, since the grown text
    still holds it.
    """
    bounds = [_longest(p, overlap) for p in patterns]
    # one more character, since word borders look behind a match
    context = max([overlap or 1, *[n + 1 for n in bounds if n is not None]])
    tails = marker_tails(chunks, context, block_rows) if context > 1 else chunks.where(
        F.length("text") > 0).withColumn("scan_tail", F.col("text"))
    empties = chunks.where("text = '' or text is null").withColumn("scan_tail", F.lit(""))
    own = tails.unionByName(empties.select(tails.columns))
    near = [k for k, n in enumerate(bounds) if n is not None]
    far = [k for k, n in enumerate(bounds) if n is None]
    for k in near:
        found = regex_content(F.col("scan_tail"), [patterns[k]])
        own = own.withColumn(f"_own{k}", F.when(found["decision"] != "allow", found))
    own = own.drop("scan_tail")
    if near:
        # One row per response at most: where each pattern matched first.
        firsts = own.where(F.coalesce(*[F.col(f"_own{k}") for k in near]).isNotNull()).groupBy(KEY).agg(*[
            one for k in near for one in (
                F.min(F.when(F.col(f"_own{k}").isNotNull(), F.col("chunk_idx"))).alias(f"_since{k}"),
                F.min_by(f"_own{k}", F.when(F.col(f"_own{k}").isNotNull(), F.col("chunk_idx"))).alias(f"_first{k}"))])
        own = own.join(firsts, KEY, "left")
    if far:
        since = longmatch.first_matches(chunks, [patterns[k].pattern for k in far], KEY).groupBy(KEY).agg(*[
            F.min(F.when(F.col("pattern") == at, F.col("since"))).alias(f"_since{k}") for at, k in enumerate(far)])
        own = own.join(since, KEY, "left")
    # The first registered pattern that the text so far matches decides.
    arms = []
    for k, p in enumerate(patterns):
        told = F.coalesce(f"_own{k}", f"_first{k}") if k in near else block(
            f"pattern '{p.label}' matched", pattern_label=p.label)
        arms.append(F.when(F.col(f"_since{k}") <= F.col("chunk_idx"), told))
    return own.withColumn("regex_output", F.coalesce(*arms, allow())).drop(
        *[f"{c}{k}" for k in range(len(patterns)) for c in ("_own", "_since", "_first")])


def _longest(pattern: ContentPattern, overlap: int | None) -> int | None:
    """Characters of context for a pattern; None if an automaton follows it."""
    try:
        longest = longmatch.longest_match(pattern.pattern)
        if longest is None and pattern.action == "block":
            longmatch.Automaton(pattern.pattern)
            return None
    except (re.error, ValueError) as error:
        if overlap is None:
            raise ValueError(f"state an overlap for {pattern.pattern!r}: {error}") from None
        return overlap
    if longest is None and overlap is None:
        raise ValueError(f"state an overlap to redact by {pattern.pattern!r}")
    return overlap if longest is None else longest


def continuing_consent(
    chunks: DataFrame,
    consent: DataFrame,
    every: int = 5,
    reason: str = "owner consent withdrawn during stream",
) -> DataFrame:
    """Re-check consent on chunks 1, 1+N, 1+2N, …

    ``consent``: (request_id, ts, granted).  A row without any state so far
    counts as granted.
    """
    if every < 1:
        raise ValueError("every must be >= 1")
    due = F.pmod(F.col("chunk_idx"), F.lit(every)) == 0
    seen = asof_join(chunks, consent, KEY, "ts", "ts", "granted", "chunk_idx", "granted")
    outcome = (
        F.when(~due, allow())
        .when(~F.coalesce("granted", F.lit(True)),
              block(reason, chunks_consumed=F.col("chunk_idx") + 1))
        .otherwise(allow("continuing consent verified", chunks_consumed=F.col("chunk_idx") + 1))
    )
    return seen.withColumn("continuing_consent", outcome).drop("granted")


def inspect_sibling_strings(
    strings: DataFrame, patterns: Sequence[ContentPattern] = (), request_level: Column | None = None
) -> DataFrame:
    """Run output checks over every non-delta string of an event.

    ``strings``: (event_id, value, abort).  Aborted walks (too deep, or a bad
    structural value) block; hits say the text sat in a sibling field.
    """
    level = request_level if request_level is not None else F.lit(0)
    content = regex_content(F.col("value"), patterns) if patterns else allow()
    marker = scope_drift_marker(F.col("value"), level)
    found = F.when(content["decision"] != "allow", content)
    outcome = (
        F.when(F.col("abort").isNotNull(),
               block(say("event refused: ", F.col("abort")), abort=F.col("abort")))
        .otherwise(F.coalesce(found, marker, allow()))
    )
    flagged = F.when(
        outcome["decision"] == "allow", outcome
    ).otherwise(
        F.struct(
            outcome["decision"].alias("decision"), outcome["reason"].alias("reason"),
            F.map_concat(outcome["metadata"],
                         F.create_map(F.lit("smuggled_via_sibling_field"), F.lit("true"))
                         ).alias("metadata"),
            outcome["replacement"].alias("replacement"),
        )
    )
    return strings.withColumn("sibling_inspection", flagged)


def first_abort(chunks: DataFrame, outcome: str) -> DataFrame:
    """One row per response: the first chunk whose result is not allow."""
    bad = chunks.where(F.col(outcome)["decision"] != "allow")
    return bad.groupBy(KEY).agg(
        F.min("chunk_idx").alias("abort_chunk"),
        F.min_by(F.col(outcome), "chunk_idx").alias("abort_result"),
    )


def delivered(chunks: DataFrame, outcome: str) -> DataFrame:
    """Chunks that went out before their response was aborted."""
    aborts = first_abort(chunks, outcome).select(KEY, "abort_chunk")
    return (
        chunks.join(aborts, KEY, "left")
        .where(F.col("abort_chunk").isNull() | (F.col("chunk_idx") < F.col("abort_chunk")))
        .drop("abort_chunk")
    )


def abort_metadata(chunks: DataFrame, outcome: str) -> DataFrame:
    """Delivered count, abort chunk and end-of-stream flag per response."""
    ends = chunks.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("chunk_count"), F.max("chunk_idx").alias("_last")
    )
    return ends.join(first_abort(chunks, outcome), KEY, "left").select(
        KEY,
        F.coalesce("abort_chunk", "chunk_count").alias("chunks_delivered"),
        "abort_chunk",
        (F.col("abort_chunk") == F.col("_last")).alias("at_end_of_stream"),
        F.col("abort_result.reason").alias("reason"),
    )

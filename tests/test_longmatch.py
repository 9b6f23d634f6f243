"""Patterns without a length bound over chunked text."""

import random
import re

import pytest

from gateledger.operators import inspection, longmatch
from gateledger.operators.admission import ContentPattern

PATTERNS = [r"ab+c", r"a[^.]*b[.]", r"(?i)x(y|zz)*W", r"a.*b", r"(ab|ba){2,}c", r"[^a-c]+d", r"\d+\s*\w", r"a(b?c)+?d*"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "request_id string, chunk_idx int, text string")


@pytest.mark.parametrize("pattern", PATTERNS)
def test_automaton_agrees_with_search(pattern):
    rng = random.Random(5)
    automaton = longmatch.Automaton(pattern)
    assert longmatch.longest_match(pattern) is None
    for _ in range(400):
        text = "".join(rng.choice("abcdxyzwWX.\n 1é") for _ in range(rng.randint(0, 14)))
        cut = rng.randint(0, len(text))
        state = automaton.walk(automaton.walk([0], text[:cut]), text[cut:])[0]
        assert (state == automaton.final) == (re.search(pattern, text, re.ASCII) is not None), text


def test_first_chunks_equal_scans_of_the_grown_text(spark):
    rng = random.Random(9)
    patterns = [r"ab[^.]*ba", r"c{3,}", r"a[bc]*a[bc]*a\."]
    rows, want = [], {}
    for key in ("hot", "k1", "k2", "k3", None):
        grown = ""
        for at in range(240 if key == "hot" else rng.randint(1, 9)):
            text = rng.choice(["", None, *["".join(rng.choice("abc.") for _ in range(rng.randint(1, 3))) for _ in range(3)]])
            rows.append((key, at, text))
            grown += text or ""
            for k, p in enumerate(patterns):
                if re.search(p, grown):
                    want.setdefault((key, k), at)
    for parts in (1, 7, 40):
        found = longmatch.first_matches(frame(spark, rows), patterns, parts=parts).collect()
        assert {(r.request_id, r.pattern): r.since for r in found} == want
        assert len(found) == len(want)
    assert longmatch.first_matches(frame(spark, []), patterns).count() == 0


def test_match_over_five_chunks_and_thousands_of_characters(spark):
    rows = [("r", 0, "start se"), ("r", 1, "cret" + "x" * 900), ("r", 2, ""), ("r", 3, "y" * 1200),
            ("r", 4, "z" * 10 + "en"), ("r", 5, "d tail"), ("r", 6, None), ("s", 0, "secret, "), ("s", 1, "nothing")]
    found = inspection.regex_output(frame(spark, rows), [
        ContentPattern(r"secret[a-z]*end", "block", label="far"), ContentPattern(r"\bnothing\b", "redact", label="near")])
    got = {(r.request_id, r.chunk_idx): r.regex_output.decision for r in found.collect()}
    assert got == {("r", 0): "allow", ("r", 1): "allow", ("r", 2): "allow", ("r", 3): "allow", ("r", 4): "allow",
                   ("r", 5): "block", ("r", 6): "block", ("s", 0): "allow", ("s", 1): "redact"}


def test_patterns_without_bound_are_refused_when_nothing_can_follow_them(spark):
    chunks = frame(spark, [("r", 0, "aaaa")])
    for pattern in (ContentPattern(r"a+(?=b)"), ContentPattern(r"(a)\1+"), ContentPattern(r"a+", "redact"),
                    ContentPattern(r"\p{Alpha}")):
        with pytest.raises(ValueError, match="overlap"):
            inspection.regex_output(chunks, [pattern])
    found = inspection.regex_output(chunks, [ContentPattern(r"a+", "redact")], overlap=64).collect()
    assert found[0].regex_output.decision == "redact"
    with pytest.raises(ValueError, match="states"):
        longmatch.Automaton(r"a.{12}b+", max_states=64)


def test_empty_match_and_no_patterns(spark):
    chunks = frame(spark, [("r", 0, None), ("r", 1, "b")])
    assert [r.since for r in longmatch.first_matches(chunks, ["a*"]).collect()] == [0]
    assert {r.regex_output.decision for r in inspection.regex_output(chunks, []).collect()} == {"allow"}

"""Text clean-up: native expressions first, Arrow batches for Unicode forms.

Every Python-backed function is fed null for rows it cannot change (pure ASCII
text), so those rows cost one null slot in the Arrow batch and no Python work.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Zero-width, bidi-formatting and soft-hyphen code points.
ZERO_WIDTH = (
    "​‌‍⁠﻿᠎"
    "‪‫‬‭‮⁦⁧⁨⁩­"
)

# Look-alike letter → Latin letter.
CONFUSABLES = {
    # Cyrillic
    "а": "a", "А": "A", "е": "e", "Е": "E", "о": "o", "О": "O", "р": "p", "Р": "P",
    "с": "c", "С": "C", "у": "y", "У": "Y", "х": "x", "Х": "X", "і": "i", "І": "I",
    "ј": "j", "Ј": "J", "ѕ": "s", "Ѕ": "S", "ԁ": "d", "г": "g",
    # Greek
    "α": "a", "Α": "A", "β": "B", "ε": "e", "Ε": "E", "ι": "i", "Ι": "I", "κ": "k",
    "Κ": "K", "ο": "o", "Ο": "O", "ρ": "r", "Ρ": "P", "τ": "t", "Τ": "T", "υ": "u",
    "Υ": "Y", "χ": "x", "Χ": "X", "ν": "n", "Ν": "N", "μ": "u",
    # Cherokee
    "Ꭺ": "A", "Ꭼ": "E", "Ꮃ": "W", "Ꮟ": "i", "Ꮯ": "C", "Ꮶ": "K", "Ꮤ": "W",
    # Phonetic, Armenian, Coptic and small capitals
    "ɡ": "g", "ɢ": "G", "օ": "o", "ⲟ": "o", "є": "e", "ɪ": "i", "ɴ": "n", "ʀ": "r",
    "ɛ": "e", "ɷ": "o", "ɩ": "i", "ӏ": "I", "℩": "i", "ռ": "n", "ɳ": "n", "ŋ": "n",
    "ᴎ": "N", "п": "n", "ʊ": "u", "ᴜ": "u", "ս": "u", "ᴛ": "T", "т": "t", "Т": "T",
    "ϲ": "c", "ς": "c", "ᴄ": "C", "ⅽ": "c",
    # Digits that look like o
    "೦": "o", "൦": "o", "߀": "o", "௦": "o", "०": "o",
    # More letters
    "ɼ": "r", "ɽ": "r", "ᴦ": "r", "ɑ": "a", "ᴀ": "A", "ɗ": "d", "ᴅ": "D", "ҽ": "e",
    "ɘ": "e", "ᴇ": "E", "ǵ": "g", "ԍ": "g", "ʟ": "L", "ⅼ": "l", "ǀ": "l", "ᴋ": "K",
    "к": "k", "К": "K", "ᴍ": "M", "м": "m", "М": "M", "ᴘ": "P", "ᴠ": "V", "ѵ": "v",
    "Γ": "U", "Λ": "A", "Δ": "A", "Θ": "O", "Φ": "O", "Ω": "O", "Ψ": "Y", "Ξ": "E",
    "Σ": "E", "γ": "g", "δ": "d", "θ": "o", "λ": "a", "ξ": "e", "σ": "o", "φ": "o",
    "ψ": "y", "ω": "o",
}

# Second reading of an ambiguous letter.
CONFUSABLES_ALTERNATE = {"ρ": "p"}

# Letters spread out with single blanks, six or more of them.
STRETCHED = r"\b(?:[A-Za-z]\s){5,}[A-Za-z]\b"

# Characters escaped before display: C0 (but tab), DEL, C1, line and paragraph
# separators, bidi overrides and isolates, BOM.
CONTROL_CLASS = (
    r"[\x00-\x08\x0a-\x1f\x7f\x{80}-\x{9f}"
    r"\x{2028}\x{2029}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]"
)

# ---------------------------------------------------------------------------

_CONFUSABLE_TABLE = str.maketrans(CONFUSABLES)
_CONFUSABLE_RE = re.compile(f"[{''.join(CONFUSABLES)}]")
_ZERO_WIDTH_RE = re.compile(f"[{ZERO_WIDTH}]")
_STRETCHED_RE = re.compile(STRETCHED)
_MARKS_RE = regex.compile(r"\p{M}+")


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def strip_space(text: Column) -> Column:
    """Trim every Unicode blank at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def fold_confusables(text: Column) -> Column:
    return F.translate(text, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))


def strip_markdown_split(text: Column) -> Column:
    return F.translate(text, "*_~\\", "")


def strip_combining_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{M}", "")


def control_char_clean(text: Column) -> Column:
    """Show control and bidi characters as ``\\xNN`` / ``\\uNNNN``."""

    def show(ch: Column) -> Column:
        code = F.lower(F.hex(F.ascii(ch)))
        narrow = F.concat(F.lit("\\x"), F.lpad(code, 2, "0"))
        wide = F.concat(F.lit("\\u"), F.lpad(code, 4, "0"))
        escaped = F.when(F.ascii(ch) < 128, narrow).otherwise(wide)
        return F.when(ch.rlike(CONTROL_CLASS), escaped).otherwise(ch)

    cleaned = F.array_join(F.transform(F.split(text, ""), show), "")
    return F.when(text.rlike(CONTROL_CLASS), cleaned).otherwise(text)


def normalize_unicode(text: Column, form: str = "NFKC") -> Column:
    """Unicode normal form; ASCII rows skip Python."""

    @F.pandas_udf(T.StringType())
    def apply_form(values: pd.Series) -> pd.Series:
        return values.map(lambda s: unicodedata.normalize(form, s), na_action="ignore")

    return F.coalesce(apply_form(F.when(~is_ascii(text), text)), text)


def scan_form(text: str) -> str:
    """Decompose, drop hidden characters and marks, compose, fold, re-join."""
    if not text.isascii():
        text = _ZERO_WIDTH_RE.sub("", unicodedata.normalize("NFKD", text))
        text = unicodedata.normalize("NFKC", _MARKS_RE.sub("", text))
        if _CONFUSABLE_RE.search(text):
            text = text.translate(_CONFUSABLE_TABLE)
    return _STRETCHED_RE.sub(lambda run: run[0].replace(" ", ""), text)


@F.pandas_udf(T.StringType())
def _scan_form_udf(values: pd.Series) -> pd.Series:
    return values.map(scan_form, na_action="ignore")


def normalize_for_scan(text: Column) -> Column:
    """The composed scan form; plain ASCII without stretched words is itself."""
    changes = ~is_ascii(text) | text.rlike(STRETCHED)
    return F.coalesce(_scan_form_udf(F.when(changes, text)), text)


def normalize_alternate(normalized: Column) -> Column:
    """The second folding of letters with two Latin readings."""
    return F.translate(
        normalized,
        "".join(CONFUSABLES_ALTERNATE),
        "".join(CONFUSABLES_ALTERNATE.values()),
    )


def cap_text(text: Column, chars: int) -> Column:
    return F.left(text, F.lit(chars))

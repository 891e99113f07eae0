"""Text columns: normalising, terms, n-grams, coverage, headlines."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))


def normalize_text(text: Column, nfkc: bool = False) -> Column:
    """Lower case, katakana as hiragana, one space for each run of other than letters and digits.

    ``nfkc`` first applies that Unicode normal form; ASCII texts skip the
    Python worker's work but not the trip to it, so it is off by default.
    """
    source = F.coalesce(text, F.lit(""))
    if nfkc:

        @F.pandas_udf("string")
        def folded(s: pd.Series) -> pd.Series:
            return s.map(lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x))

        source = folded(source)
    return F.trim(F.regexp_replace(F.translate(F.lower(source), _KATAKANA, _HIRAGANA), r"[^\p{L}\p{N}]+", " "))


def normalize(text: str) -> str:
    """:func:`normalize_text` of one string, with NFKC."""
    low = unicodedata.normalize("NFKC", text or "").lower().translate(str.maketrans(_KATAKANA, _HIRAGANA))
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in low).split())


def terms(normalized: Column) -> Column:
    """Space-separated terms; none of an empty text."""
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def is_content_term(term: str) -> bool:
    """Short terms of hiragana only carry no content."""
    return not (len(term) <= 2 and re.fullmatch("[ぁ-ゖ]+", term))


def content_terms(terms_col: Column) -> Column:
    return F.filter(terms_col, lambda x: ~((F.length(x) <= 2) & x.rlike("^[ぁ-ゖ]+$")))


def weight(term: str) -> int:
    """1 for a printable ASCII character, else 2."""
    return sum(1 if ord(c) <= 0x7E else 2 for c in term)


def grams_of(token: str) -> list[str]:
    """3-grams of a Latin token (itself if shorter), 2- and 3-grams of another."""
    if re.fullmatch(r"[\x21-\x7e]+", token):
        return [token] if len(token) < 3 else [token[i : i + 3] for i in range(len(token) - 2)]
    return [token[i : i + n] for n in (2, 3) for i in range(len(token) - n + 1)]


def token_trigrams(terms_col: Column) -> Column:
    """Distinct 3-grams of Latin terms; shorter ones count as themselves."""

    def grams(x: Column) -> Column:
        return F.when(F.length(x) >= 3, F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3)))).otherwise(F.array(x))

    return F.array_distinct(F.flatten(F.transform(terms_col, grams)))


def truncate(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last an ellipsis if any were cut."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 1), F.lit("…")))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def contains_token(line: Column, token: Column) -> Column:
    """``token`` stands in ``line`` without an identifier character beside it."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), token, F.lit(r"\E(?![A-Za-z0-9_$])"))
    return F.contains(line, token) & F.rlike(line, quoted)


def slug(text: Column, size: int = 80) -> Column:
    """A file-name form: other than letters, digits, dot, underscore and hyphen become one hyphen."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}._-]+", "-")
    return F.substring(F.regexp_replace(clean, "^-+|-+$", ""), 1, size)

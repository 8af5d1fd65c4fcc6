"""Whitespace, tokens and text shaping as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace as str.split and str.strip see it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NON_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
# A word character as \w sees it, spelled out so that it does not depend on the JDK.
WORD_CHAR = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """Remove every kind of whitespace at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~F.regexp_like(text, F.lit(NON_SPACE))


def has_text(text: Column) -> Column:
    """Present and not blank."""
    return ~is_blank(text)


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    return F.regexp_extract_all(text, F.lit(f"{NON_SPACE}+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def estimate_tokens(n_words: Column) -> Column:
    """Token estimate: 1.3 tokens per word, truncated."""
    return (n_words * F.lit(1.3)).cast("int")


# Analyzers: text column -> array of terms.
def letter_terms(text: Column) -> Column:
    """Runs of letters, lower-cased: the default index analyzer."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def word_terms(text: Column) -> Column:
    r"""Runs of ``\w``, lower-cased: the analyzer of the answer metrics."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD_CHAR}+"), F.lit(0))


def treebank_terms(text: Column) -> Column:
    """Lower-cased words with punctuation as terms of its own and English
    contractions split (``don't`` -> ``do n't``); hyphenated words stay whole."""
    low = F.lower(text)
    low = F.regexp_replace(low, r"n['’]t\b", " n't")
    low = F.regexp_replace(low, r"['’](s|m|d|ll|re|ve)\b", " '$1")
    pattern = (
        r"n't|'(?:s|m|d|ll|re|ve)\b"
        rf"|{WORD_CHAR}+(?:[-./,]{WORD_CHAR}+)*"
        r"|\.{3}|[^\s\p{L}\p{N}_]"
    )
    return F.regexp_extract_all(low, F.lit(pattern), F.lit(0))


ANALYZERS = {"letters": letter_terms, "words": word_terms, "treebank": treebank_terms}


def clean_lines(text: Column) -> Column:
    """Strip every line, drop leading blank lines and keep one blank line of a run.

    A trailing blank line survives as a trailing newline.
    """
    lines = F.transform(F.split(text, "\n"), strip)
    joined = F.array_join(lines, "\n")
    joined = F.regexp_replace(joined, r"\n{3,}", "\n\n")
    joined = F.regexp_replace(joined, r"\A\n+", "")
    return F.regexp_replace(joined, r"\n\n\z", "\n")


def truncate(text: Column, limit: int, suffix: str = "...", trim_end: bool = False) -> Column:
    """First ``limit`` characters plus ``suffix`` for longer text, for display."""
    head = F.substring(text, 1, limit)
    if trim_end:
        head = rstrip(head)
    return F.when(F.length(text) > limit, F.concat(head, F.lit(suffix))).otherwise(text)


def like_pattern(needle: str) -> str:
    """``%needle%`` where ``%`` and ``_`` of the needle stay wildcards and a
    backslash is an ordinary character."""
    return "%" + needle.replace("\\", "\\\\") + "%"


def contains_like(column: Column, needle: str) -> Column:
    return column.ilike(like_pattern(needle))

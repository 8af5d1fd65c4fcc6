"""Finding the names of a lexicon in texts, as whole words, ignoring case.

A lexicon of bounded size becomes one regular expression, and the whole
extraction is a projection without a shuffle.  A larger one becomes an automaton over
words, one of any size is joined with the word sequences of the texts.  All give the
same rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import WORD_CHAR
from quire.operators.automaton import extract_by_automaton
from quire.operators.lexicon import default_lexicon
from quire.session import is_small, spread

MAX_PATTERN_NAMES = 5_000
ENTRY_TYPE = "array<struct<ord:int,entity_type:string,name:string>>"

_INNER = re.compile(r"[^\W]", re.UNICODE)


def _quote(char: str) -> str:
    return char if char.isalnum() or char == " " else "\\" + char if char.isascii() and char != "_" else char


def _alternatives(names: set[str]) -> str:
    """Expression for the longest of ``names``: common beginnings are shared, so a
    position of the text is ruled out by its first character."""
    rest: dict[str, set[str]] = {}
    for name in names:
        if name:
            rest.setdefault(name[0], set()).add(name[1:])
    branches = [_quote(first) + _alternatives(tails) for first, tails in sorted(rest.items())]
    if not branches:
        return ""
    group = branches[0] if len(branches) == 1 and "" not in names else f"(?:{'|'.join(branches)})"
    return group + ("?" if "" in names else "")


def _is_word(char: str) -> bool:
    return bool(_INNER.match(char))


def _check(name: str) -> None:
    if not name or not _is_word(name[0]) or not _is_word(name[-1]):
        raise ValueError(f"a name must begin and end with a letter, digit or underscore: {name!r}")


def find_entities(text: Column, lexicon: list[tuple[str, str]] | None = None) -> Column:
    """Array of (ord, entity_type, name) found in ``text``, in lexicon order."""
    entries = default_lexicon() if lexicon is None else lexicon
    if len(entries) > MAX_PATTERN_NAMES:
        raise ValueError("lexicon too large for a pattern, use extract or join_lexicon")
    by_name: dict[str, list[dict]] = {}
    for number, (kind, name) in enumerate(entries):
        _check(name)
        by_name.setdefault(name.lower(), []).append({"ord": number, "entity_type": kind, "name": name})
    if not by_name:
        return F.array().cast(ENTRY_TYPE)

    # The pattern reports the longest name at a position.  Shorter names that
    # begin there too are its beginnings that end at a word boundary.
    found_with: dict[str, list[dict]] = {}
    for longest in by_name:
        ends = [n for n in range(1, len(longest) + 1) if n == len(longest) or not _is_word(longest[n])]
        found_with[longest] = [entry for n in ends for entry in by_name.get(longest[:n], [])]
    pattern = f"(?<!{WORD_CHAR})(?=({_alternatives(set(by_name))})(?!{WORD_CHAR}))"
    matched = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))
    meaning = F.from_json(F.lit(json.dumps(found_with)), f"map<string,{ENTRY_TYPE}>")
    found = F.flatten(F.transform(matched, lambda m: meaning[m]))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast(ENTRY_TYPE))))


def extract(papers: DataFrame, text: Column, lexicon: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(paper_id, ord, entity_type, name) of papers with ``id``.

    A lexicon may be of any size: a frame (entity_type, name, ord), or a list beyond
    what a pattern holds, becomes an automaton over words, and beyond what tasks can
    hold one after the other it is joined, with the same rows.
    """
    if isinstance(lexicon, DataFrame):
        found = extract_by_automaton(papers, text, lexicon)
        return join_lexicon(papers, text, lexicon) if found is None else found
    if lexicon is not None and len(lexicon) > MAX_PATTERN_NAMES:
        for _, name in lexicon:
            _check(name)
        rows = [(kind, name, number) for number, (kind, name) in enumerate(lexicon)]
        frame = papers.sparkSession.createDataFrame(rows, "entity_type string, name string, ord int")
        return extract(papers, text, frame)
    texts = spread(papers.select(F.col("id").alias("paper_id"), text.alias("text")))
    found = F.explode(find_entities(F.col("text"), lexicon)).alias("e")
    return texts.select("paper_id", found).select("paper_id", "e.ord", "e.entity_type", "e.name")


def join_lexicon(papers: DataFrame, text: Column, lexicon: DataFrame) -> DataFrame:
    """The same for a lexicon frame (entity_type, name, ord) of any size.

    Texts become alternating words and gaps, so a name matches when it equals a
    run that starts and ends with a word.  Runs are made distinct inside each row,
    and meet the lexicon by an equi-join.
    """
    run = f"{WORD_CHAR}+|[^\\p{{L}}\\p{{N}}_]+"
    names = lexicon.withColumn("key", F.lower("name"))
    parts_of_key = F.size(F.regexp_extract_all(F.col("key"), F.lit(run), F.lit(0)))
    lengths = sorted(r[0] for r in names.select(parts_of_key).distinct().collect())
    parts = F.regexp_extract_all(F.lower("text"), F.lit(run), F.lit(0))

    def runs_of(tokens: Column, length: int) -> Column:
        if length == 1:
            return tokens
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - length + 1))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, length), ""))

    def runs(tokens: Column) -> Column:
        return F.array_distinct(F.flatten(F.array(*[runs_of(tokens, n) for n in lengths])))

    texts = spread(papers.select(F.col("id").alias("paper_id"), text.alias("text")))
    exploded = texts.select("paper_id", F.explode(F.flatten(F.transform(F.array(parts), runs))).alias("key"))
    if is_small(names):
        names = F.broadcast(names)
    found = exploded.join(names, "key").groupBy("paper_id", "entity_type", "key")
    first = found.agg(F.min(F.struct("ord", "name")).alias("first"))
    return first.select("paper_id", "first.ord", "entity_type", "first.name")


def exclusive_topics(lexicon: DataFrame) -> DataFrame:
    """Lexicon (entity_type, name, ord) without topics that another type names too, ignoring case."""
    key = F.lower("name").alias("key")
    others = lexicon.filter(F.col("entity_type") != "topic").select(key, F.lit("topic").alias("entity_type"))
    return lexicon.withColumn("key", F.lower("name")).join(others, ["entity_type", "key"], "left_anti").drop("key")

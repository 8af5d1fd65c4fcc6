"""Paper identifiers, venues, volumes and author fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import strip

# First letter of a legacy id -> venue.
LEGACY_VENUE_LETTERS = {
    "P": "acl",
    "D": "emnlp",
    "N": "naacl",
    "C": "coling",
    "E": "eacl",
    "Q": "tacl",
    "J": "cl",
    "W": "workshop",
    "S": "semeval",
}

# Venue -> phrases of a book title, tried in this order.
BOOKTITLE_PHRASES = {
    "acl": ["acl", "annual meeting of the association for computational linguistics"],
    "emnlp": ["emnlp", "empirical methods in natural language processing"],
    "naacl": ["naacl", "north american chapter"],
    "coling": ["coling", "international conference on computational linguistics"],
    "eacl": ["eacl", "european chapter"],
    "findings": ["findings"],
    "tacl": ["tacl", "transactions of the association"],
    "cl": ["computational linguistics"],
}

# Venue ids that name a venue by themselves.
KNOWN_VENUE_IDS = ["acl", "emnlp", "naacl", "coling", "eacl", "findings", "tacl", "cl", "semeval", "conll"]


def paper_id(source: Column, source_id: Column) -> Column:
    return F.concat(source, F.lit("::"), source_id)


def paper_source(pid: Column) -> Column:
    """First ``::`` part, or ``unknown`` when the id has no separator."""
    return F.when(pid.contains("::"), F.substring_index(pid, "::", 1)).otherwise(F.lit("unknown"))


def paper_source_id(pid: Column) -> Column:
    """Last ``::`` part."""
    return F.substring_index(pid, "::", -1)


def fallback_chunk_id(chunk_id: Column, pid: Column, index: Column) -> Column:
    """The chunk's own id as text, or one built from paper and position."""
    return F.coalesce(chunk_id.cast("string"), F.concat(pid, F.lit("_chunk_"), index.cast("string")))


def parse_chunk_id(raw: Column) -> Column:
    """Numeric id, or null when the text is no number."""
    return raw.try_cast("bigint")


def venue_from_booktitle(booktitle: Column, whole_words: bool = False) -> Column:
    """First venue whose phrase occurs in the title.

    Plain containment lets "naacl" resolve to acl; ``whole_words`` avoids that.
    """
    low = F.lower(booktitle)
    result = F.lit(None).cast("string")
    for venue, phrases in reversed(BOOKTITLE_PHRASES.items()):
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | (F.regexp_like(low, F.lit(rf"\b{phrase}\b")) if whole_words else low.contains(phrase))
        result = F.when(hit, F.lit(venue)).otherwise(result)
    return result


def venue_from_id(acl_id: Column, booktitle: Column | None = None) -> Column:
    """Venue by legacy letter, else by the dotted id's second part, else by title."""
    letters = F.create_map(*[F.lit(x) for pair in LEGACY_VENUE_LETTERS.items() for x in pair])
    legacy = F.try_element_at(letters, F.upper(F.substring(acl_id, 1, 1)))
    dotted = F.when(
        acl_id.contains("."),
        F.lower(F.substring_index(F.split(acl_id, "[.]")[1], "-", 1)),
    )
    title = venue_from_booktitle(booktitle) if booktitle is not None else F.lit(None).cast("string")
    return F.coalesce(legacy, dotted, title)


def volume_from_id(acl_id: Column) -> Column:
    """Text after the first hyphen of the dotted id's second part."""
    part = F.when(acl_id.contains("."), F.split(acl_id, "[.]")[1])
    return F.when(part.contains("-"), F.regexp_extract(part, "^[^-]*-(.*)$", 1))


def venue_from_ids(venue_ids: Column) -> Column:
    """First known venue id, else the first id, lower-cased."""
    low = F.transform(venue_ids, F.lower)
    known = F.filter(low, lambda v: v.isin(KNOWN_VENUE_IDS))
    return F.coalesce(F.get(known, F.lit(0)), F.get(low, F.lit(0)))


def _non_empty(names: Column) -> Column:
    return F.filter(F.transform(names, strip), lambda n: n != "")


def authors_from_text(field: Column) -> Column:
    """Split on " and " when it occurs, else on commas; null gives an empty list."""
    parts = F.when(field.contains(" and "), F.split(field, " and ")).otherwise(F.split(field, ","))
    return F.coalesce(_non_empty(parts), F.array().cast("array<string>"))


def authors_from_structs(field: Column) -> Column:
    """List of {first, last} -> list of full names, without empty ones."""
    names = F.transform(
        field,
        lambda a: F.concat(F.coalesce(a["first"], F.lit("")), F.lit(" "), F.coalesce(a["last"], F.lit(""))),
    )
    return F.coalesce(_non_empty(names), F.array().cast("array<string>"))


def authors_from_list(field: Column) -> Column:
    # Entries that are null are no names.
    return F.coalesce(F.array_compact(F.transform(field, strip)), F.array().cast("array<string>"))


def safe_file_name(pid: Column) -> Column:
    return F.replace(F.replace(pid, F.lit("::"), F.lit("_")), F.lit("/"), F.lit("_"))


def question_number(qid: Column) -> Column:
    """Number of a ``qNNN`` id, null for any other id."""
    return F.when(qid.startswith("q"), F.substr(qid, F.lit(2)).try_cast("bigint"))

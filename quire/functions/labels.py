"""Display forms of counts and venues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Venue -> display label.
VENUE_LABELS = {
    "acl": "ACL",
    "emnlp": "EMNLP",
    "naacl": "NAACL",
    "findings-acl": "Findings of ACL",
    "findings-emnlp": "Findings of EMNLP",
    "findings-naacl": "Findings of NAACL",
    "coling": "COLING",
    "eacl": "EACL",
    "tacl": "TACL",
    "cl": "CL",
    "semeval": "SemEval",
    "conll": "CoNLL",
    "workshop": "Workshop",
}


def count_label(n: Column) -> Column:
    """1234 -> 1.2K, 1234567 -> 1.2M."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / F.lit(1e6)))
        .when(n >= 1_000, F.format_string("%.1fK", n / F.lit(1e3)))
        .otherwise(n.cast("string"))
    )


def venue_label(venue: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in VENUE_LABELS.items() for x in pair])
    known = F.coalesce(F.try_element_at(labels, F.lower(venue)), F.upper(venue))
    return F.when(venue.isNull() | (venue == ""), F.lit("Unknown")).otherwise(known)


def split_composite_venue(venue: Column) -> tuple[Column, Column]:
    """``findings-x`` -> (``findings``, ``x``); any other venue -> (venue, null)."""
    composite = venue.startswith("findings-")
    base = F.when(composite, F.lit("findings")).otherwise(venue)
    return base, F.when(composite, F.regexp_replace(venue, "^findings-", ""))

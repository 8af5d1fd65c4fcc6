"""Splitting papers into chunks.

Each strategy is one array expression per paper, so chunking is a narrow
projection: no shuffle, whole texts, any number of papers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import NON_SPACE, estimate_tokens, has_text, is_blank, strip, word_count, words
from quire.session import spread

WORDS_PER_TOKEN = 1.3
CHUNK_TYPE = "array<struct<chunk_text:string,chunk_type:string>>"

# Section headings that open a chunk, alone on a line and
# optionally numbered.
HEADINGS = [
    r"introduction",
    r"related\s+work",
    r"background",
    r"method(?:ology|s)?",
    r"approach",
    r"model",
    r"experiment(?:s|al\s+setup)?",
    r"result(?:s)?(?:\s+and\s+discussion)?",
    r"discussion",
    r"analysis",
    r"conclusion(?:s)?",
    r"abstract",
]

# Keywords that name the chunk type, tried in this order.
SECTION_TYPES = [
    "introduction",
    "method",
    "approach",
    "model",
    "experiment",
    "result",
    "discussion",
    "analysis",
    "conclusion",
    "related work",
    "background",
    "abstract",
]

HEADING = r"(?iuU)(?:\A|\n)(?:\d+\.?\s*)?(?:" + "|".join(HEADINGS) + r")\s*\n"


def _empty() -> Column:
    return F.array().cast(CHUNK_TYPE)


def _piece(text: Column, kind: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(text.alias("chunk_text"), kind.alias("chunk_type"))


def abstract_chunks(abstract: Column, full_text: Column) -> Column:
    """The abstract as one chunk."""
    return F.when(has_text(abstract), F.array(_piece(strip(abstract), "abstract"))).otherwise(_empty())


def fixed_chunks(abstract: Column, full_text: Column, chunk_size: int = 512, overlap: int = 50) -> Column:
    """Windows of ``chunk_size`` tokens that share ``overlap`` tokens, over the
    full text or else the abstract."""
    size, shared = int(chunk_size / WORDS_PER_TOKEN), int(overlap / WORDS_PER_TOKEN)
    if shared >= size:
        raise ValueError("overlap must be smaller than chunk_size")
    text = F.when(has_text(full_text), full_text).otherwise(F.coalesce(abstract, F.lit("")))

    def windows(tokens: Column) -> Column:
        # The last window is the first one that reaches the end.
        last = F.greatest(F.lit(0), F.size(tokens) - shared - 1)
        starts = F.sequence(F.lit(0), last, F.lit(size - shared))
        return F.transform(
            starts, lambda s: _piece(F.array_join(F.slice(tokens, s + 1, size), " "), "full_text")
        )

    # Binding the words as a lambda variable computes them once, not once per window.
    whole = F.flatten(F.transform(F.array(words(text)), windows))
    return F.when(is_blank(text), _empty()).otherwise(whole)


def section_chunks(abstract: Column, full_text: Column, min_words: int = 50) -> Column:
    """One chunk per section of at least ``min_words`` words.

    Papers without full text, or whose sections are all too short, give their
    abstract; full texts without headings give fixed windows.
    """
    # \u0001 marks section starts; \u0001 characters of the text are escaped, so no
    # text can fake a mark.
    escaped = F.regexp_replace(full_text, "\u0001", "\u0001\u0002")
    marked = F.regexp_replace(escaped, f"({HEADING})", "\u0001\u0003$1")
    parts = F.transform(F.split(marked, "\u0001\u0003"), lambda p: F.regexp_replace(p, "\u0001\u0002", "\u0001"))

    def section_type(part: Column) -> Column:
        heading = F.lower(strip(F.regexp_extract(part, HEADING, 0)))
        kind = F.lit("section")
        for name in reversed(SECTION_TYPES):
            kind = F.when(heading.contains(name), F.lit(name.replace(" ", "_"))).otherwise(kind)
        return kind

    def build(pieces: Column) -> Column:
        typed = F.transform(
            pieces,
            lambda p, i: _piece(strip(p), F.when(i == 0, F.lit("preamble")).otherwise(section_type(p))),
        )
        kept = F.filter(
            typed,
            lambda p: (word_count(p["chunk_text"]) >= min_words)
            & ((p["chunk_type"] != "preamble") | (F.length(p["chunk_text"]) > 0)),
        )
        return (
            F.when(F.size(pieces) == 1, fixed_chunks(abstract, full_text))
            .when(F.size(kept) == 0, abstract_chunks(abstract, full_text))
            .otherwise(kept)
        )

    sections = F.flatten(F.transform(F.array(parts), build))
    return F.when(has_text(full_text), sections).otherwise(abstract_chunks(abstract, full_text))


STRATEGIES: dict[str, Callable[..., Column]] = {
    "abstract": abstract_chunks,
    "fixed": fixed_chunks,
    "section": section_chunks,
}


def chunk_papers(papers: DataFrame, strategy: str = "abstract", **options: int) -> DataFrame:
    """(paper_id, chunk_index, chunk_text, chunk_type, token_count) of all papers."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, use one of {sorted(STRATEGIES)}")
    pieces = STRATEGIES[strategy](F.col("abstract"), F.col("full_text"), **options)
    return (
        spread(papers.select("id", "abstract", "full_text"))
        .select(F.col("id").alias("paper_id"), F.posexplode(pieces).alias("chunk_index", "piece"))
        .select("paper_id", "chunk_index", "piece.chunk_text", "piece.chunk_type")
        .withColumn("token_count", estimate_tokens(word_count(F.col("chunk_text"))))
    )


def stable_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Numeric ids that a chunk keeps for as long as its paper, place and text stay the same.

    60 bits of a digest of the three; another text at the place gets another id, so
    whatever was derived from the old chunk is never taken for the new one.
    """
    digest = F.md5(F.concat_ws("\u0001", "paper_id", F.col("chunk_index").cast("string"), "chunk_text"))
    return chunks.select(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("id"), *chunks.columns)


def number_chunks(chunks: DataFrame, buckets: int = 65_536) -> DataFrame:
    """Dense numeric ids that depend on the data alone, not on its partitioning.

    Papers are spread over hash buckets, rows are numbered inside each bucket in
    parallel, and each bucket starts where the one before it ends.
    """
    keyed = chunks.withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(buckets)))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("bucket", F.coalesce(before, F.lit(0)).alias("start"))
    in_bucket = F.row_number().over(Window.partitionBy("bucket").orderBy("paper_id", "chunk_index"))
    # At most ``buckets`` rows are broadcast.
    return (
        keyed.withColumn("n", in_bucket)
        .join(F.broadcast(starts), "bucket")
        .withColumn("id", F.col("start") + F.col("n"))
        .select("id", *chunks.columns)
    )

"""Counts, rankings and trends over papers and their entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import contains_like
from quire.model import ENTITY_KINDS, entities_of


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def papers_per_venue(papers: DataFrame) -> DataFrame:
    return (
        papers.filter(F.col("venue").isNotNull())
        .groupBy("venue")
        .agg(F.count("*").alias("paper_count"))
        .orderBy(F.desc("paper_count"), "venue")
    )


def papers_per_venue_year(papers: DataFrame) -> DataFrame:
    """Counts by venue and year; missing values form groups of their own."""
    return papers.groupBy("venue", "year").agg(F.count("*").alias("paper_count")).orderBy("year", "venue")


def year_over_year_growth(papers: DataFrame) -> DataFrame:
    """Papers per year, the year before and the growth in percent.

    The window has no partition, but it runs on one row per year.
    """
    per_year = papers.groupBy("year").agg(F.count("*").alias("paper_count"))
    prev = F.lag("paper_count").over(Window.orderBy("year"))
    growth = F.round(F.lit(100.0) * (F.col("paper_count") - F.col("prev_count")) / F.col("prev_count"), 1)
    return (
        per_year.withColumn("prev_count", prev)
        .withColumn("growth_pct", F.when(F.col("prev_count") > 0, growth))
        .orderBy("year")
    )


def _with_year(entities: DataFrame, papers: DataFrame) -> DataFrame:
    years = papers.select(F.col("id").alias("paper_id"), "year")
    return entities.join(years, "paper_id")


def top_entities_by_year(entities: DataFrame, papers: DataFrame, kind: str, top_n: int = 10) -> DataFrame:
    """Most frequent names of each year; equal counts share a rank, so a year can
    have more than ``top_n`` rows."""
    counts = (
        _with_year(entities_of(entities, kind).select("paper_id", "name"), papers)
        .groupBy("name", "year")
        .agg(F.count("*").alias("count"))
    )
    rank = F.rank().over(Window.partitionBy("year").orderBy(F.desc("count")))
    return (
        counts.withColumn("rank", rank)
        .filter(F.col("rank") <= top_n)
        .withColumn("rank", F.col("rank").cast("long"))
        .orderBy("year", "rank", "name")
    )


def latest_year(ranked: DataFrame) -> DataFrame:
    """Rows of the newest year of a per-year ranking."""
    return ranked.filter(F.col("year") == ranked.select(F.max("year")).scalar())


def sum_by_name(ranked: DataFrame, limit: int = 10) -> DataFrame:
    """Counts of a per-year ranking summed by name (years outside the ranking do not count)."""
    return ranked.groupBy("name").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "name").limit(limit)


def entity_trend(entities: DataFrame, papers: DataFrame, kind: str, needle: str) -> DataFrame:
    """Mentions per year of names that contain ``needle``."""
    matching = entities_of(entities, kind).filter(contains_like(F.col("name"), needle)).select("paper_id")
    return _with_year(matching, papers).groupBy("year").agg(F.count("*").alias("paper_count")).orderBy("year")


def compare_trends(entities: DataFrame, papers: DataFrame, lines: dict[str, tuple[str, str]]) -> DataFrame:
    """Several trends side by side: label -> (kind, needle), one column per label.

    One pass over the entities; a year without a mention of a label shows null.
    """
    tests = {
        label: (F.col("entity_type") == ENTITY_KINDS[kind]) & contains_like(F.col("name"), needle)
        for label, (kind, needle) in lines.items()
    }
    any_line = F.lit(False)
    for test in tests.values():
        any_line = any_line | test
    joined = _with_year(entities.filter(any_line).select("paper_id", "entity_type", "name"), papers)
    counts = [F.nullif(F.count_if(test), F.lit(0)).alias(label) for label, test in tests.items()]
    return joined.groupBy("year").agg(*counts).orderBy("year")


def entity_list(entities: DataFrame, kind: str, limit: int = 500) -> DataFrame:
    return (
        entities_of(entities, kind)
        .groupBy("name")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "name")
        .limit(limit)
    )


def venue_method_profile(entities: DataFrame, papers: DataFrame, venue: str, top_n: int = 10) -> DataFrame:
    at_venue = papers.filter(F.col("venue") == venue).select(F.col("id").alias("paper_id"))
    return (
        entities_of(entities, "methods")
        .select("paper_id", "name")
        .join(at_venue, "paper_id")
        .groupBy("name")
        .agg(F.count("*").alias("paper_count"))
        .orderBy(F.desc("paper_count"), "name")
        .limit(top_n)
    )


def top_authors(authors: DataFrame, top_n: int = 20) -> DataFrame:
    return (
        authors.groupBy("name")
        .agg(F.count_distinct("paper_id").alias("paper_count"))
        .orderBy(F.desc("paper_count"), "name")
        .limit(top_n)
    )


def enrichment_stats(papers: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: papers, distinct names per type, papers with a method.

    Names are made distinct by one grouping instead of four COUNT DISTINCTs,
    which would expand every row four times.
    """
    names = entities.groupBy("entity_type", "name").agg(F.lit(1).alias("one"))
    per_type = [
        F.count_if(F.col("entity_type") == value).alias(f"total_{kind}") for kind, value in ENTITY_KINDS.items()
    ]
    with_methods = entities_of(entities, "methods").select(F.count_distinct("paper_id"))
    return names.agg(*per_type).withColumns(
        {
            "total_papers": papers.select(F.count("*")).scalar(),
            "papers_with_methods": with_methods.scalar(),
        }
    )


def full_text_stats(papers: DataFrame) -> DataFrame:
    """Papers with full text and their mean length in characters."""
    full = F.col("full_text") != ""
    return papers.agg(
        F.count("*").alias("papers"),
        F.count_if(full).alias("with_full_text"),
        F.avg(F.when(full, F.length("full_text"))).alias("avg_chars"),
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, papers with chunks, chunks per paper and tokens per chunk."""
    per_paper = chunks.groupBy("paper_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    return per_paper.agg(
        F.sum("n").alias("chunks"),
        F.count("*").alias("papers"),
        F.avg("n").alias("chunks_per_paper"),
        F.try_divide(F.sum("tokens"), F.sum("n")).alias("tokens_per_chunk"),
    )

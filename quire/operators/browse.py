"""Finding, paging and showing papers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import contains_like
from quire.model import entities_of
from quire.operators.selection import Key, in_order
from quire.session import MAX_SMALL_ROWS, broadcast_if_small

BROWSE_COLUMNS = ["id", "title", "abstract", "year", "venue", "url"]


def filter_papers(
    papers: DataFrame,
    entities: DataFrame | None = None,
    authors: DataFrame | None = None,
    *,
    venue: str | None = None,
    volume: str | None = None,
    year: int | None = None,
    method: str | None = None,
    dataset: str | None = None,
    author: str | None = None,
) -> DataFrame:
    """Papers that meet every given condition; None, "" and 0 mean no condition.

    The equality conditions reach the scan; the name conditions are left-semi
    joins, so a paper with several matching names appears once.
    """
    equal = {"venue": venue, "volume": volume, "year": year}
    conditions: list[Column] = [F.col(c) == F.lit(v) for c, v in equal.items() if v]
    result = papers.filter(reduce(Column.__and__, conditions)) if conditions else papers

    def keep(matching: DataFrame) -> DataFrame:
        keys = matching.select(F.col("paper_id").alias("id"))
        return result.join(keys, "id", "left_semi")

    if method:
        result = keep(entities_of(entities, "methods").filter(contains_like(F.col("name"), method)))
    if dataset:
        result = keep(entities_of(entities, "datasets").filter(contains_like(F.col("name"), dataset)))
    if author:
        result = keep(authors.filter(contains_like(F.col("name"), author)))
    return result


def browse_papers(papers: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page, newest first, then by title and id; a deep one is found by counts, not by ordering all before it."""
    keys = [Key(F.col("year"), descending=True, text=False), Key(F.col("title")), Key(F.col("id"))]
    return in_order(papers, keys, limit, offset).select([c for c in BROWSE_COLUMNS if c in papers.columns])


def count_papers(papers: DataFrame, page_size: int = 20) -> DataFrame:
    """Total and number of pages of a filtered set."""
    total = papers.agg(F.count("*").alias("total"))
    return total.withColumn("pages", F.ceil(F.col("total") / F.lit(float(page_size))).cast("long"))


def paper_by_id(papers: DataFrame, paper_id: str) -> DataFrame:
    return papers.filter(F.col("id") == paper_id)


def papers_by_ids(papers: DataFrame, paper_ids: list[str] | DataFrame) -> DataFrame:
    """Papers of a short list of ids, or of a frame with ``id``."""
    if isinstance(paper_ids, DataFrame):
        return papers.join(paper_ids.select("id"), "id", "left_semi")
    return papers.filter(F.col("id").isin(paper_ids))


def author_lists(authors: DataFrame) -> DataFrame:
    """(paper_id, authors) with the names in author order."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "name")))
    return authors.groupBy("paper_id").agg(F.transform(ordered, lambda a: a["name"]).alias("authors"))


def attach_authors(page: DataFrame, authors: DataFrame, rows: int | None = None) -> DataFrame:
    """Add author lists to one page of papers, an empty list where there are none.

    The page's ids reduce the author table before the lists are built, so only
    the authors of the page are grouped.  ``rows`` is a known bound of the page; without
    it the page is measured.
    """
    ids = page.select(F.col("id").alias("paper_id"))
    ids = F.broadcast(ids) if rows is not None and rows <= MAX_SMALL_ROWS else broadcast_if_small(ids)
    lists = author_lists(authors.join(ids, "paper_id", "left_semi")).withColumnRenamed("paper_id", "id")
    return page.join(lists, "id", "left").withColumn(
        "authors", F.coalesce("authors", F.array().cast("array<string>"))
    )


def paper_details(papers: DataFrame, authors: DataFrame, entities: DataFrame) -> DataFrame:
    """Papers with nested authors, methods and datasets.

    Filter ``papers`` first for the details of one paper.
    """
    both = entities.filter(F.col("entity_type").isin("method", "dataset"))
    pairs = F.struct("name", "attr")
    nested = both.groupBy("paper_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("entity_type") == "method", pairs))).alias("methods"),
        F.array_sort(F.collect_list(F.when(F.col("entity_type") == "dataset", pairs))).alias("datasets"),
    )
    empty_pairs = F.array().cast("array<struct<name:string,attr:string>>")
    return (
        papers.join(author_lists(authors).withColumnRenamed("paper_id", "id"), "id", "left")
        .join(nested.withColumnRenamed("paper_id", "id"), "id", "left")
        .withColumns(
            {
                "authors": F.coalesce("authors", F.array().cast("array<string>")),
                "methods": F.coalesce("methods", empty_pairs),
                "datasets": F.coalesce("datasets", empty_pairs),
            }
        )
    )


def chunks_with_papers(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunks with title, year and venue of their paper."""
    meta = papers.select(F.col("id").alias("paper_id"), "title", "year", "venue")
    return chunks.join(meta, "paper_id")

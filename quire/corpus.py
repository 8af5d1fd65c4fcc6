"""One corpus: its tables and the service interface over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import parse_chunk_id
from quire.model import check_range, entity_type
from quire.operators import bm25, browse, counts, pairs, postings, vectors
from quire.operators.bm25 import Bm25Index
from quire.operators.postings import BlockIndex
from quire.plans import answers, enrichment
from quire.plans.search import SearchConfig, search
from quire.sources.store import TableStore


MAX_QUERY_LENGTH = 2_000


def checked_lengths(queries: DataFrame) -> DataFrame:
    """``queries`` that raise ValueError for a text that is not 1 to MAX_QUERY_LENGTH characters long."""
    if "query_text" not in queries.columns:
        return queries
    wrong = ~F.coalesce(F.length("query_text"), F.lit(0)).between(1, MAX_QUERY_LENGTH)
    row = queries.filter(wrong).select("query_id", F.length("query_text").alias("n")).first()
    if row is not None:
        raise ValueError(f"the text of query {row['query_id']} has {row['n'] or 0} characters, not 1 to {MAX_QUERY_LENGTH}")
    return queries


@dataclass
class Corpus:
    """Methods mirror the endpoints of the service; each returns a lazy DataFrame.

    Limits of the arguments are those of the service, and breaking one raises
    ValueError.
    """

    papers: DataFrame
    authors: DataFrame
    entities: DataFrame
    chunks: DataFrame | None = None
    embeddings: DataFrame | None = None
    index: Bm25Index | BlockIndex | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, index_path: str | None = None, blocks_path: str | None = None) -> Corpus:
        """Corpus of the tables below ``root``, with a written index, plain or of blocks, if there is one."""
        store = TableStore(spark, root)
        tables = {name: store.read(name) for name in ("papers", "authors", "entities", "chunks", "embeddings")}
        corpus = cls(**tables)
        if index_path is not None:
            corpus.index = bm25.read_index(spark, index_path)
        if blocks_path is not None:
            corpus.index = postings.read_blocks(spark, blocks_path)
        return corpus

    def build_index(self, analyzer: str = "letters") -> Bm25Index:
        if self.chunks is None:
            raise ValueError("the corpus has no chunks")
        self.index = bm25.build_index(self.chunks, analyzer, id_column="id")
        return self.index

    # Papers

    def health(self) -> DataFrame:
        """Paper, chunk and vector counts in one row."""
        sizes = counts.count_rows(self.papers, "papers")
        for name, table in (("chunks", self.chunks), ("vectors", self.embeddings)):
            size = table.select(F.count("*")).scalar() if table is not None else F.lit(0).cast("long")
            sizes = sizes.withColumn(name, size)
        return sizes

    def browse(
        self, page: int = 1, page_size: int = 20, limit: int | None = None, offset: int | None = None, **filters: Any
    ) -> DataFrame:
        """One page of papers with their authors; ``limit`` and ``offset`` choose other rows than a page's."""
        check_range("page", page, 1, None)
        check_range("page_size", page_size, 1, 100)
        check_range("limit", limit, 1, 100)
        check_range("offset", offset, 0, None)
        check_range("year", filters.get("year") or None, 1900, 2100)
        found = browse.filter_papers(self.papers, self.entities, self.authors, **filters)
        limit = page_size if limit is None else limit
        rows = browse.browse_papers(found, limit, (page - 1) * page_size if offset is None else offset)
        return browse.attach_authors(rows, self.authors, limit).orderBy(F.desc_nulls_last("year"), "title", "id")

    def count(self, page_size: int = 20, **filters: Any) -> DataFrame:
        found = browse.filter_papers(self.papers, self.entities, self.authors, **filters)
        return browse.count_papers(found, page_size)

    def paper(self, paper_id: str) -> DataFrame:
        """The paper with authors, methods and datasets; no row when there is none."""
        mine = F.col("paper_id") == paper_id
        return browse.paper_details(
            browse.paper_by_id(self.papers, paper_id), self.authors.filter(mine), self.entities.filter(mine)
        )

    # Analytics

    def trend(self, kind: str, name: str) -> DataFrame:
        entity_type(kind)
        check_range("length of name", len(name), 1, 500)
        return counts.entity_trend(self.entities, self.papers, kind, name)

    def compare_trends(self, lines: dict[str, tuple[str, str]]) -> DataFrame:
        return counts.compare_trends(self.entities, self.papers, lines)

    def top(self, kind: str, top_n: int = 10) -> DataFrame:
        check_range("top_n", top_n, 1, 100)
        return counts.top_entities_by_year(self.entities, self.papers, kind, top_n)

    def list(self, kind: str, limit: int = 500) -> DataFrame:
        check_range("limit", limit, 1, 1000)
        return counts.entity_list(self.entities, kind, limit)

    def cooccurrence(self, left: str = "methods", right: str = "datasets", top_n: int = 20) -> DataFrame:
        check_range("top_n", top_n, 1, 200)
        return pairs.entity_cooccurrence(self.entities, left, right, top_n)

    def stats(self) -> DataFrame:
        return counts.enrichment_stats(self.papers, self.entities)

    def growth(self) -> DataFrame:
        return counts.year_over_year_growth(self.papers)

    def venues(self) -> DataFrame:
        return counts.papers_per_venue_year(self.papers)

    def venues_total(self) -> DataFrame:
        return counts.papers_per_venue(self.papers)

    def top_authors(self, top_n: int = 20) -> DataFrame:
        return counts.top_authors(self.authors, top_n)

    def author_pairs(self, top_n: int = 20) -> DataFrame:
        return pairs.author_pairs(self.authors, top_n)

    def venue_profile(self, venue: str, top_n: int = 10) -> DataFrame:
        return counts.venue_method_profile(self.entities, self.papers, venue, top_n)

    # Search

    def search_chunks(self) -> DataFrame:
        """Chunks with chunk_id and their paper's title, year and venue."""
        if self.chunks is None:
            raise ValueError("the corpus has no chunks")
        return browse.chunks_with_papers(self.chunks, self.papers).withColumnRenamed("id", "chunk_id")

    def _vectors(self) -> DataFrame:
        if self.embeddings is None:
            raise ValueError("the corpus has no embeddings")
        table = self.embeddings
        if table.schema["chunk_id"].dataType.simpleString() == "string":
            # Ids that are no number belong to no chunk.
            table = table.withColumn("chunk_id", parse_chunk_id(F.col("chunk_id"))).filter("chunk_id IS NOT NULL")
        return table

    def search(
        self,
        queries: DataFrame,
        top_k: int = 20,
        venue: str | None = None,
        year_min: int | None = None,
        year_max: int | None = None,
        config: SearchConfig = SearchConfig(),
        scorer: Callable[[Column, Column], Column] | None = None,
    ) -> DataFrame:
        """Results of ``queries`` (query_id, query_text, embedding), best first by rank.

        Texts have 1 to 2,000 characters; others are refused.
        """
        if self.index is None:
            raise RuntimeError("the index is not built, call build_index first")
        check_range("top_k", top_k, 1, 50)
        check_range("year_min", year_min, 1900, 2100)
        check_range("year_max", year_max, 1900, 2100)
        chunks = self.search_chunks()
        where = vectors.search_filter(venue, year_min, year_max)
        queries = checked_lengths(queries)
        return search(self.index, self._vectors(), chunks, queries, config, scorer, top_k, where, chunks)

    def answer(self, results: DataFrame, queries: DataFrame, backend: answers.Backend, context_k: int = 5):
        """Answers of ``queries`` from their ``results``, and the source papers with authors."""
        replies, sources = answers.answer(results, queries, backend, context_k)
        return replies, self.with_authors(sources)

    def with_authors(self, sources: DataFrame) -> DataFrame:
        listed = browse.attach_authors(sources.select(F.col("paper_id").alias("id")).distinct(), self.authors)
        return sources.join(listed.withColumnRenamed("id", "paper_id"), "paper_id", "left")

    # Enrichment

    def unenriched(self) -> DataFrame:
        return enrichment.unenriched(self.papers, self.entities)

    def enrich_missing(self, lexicon: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
        """Entity rows to append for papers that have none."""
        return enrichment.enrich(self.unenriched(), lexicon)



"""Hybrid search: BM25 and vector lists, fusion, chunk rows, reranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import bm25, fusion, postings, vector_index, vectors
from quire.operators.bm25 import Bm25Index
from quire.operators.postings import BlockIndex
from quire.operators.vector_index import VectorIndex
from quire.session import MAX_SMALL_ROWS, hold_if_small, is_small, spread


@dataclass(frozen=True)
class SearchConfig:
    bm25_weight: int = 1
    vector_weight: int = 1
    rrf_k: int = fusion.RRF_K
    hybrid_top_k: int = 50
    rerank_top_k: int = 20
    use_reranker: bool = True
    # Candidates per list; by default three times hybrid_top_k, at most 200.
    bm25_top_k: int | None = None
    vector_top_k: int | None = None
    # Whether a metadata filter also binds the BM25 list.
    filter_sparse: bool = True
    # Cells of a vector index that a query probes, by default what the index was tuned to.
    vector_probes: int | None = None


def held(queries: DataFrame) -> DataFrame:
    """Queries as the plans below share them; a search by one list needs only its column."""
    columns = ("query_id", "query_text", "embedding")
    return hold_if_small(queries.select(*[c for c in columns if c in queries.columns]))


def candidate_lists(
    index: Bm25Index | BlockIndex,
    embeddings: DataFrame,
    queries: DataFrame,
    config: SearchConfig,
    where: dict[str, Any] | None = None,
    metadata: DataFrame | None = None,
    vectors_index: VectorIndex | None = None,
) -> list[tuple[DataFrame, int]]:
    """Ranked lists with their weights; a list of weight zero is not computed.

    With a written ``vectors_index`` the vector list is approximate, else exact.  An
    index of blocks filters by its own columns while it is read, another one by
    ``metadata`` after scoring.
    """
    fetch = fusion.fetch_size(config.hybrid_top_k)
    lists: list[tuple[DataFrame, int]] = []
    if config.bm25_weight > 0 and isinstance(index, BlockIndex):
        asked = queries.select("query_id", "query_text")
        found = postings.search(index, asked, config.bm25_top_k or fetch, where if config.filter_sparse else None)
        lists.append((found, config.bm25_weight))
    elif config.bm25_weight > 0:
        scored = bm25.score(index, queries.select("query_id", "query_text"))
        condition = vectors.compile_where(where)
        if condition is not None and config.filter_sparse and metadata is not None:
            scored = scored.join(metadata.filter(condition).select("chunk_id"), "chunk_id", "left_semi")
        lists.append((bm25.top_k(scored, config.bm25_top_k or fetch, decimals=None), config.bm25_weight))
    if config.vector_weight > 0:
        asked, k = queries.select("query_id", "embedding"), config.vector_top_k or fetch
        if vectors_index is None:
            found = vectors.search(embeddings, asked, k, where)
        else:
            found = vector_index.search(vectors_index, embeddings, asked, k, config.vector_probes, where)
        lists.append((found, config.vector_weight))
    return lists


def hybrid_search(
    index: Bm25Index | BlockIndex,
    embeddings: DataFrame,
    queries: DataFrame,
    config: SearchConfig = SearchConfig(),
    where: dict[str, Any] | None = None,
    metadata: DataFrame | None = None,
    vectors_index: VectorIndex | None = None,
) -> DataFrame:
    """(query_id, chunk_id, rrf_score, rank) of ``queries`` (query_id, query_text, embedding)."""
    queries = held(queries)
    lists = candidate_lists(index, embeddings, queries, config, where, metadata, vectors_index)
    return fusion.fuse(lists, config.hybrid_top_k, config.rrf_k)


def attach_chunks(ranked: DataFrame, chunks: DataFrame, queries: DataFrame, per_query: int) -> DataFrame:
    """Chunk rows of the ranked ids.

    ``ranked`` has at most ``per_query`` rows per query; when that bound is small
    it is broadcast, and the chunk table is read once without a shuffle.
    """
    if is_small(queries.select("query_id"), max_rows=MAX_SMALL_ROWS // per_query):
        ranked = F.broadcast(ranked)
    return fusion.resolve(ranked, spread(chunks))


def search(
    index: Bm25Index | BlockIndex,
    embeddings: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    config: SearchConfig = SearchConfig(),
    scorer: Callable[[Column, Column], Column] | None = None,
    top_k: int | None = None,
    where: dict[str, Any] | None = None,
    metadata: DataFrame | None = None,
    vectors_index: VectorIndex | None = None,
) -> DataFrame:
    """Results of each query with their chunk rows, best first by ``rank``.

    ``chunks`` needs chunk_id and chunk_text.  Without a scorer, or with the
    reranker switched off, the fused order stands.
    """
    k = top_k or config.rerank_top_k
    queries = held(queries)
    ranked = hybrid_search(index, embeddings, queries, config, where, metadata, vectors_index)
    found = attach_chunks(ranked, chunks, queries, config.hybrid_top_k)
    if scorer is not None and config.use_reranker:
        texts = queries.select("query_id", "query_text")
        if is_small(texts):
            texts = F.broadcast(texts)
        return fusion.rerank(found.join(texts, "query_id"), scorer, k).drop("query_text")
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

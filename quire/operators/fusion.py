"""Reciprocal rank fusion and what follows it: resolving, reranking, sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import letter_terms

RRF_K = 60


def fuse(lists: list[tuple[DataFrame, int]], k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, rrf_score, rank) of weighted ranked lists.

    Each list is (query_id, chunk_id, rank); its weight counts it that many
    times and zero leaves it out.  Equal scores keep the order of the lists.
    """
    parts = [
        ranked.select(
            "query_id", "chunk_id", "rank", F.lit(number).alias("list_no"), F.lit(float(weight)).alias("list_weight")
        )
        for number, (ranked, weight) in enumerate(lists)
        if weight > 0
    ]
    if not parts:
        raise ValueError("at least one list needs a positive weight")
    return fuse_rows(reduce(DataFrame.unionByName, parts), k, rrf_k)


def fuse_rows(
    rows: DataFrame, k: int | None = None, rrf_k: int = RRF_K, keys: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """The same for rows (keys, chunk_id, rank, list_no, list_weight) of all lists."""
    fused = (
        rows.filter(F.col("list_weight") > 0)
        .groupBy(*keys, "chunk_id")
        .agg(
            F.sum(F.col("list_weight") / (F.lit(float(rrf_k)) + F.col("rank"))).alias("rrf_score"),
            F.min(F.struct("list_no", "rank")).alias("first_seen"),
        )
    )
    order = Window.partitionBy(*keys).orderBy(F.round("rrf_score", 12).desc(), "first_seen", "chunk_id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).drop("first_seen")
    return ranked.filter(F.col("rank") <= k) if k is not None else ranked


def fetch_size(top_k: int) -> int:
    """How many candidates each list gives before fusion."""
    return min(top_k * 3, 200)


def resolve(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach the chunk rows; ids without a chunk drop out.

    Ranked lists are bounded per query, and AQE broadcasts them when they turn
    out small, which leaves the chunk table unshuffled.
    """
    return ranked.join(chunks, "chunk_id")


def term_overlap(query: Column, text: Column) -> Column:
    """Share of the distinct query terms that occur in the text: a scorer
    without a model."""
    wanted = F.array_distinct(letter_terms(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, letter_terms(text))), F.size(wanted)), F.lit(0.0))


def pair_scorer(model: Callable[[list[tuple[str, str]]], np.ndarray]) -> Callable[[Column, Column], Column]:
    """Column scorer of a model that scores lists of (query, text) pairs."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            pairs = list(zip(queries.tolist(), texts.tolist(), strict=True))
            yield pd.Series(np.asarray(model(pairs), dtype=np.float64))

    return lambda query, text: run(query, text)


def rerank(
    candidates: DataFrame, scorer: Callable[[Column, Column], Column] = term_overlap, k: int = 20
) -> DataFrame:
    """Best ``k`` candidates of each query by the scorer, equal scores in their old order.

    ``candidates`` has query_id, query_text, chunk_id, chunk_text and rank.
    """
    scored = candidates.withColumn("ce_score", scorer(F.col("query_text"), F.col("chunk_text")))
    order = Window.partitionBy("query_id").orderBy(F.desc("ce_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sources(results: DataFrame, context_k: int = 5) -> DataFrame:
    """Papers of the results of each query, each at its best chunk.

    ``used_in_answer`` marks papers with a chunk among the first ``context_k``.
    Result lists are bounded, so the windows are small.
    """
    by_paper = Window.partitionBy("query_id", "paper_id")
    used = F.max((F.col("rank") <= context_k).cast("int")).over(by_paper) == 1
    first = F.row_number().over(by_paper.orderBy("rank")) == 1
    return results.withColumns({"used_in_answer": used, "first": first}).filter("first").drop("first")


def cited(source_rows: DataFrame) -> DataFrame:
    return source_rows.filter("used_in_answer")


def also_relevant(source_rows: DataFrame) -> DataFrame:
    return source_rows.filter(~F.col("used_in_answer"))

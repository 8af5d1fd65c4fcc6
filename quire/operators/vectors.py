"""Exact cosine search over embeddings, for many query vectors at once.

Each task multiplies its batches with the matrix of query vectors and keeps a
running top-k per query, so what leaves a task is k rows per query, never all
pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.bm25 import RANK_DECIMALS, top_k
from quire.session import is_small

# Limits of a query set that every task may hold, and of one block beyond it.
MAX_QUERIES = 4096
CELL_ROWS = 50_000


def compile_where(where: dict[str, Any] | None, column: Callable[[str], Column] = F.col) -> Column | None:
    """Condition of a metadata filter: equality, comparison operators, ``$and``.

    Several keys, and several operators of one key, must all hold.  ``column`` gives the
    value of a key.
    """
    if not where:
        return None
    operators: dict[str, Callable[[Column, Any], Column]] = {
        "$eq": lambda c, v: c == F.lit(v),
        "$ne": lambda c, v: c != F.lit(v),
        "$gt": lambda c, v: c > F.lit(v),
        "$gte": lambda c, v: c >= F.lit(v),
        "$lt": lambda c, v: c < F.lit(v),
        "$lte": lambda c, v: c <= F.lit(v),
        "$in": lambda c, v: c.isin(list(v)),
    }
    parts: list[Column] = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [c for v in value if (c := compile_where(v, column)) is not None]
            if inner:
                parts.append(reduce(Column.__and__ if key == "$and" else Column.__or__, inner))
        elif isinstance(value, dict):
            for operator, operand in value.items():
                if operator not in operators:
                    raise ValueError(f"unknown filter operator {operator!r}")
                parts.append(operators[operator](column(key), operand))
        else:
            parts.append(column(key) == F.lit(value))
    return reduce(Column.__and__, parts) if parts else None


def search_filter(
    venue: str | None = None, year_min: int | None = None, year_max: int | None = None
) -> dict[str, Any] | None:
    """Filter of a search request: every given bound applies."""
    years = {op: y for op, y in (("$gte", year_min), ("$lte", year_max)) if y is not None}
    where: dict[str, Any] = {}
    if years:
        where["year"] = years
    if venue:
        where["venue"] = venue
    return where or None


def normalize(embedding: Column) -> Column:
    """Scale to length one; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    scaled = F.transform(embedding, lambda x: (x.cast("double") / norm).cast("float"))
    return F.when(norm > 0, scaled).otherwise(embedding)


def encode(df: DataFrame, text_column: str, encoder: Callable[[list[str]], np.ndarray], output: str = "embedding") -> DataFrame:
    """Add unit vectors of a text column.

    ``encoder`` maps a list of texts to a 2-d array; Spark hands it Arrow batches.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = np.asarray(encoder(batch.fillna("").tolist()), dtype=np.float64)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list((vectors / np.where(norms == 0, 1, norms)).astype(np.float32)))

    return df.withColumn(output, run(F.col(text_column)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list<float> column as a matrix of unit rows."""
    values = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(norms == 0, 1, norms)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best ``k``; equal scores go to the smaller id."""
    key = np.round(scores, RANK_DECIMALS)
    if len(key) > k:
        # Every row at least as good as the k-th stays in, ties included.
        keep = np.flatnonzero(key >= np.partition(key, len(key) - k)[len(key) - k])
        key, scores, ids = key[keep], scores[keep], ids[keep]
    order = np.lexsort((ids, -key))[:k]
    return ids[order], scores[order]


def _scored_table(query_ids: list, best: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = [
        [q for q, (ids, _) in zip(query_ids, best, strict=True) for _ in ids],
        [i for ids, _ in best for i in ids.tolist()],
        [s for _, scores in best for s in scores.tolist()],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def search(corpus: DataFrame, queries: DataFrame, k: int = 50, where: dict[str, Any] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): nearest rows of ``corpus`` (chunk_id,
    embedding, metadata) for each row of ``queries`` (query_id, embedding)."""
    condition = compile_where(where)
    if condition is not None:
        corpus = corpus.filter(condition)
    rows = corpus.select("chunk_id", "embedding").filter(F.size("embedding") > 0)
    wanted = queries.select("query_id", "embedding").filter(F.size("embedding") > 0)
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", corpus.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if is_small(wanted, max_rows=MAX_QUERIES):
        found = _against_shared_queries(rows, wanted, k, schema)
    else:
        found = _against_query_blocks(rows, wanted, k, schema)
    return top_k(found, k)


def _against_shared_queries(rows: DataFrame, wanted: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Every task holds the (measured) query set and streams over its corpus rows."""
    spark = rows.sparkSession
    table = wanted.toArrow()
    query_ids = table["query_id"].to_pylist()
    matrix = _matrix(table["embedding"].combine_chunks()).T if query_ids else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast((query_ids, matrix))
    arrow_schema = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of_queries, query_matrix = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] | None = None
        for batch in batches:
            if not batch.num_rows or not ids_of_queries:
                continue
            ids = batch["chunk_id"].to_numpy(zero_copy_only=False)
            scores = _matrix(batch["embedding"]) @ query_matrix
            fresh = [_best(scores[:, q], ids, k) for q in range(len(ids_of_queries))]
            if best is None:
                best = fresh
            else:
                best = [
                    _best(np.concatenate([s0, s1]), np.concatenate([i0, i1]), k)
                    for (i0, s0), (i1, s1) in zip(best, fresh, strict=True)
                ]
        if best is not None:
            yield _scored_table(ids_of_queries, best, arrow_schema)

    return rows.mapInArrow(run, schema)


def _against_query_blocks(rows: DataFrame, wanted: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Query set too large to share: blocks of queries meet cells of corpus rows.

    Block and cell sizes are bounded, so a group always fits into one task.
    """
    n_blocks = max(1, -(-wanted.count() // MAX_QUERIES) * 2)
    n_cells = max(1, -(-rows.count() // CELL_ROWS) * 2)
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")
    cell = F.pmod(F.xxhash64("chunk_id"), F.lit(n_cells)).cast("int")
    left = wanted.withColumn("block", block).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
    right = rows.withColumn("cell", cell).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    arrow_schema = _arrow(schema)

    def run(query_block: pa.Table, corpus_cell: pa.Table) -> pa.Table:
        query_ids = query_block["query_id"].to_pylist()
        if not query_ids or not corpus_cell.num_rows:
            return pa.Table.from_batches([], arrow_schema)
        ids = corpus_cell["chunk_id"].to_numpy()
        queries_matrix = _matrix(query_block["embedding"].combine_chunks())
        scores = _matrix(corpus_cell["embedding"].combine_chunks()) @ queries_matrix.T
        best = [_best(scores[:, q], ids, k) for q in range(len(query_ids))]
        return pa.Table.from_batches([_scored_table(query_ids, best, arrow_schema)])

    keys = ["block", "cell"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    types = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
    return pa.schema([(f.name, types[f.dataType]) for f in schema])


def vectors_of_paper(corpus: DataFrame, paper_id: str) -> DataFrame:
    return corpus.filter(F.col("paper_id") == paper_id)

"""BM25 over a written index of blocks, with early stop.

Chunks are dealt into shards of bounded size.  A shard holds, for each of its terms, the
chunks with the term in order of id, cut into blocks of chunk ranges; of each block it
knows the largest term count and the shortest chunk, which bound the weight of the term
in it.  A query sums the bounds of its terms per block, reads blocks from the highest
bound down and stops where the bound falls below its k-th best score.  The result is the
exact top k.

The shards are buckets of one table, so a search runs where they are read: what moves is
k rows per query and shard, never an occurrence.  Building analyzes each text once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.text import ANALYZERS
from quire.operators.bm25 import MAX_PUSHED_TERMS, SCORE_UNIT, query_terms, top_k
from quire.operators.vectors import compile_where
from quire.session import hold_if_small

# One Python worker builds a shard: 8,192 chunks (25 MB of text) take 95 MB beside the table of their words.
SHARD_CHUNKS = 8_192
SHARD_BYTES = 32 << 20  # of text
BLOCK = 32  # chunks that one block ranges over
MAX_BUCKETS = 8_192
MAX_QUERIES = 4_096  # that one pass over the index answers
FIRST_BLOCKS = 4  # read before a query has a threshold; later steps double


@dataclass(frozen=True)
class BlockIndex:
    postings: DataFrame  # shard, term, n, docs, counts, blocks, starts, most, least, ids, lengths, meta
    vocabulary: DataFrame  # term, df, idf
    chunks: int
    avg_length: float
    analyzer: str = "letters"
    k1: float = 1.5
    b: float = 0.75


def _schema(id_type: T.DataType, meta: list[T.StructField]) -> T.StructType:
    long_list, int_list = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    return T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("term", T.StringType()),  # empty in the row that tells of the chunks
            T.StructField("n", T.LongType()),
            T.StructField("docs", T.BinaryType()),  # numbers of chunks in the shard, ascending
            T.StructField("counts", T.BinaryType()),
            T.StructField("blocks", int_list),  # blocks with the term
            T.StructField("starts", int_list),  # where each begins in docs
            T.StructField("most", int_list),  # largest count in each
            T.StructField("least", long_list),  # length of the shortest chunk with the term in each
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("lengths", long_list),
            T.StructField("meta", T.ArrayType(T.StructType(meta)) if meta else T.ArrayType(T.BooleanType())),
        ]
    )


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Consecutive runs of ``values`` as a list array; run i ends where run i + 1 starts."""
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))


def _bytes(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The same runs as byte strings."""
    offsets = (starts * values.itemsize).astype(np.int64)
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _build_shard(shard: pa.Table, schema: pa.Schema, meta: list[str]) -> pa.Table:
    """The rows of one shard: one for its chunks, from short to long, and one for each term.

    A block of chunks of much the same length has a tight bound.
    """
    lengths = pc.fill_null(pc.list_value_length(shard["terms"]), 0)
    # The terms stay where they are, only the places of their chunks are put in order.
    order = pc.sort_indices(pa.table({"length": lengths, "chunk_id": shard["chunk_id"]}), [("length", "ascending"), ("chunk_id", "ascending")])
    lengths, number = lengths.to_numpy().astype(np.int64), shard["shard"][0].as_py()
    place = np.empty(len(lengths), np.int32)
    place[order.to_numpy()] = np.arange(len(lengths))
    doc = np.repeat(place, lengths)
    lengths = lengths[order.to_numpy()]
    told = pa.StructArray.from_arrays([shard[m].take(order).combine_chunks() for m in meta], meta).to_pylist() if meta else None
    ids = shard["chunk_id"].take(order).to_pylist()
    chunks = dict.fromkeys(schema.names) | {"shard": number, "term": "", "n": len(lengths), "ids": ids, "lengths": lengths.tolist(), "meta": told}
    head = pa.table({k: [v] for k, v in chunks.items()}, schema=schema)
    if not len(doc):
        return head
    words = pa.chunked_array([c.flatten() for c in shard["terms"].chunks]).dictionary_encode().combine_chunks()
    # Numbers of the terms in their order, which is the order of the rows.
    by_name = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    names = words.dictionary.take(pa.array(by_name))
    # One array of a number for each word, sorted in place: a shard's memory is little more than this and its words.
    key = rank[words.indices.to_numpy(zero_copy_only=False)]
    del words
    key *= len(lengths)
    key += doc
    del doc
    key.sort()
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(starts, append=len(key)).astype(np.int32)
    key = key[starts]
    del starts
    term, doc = key // len(lengths), (key % len(lengths)).astype(np.int32)
    del key
    # Blocks: where the term or the range of chunks changes.
    edge = np.flatnonzero(np.diff(term * (len(lengths) // BLOCK + 1) + doc // BLOCK, prepend=-1))
    first = np.searchsorted(term, np.arange(len(by_name) + 1))
    first_block = np.searchsorted(term[edge], np.arange(len(by_name) + 1))
    columns = {
        "shard": pa.array(np.full(len(by_name), number, np.int32)),
        "term": names,
        "n": pa.array(np.diff(first).astype(np.int64)),
        "docs": _bytes(doc, first),
        "counts": _bytes(counts, first),
        "blocks": _lists(doc[edge] // BLOCK, first_block),
        "starts": _lists((edge - first[term[edge]]).astype(np.int32), first_block),
        "most": _lists(np.maximum.reduceat(counts, edge), first_block),
        "least": _lists(np.minimum.reduceat(lengths[doc], edge), first_block),
    }
    rest = pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(len(by_name), f.type) for f in schema], schema=schema)
    return pa.concat_tables([head, rest])


def _labels(spark: SparkSession, shards: int, buckets: int) -> list[int]:
    """Numbers for the shards that hash to the buckets evenly."""
    per = -(-shards // buckets)
    labels: list[int] = []
    found: dict[int, int] = {}
    reach = 16 * shards + 1_000
    numbers = spark.range(reach).select(F.col("id").cast("int").alias("id"))
    for row in numbers.select("id", F.pmod(F.hash("id"), F.lit(buckets)).alias("b")).orderBy("id").toLocalIterator():
        if found.get(row["b"], 0) < per:
            found[row["b"]] = found.get(row["b"], 0) + 1
            labels.append(row["id"])
            if len(labels) == shards:
                break
    return labels or [0]


def write_blocks(
    chunks: DataFrame,
    path: str,
    analyzer: str = "letters",
    columns: tuple[str, ...] = (),
    version: str = "",
    epsilon: float = 0.25,
    id_column: str = "chunk_id",
    text_column: str = "chunk_text",
    shard_chunks: int = SHARD_CHUNKS,
) -> None:
    """Write the index of ``chunks`` in the folder ``path``; ``columns`` can be filtered on.

    Ids must be distinct and not null.  Texts are analyzed once; vocabulary and totals
    are read from the written shards.
    """
    spark = chunks.sparkSession
    texts = chunks.select(F.col(id_column).alias("chunk_id"), F.coalesce(text_column, F.lit("")).alias("text"), *columns)
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    # Shards of bounded size, and at least one for each core.
    shards = max(-(-size["n"] // shard_chunks), -(-size["bytes"] // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, -(-size["n"] // BLOCK)), 1)
    buckets = min(MAX_BUCKETS, shards)
    labels = _labels(spark, shards, buckets)
    own = F.element_at(F.array(*map(F.lit, labels)), F.pmod(F.xxhash64("chunk_id"), F.lit(len(labels))).cast("int") + 1)
    placed = texts.withColumn("shard", own).repartition(buckets, "shard")
    analyzed = placed.select("shard", "chunk_id", ANALYZERS[analyzer](F.col("text")).alias("terms"), *columns)
    schema = _schema(texts.schema["chunk_id"].dataType, [texts.schema[c] for c in columns])
    arrow_schema = to_arrow_schema(schema)
    meta = list(columns)

    def build(shard: pa.Table) -> pa.Table:
        return _build_shard(shard, arrow_schema, meta) if shard.num_rows else arrow_schema.empty_table()

    rows = analyzed.groupBy("shard").applyInArrow(build, schema)
    writer = rows.write.bucketBy(buckets, "shard").sortBy("shard", "term").option("path", f"{path}/postings").mode("overwrite")
    writer.saveAsTable(name := f"blocks_{uuid.uuid4().hex}")
    postings = spark.table(name)

    totals = postings.filter("term = ''").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("length"),
    ).first()
    n, length = totals["chunks"], totals["length"] or 0
    terms = postings.filter("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))
    terms = terms.withColumn("plain", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = terms.select(F.avg("plain")).scalar()
    idf = F.when(F.col("plain") < 0, F.lit(epsilon) * mean).otherwise(F.col("plain"))
    terms.select("term", "df", idf.alias("idf")).sort("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    settings = [(n, length / n if n else None, buckets, analyzer, version, schema.simpleString())]
    names = "chunks long, avg_length double, buckets int, analyzer string, version string, columns string"
    spark.createDataFrame(settings, names).write.mode("overwrite").parquet(f"{path}/settings")
    spark.sql(f"DROP TABLE {name}")  # the files stay, the table is external


def read_blocks(spark: SparkSession, path: str, version: str | None = None, k1: float = 1.5, b: float = 0.75) -> BlockIndex:
    """A written index as a table of buckets; one of another ``version`` of the chunks is refused."""
    row = spark.read.parquet(f"{path}/settings").first()
    if version is not None and row["version"] != version:
        raise ValueError(f"the index is of chunks {row['version']!r}, not of {version!r}; build it again")
    fields = row["columns"].removeprefix("struct<").removesuffix(">")
    name = f"blocks_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T._parse_datatype_string(f"struct<{fields}>").fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (shard) SORTED BY (shard, term) INTO {row['buckets']} BUCKETS LOCATION '{path}/postings'"
    )
    return BlockIndex(spark.table(name), spark.read.parquet(f"{path}/vocabulary"), row["chunks"], row["avg_length"] or 0.0, row["analyzer"], k1, b)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the runs that begin at ``starts``, one run after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


class _Shard:
    """The terms of one shard that are asked for, as flat arrays of blocks and of chunks."""

    def __init__(self, table: pa.Table, k1: float, b: float, avg_length: float):
        self.k1, self.b, self.avg = k1, b, avg_length
        self.allowed = None
        head = table.filter(pc.equal(table["term"], ""))
        terms = table.filter(pc.not_equal(table["term"], ""))
        self.size = head["n"][0].as_py() if head.num_rows else 0
        if not self.size:
            return
        self.lengths = head["lengths"].combine_chunks().flatten().to_numpy()
        self.ids = head["ids"].combine_chunks().flatten()
        self.turn = np.empty(self.size, np.int64)  # places in the order of ids, for ties
        self.turn[pc.sort_indices(self.ids).to_numpy()] = np.arange(self.size)
        if "allowed" in table.schema.names:
            self.allowed = head["allowed"].combine_chunks().flatten().fill_null(False).to_numpy(zero_copy_only=False)
        self.number = {t: i for i, t in enumerate(terms["term"].to_pylist())}

        def joined(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(terms[name].to_pylist()), kind)

        def flat(name: str) -> np.ndarray:
            return terms[name].combine_chunks().flatten().to_numpy(zero_copy_only=False) if terms.num_rows else np.empty(0, np.int64)

        self.docs, self.counts = joined("docs", np.int32), joined("counts", np.int32)
        sizes = terms["n"].to_numpy()
        in_term = np.asarray(pc.list_value_length(terms["blocks"]).to_numpy(), np.int64)
        self.first_block = np.concatenate([[0], np.cumsum(in_term)]).astype(np.int64)
        self.blocks = flat("blocks").astype(np.int64)
        self.starts = flat("starts") + np.repeat(np.cumsum(sizes) - sizes, in_term)
        self.ends = np.append(self.starts[1:], len(self.docs))
        self.bound = self.weight(flat("most"), flat("least"))

    def weight(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        norm = (1 - self.b) + self.b * lengths / self.avg
        return counts * (self.k1 + 1) / (counts + self.k1 * norm)

    def best(self, terms: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Numbers and scores (in units) of the best ``k`` chunks, the number of blocks and of those read.

        A block's bound is never below a score in it: weights rise with the count and
        fall with the length, and rounding adds at most a unit for each term.
        """
        held = [(self.number[t], w) for t, w in terms if t in self.number]
        if not held:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
        numbers = np.array([t for t, _ in held])
        sizes = self.first_block[numbers + 1] - self.first_block[numbers]
        entries = _ranges(self.first_block[numbers], sizes)
        weights = np.repeat(np.array([w for _, w in held]), sizes)
        own = self.blocks[entries]
        n_blocks = self.size // BLOCK + 1
        # A negative weight (of a mean that is negative) bounds nothing but zero from above.
        units = np.maximum(weights * self.bound[entries], 0.0) * (SCORE_UNIT * (1 + 1e-9)) + 1
        bound = np.bincount(own, units, n_blocks)
        order = np.argsort(-bound, kind="stable")[: int((bound > 0).sum())]
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        floor, read, step = -1, 0, FIRST_BLOCKS
        while read < len(order):
            now = order[read : read + step]
            now = now[bound[now] >= floor]
            if not len(now):
                break
            read, step = read + len(now), step * 2
            found, fresh = self._read(entries, weights, own, now, n_blocks)
            keep = fresh > 0
            if self.allowed is not None:
                keep &= self.allowed[found]
            docs, scores = np.concatenate([docs, found[keep]]), np.concatenate([scores, fresh[keep]])
            top = np.lexsort((self.turn[docs], -scores))[:k]
            docs, scores = docs[top], scores[top]
            if len(docs) == k:
                floor = scores[-1]  # equal scores go to smaller ids, so blocks of this bound are read, too
        return docs, scores, len(order), read

    def _read(self, entries, weights, own, blocks: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of ``blocks`` that hold a term, and their scores."""
        slot = np.full(n_blocks, -1)
        slot[blocks] = np.arange(len(blocks))
        mine = np.flatnonzero(slot[own] >= 0)
        starts = self.starts[entries[mine]]
        sizes = self.ends[entries[mine]] - starts
        at = _ranges(starts, sizes)
        docs = self.docs[at]
        place = slot[docs // BLOCK] * BLOCK + docs % BLOCK
        units = np.floor(np.repeat(weights[mine], sizes) * self.weight(self.counts[at], self.lengths[docs]) * SCORE_UNIT + 0.5)
        total = np.bincount(place, units, len(blocks) * BLOCK).astype(np.int64)  # whole numbers far below 2**53
        hit = np.flatnonzero(np.bincount(place, minlength=len(total)))
        return blocks[hit // BLOCK] * BLOCK + hit % BLOCK, total[hit]


def _answers(index: BlockIndex, queries: DataFrame, k: int, where: dict[str, Any] | None) -> DataFrame:
    """(query_id, chunk_id, score) of the best ``k`` of each shard, and (query_id, blocks, read) in rows without a chunk_id."""
    spark = queries.sparkSession
    terms = query_terms(queries, index.analyzer)
    weighted = terms.join(index.vocabulary.select("term", "idf"), "term")
    weighted = weighted.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")).orderBy("query_id", "term").collect()
    asked: dict[Any, list[tuple[str, float]]] = {}
    for row in weighted:  # terms of MAX_QUERIES queries
        asked.setdefault(row["query_id"], []).append((row["term"], row["w"]))
    wanted = sorted({t for own in asked.values() for t, _ in own})
    shared = spark.sparkContext.broadcast(asked)
    rows = index.postings
    if len(wanted) <= MAX_PUSHED_TERMS:
        rows = rows.filter(F.col("term").isin("", *wanted))
    else:
        names = spark.createDataFrame([("",), *((t,) for t in wanted)], "term string")
        rows = rows.join(F.broadcast(names), "term", "left_semi")
    use = ["shard", "term", "n", "docs", "counts", "blocks", "starts", "most", "least", "ids", "lengths"]
    if where:
        allowed = F.transform("meta", lambda m: F.coalesce(compile_where(where, lambda key: m[key]), F.lit(False)))
        rows = rows.withColumn("allowed", F.when(F.col("term") == "", allowed))
        use.append("allowed")
    id_type = index.postings.schema["ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", id_type),
            T.StructField("units", T.LongType()),
            T.StructField("blocks", T.LongType()),
            T.StructField("read", T.LongType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)
    k1, b, avg_length = index.k1, index.b, index.avg_length

    def answer(table: pa.Table) -> pa.Table:
        shard = _Shard(table, k1, b, avg_length)
        if not shard.size:
            return arrow_schema.empty_table()
        columns: list[list] = [[], [], [], [], []]
        for query, terms in shared.value.items():
            docs, units, blocks, read = shard.best(terms, k)
            own = [[query] * (len(docs) + 1), [*shard.ids.take(pa.array(docs)).to_pylist(), None], [*units.tolist(), None], [None] * len(docs) + [blocks], [None] * len(docs) + [read]]
            for column, values in zip(columns, own, strict=True):
                column += values
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema)

    return rows.select(*use).groupBy("shard").applyInArrow(answer, schema)


def _in_passes(index: BlockIndex, queries: DataFrame, k: int, where: dict[str, Any] | None) -> DataFrame:
    """All queries; a set beyond MAX_QUERIES takes one pass over the index for each block of it."""
    queries = hold_if_small(queries.select("query_id", "query_text"))
    passes = max(1, -(-2 * queries.count() // MAX_QUERIES)) if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES else 1
    block: Column = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    parts = [_answers(index, queries.filter(block == p) if passes > 1 else queries, k, where) for p in range(passes)]
    return reduce(DataFrame.unionAll, parts)


def search(index: BlockIndex, queries: DataFrame, k: int = 50, where: dict[str, Any] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best ``k`` chunks of each query, as ``bm25.search``.

    ``where`` filters on the columns of the index; chunks that it excludes are passed
    over while blocks are read, so k others are found.
    """
    found = _in_passes(index, queries, k, where).filter("chunk_id IS NOT NULL")
    scored = found.select("query_id", "chunk_id", (F.col("units") / F.lit(SCORE_UNIT)).alias("score"))
    return top_k(scored, k, decimals=None)


def block_statistics(index: BlockIndex, queries: DataFrame, k: int = 50, where: dict[str, Any] | None = None) -> DataFrame:
    """(query_id, blocks, read): blocks that hold a term of the query, and those that a search reads."""
    told = _in_passes(index, queries, k, where).filter("chunk_id IS NULL")
    return told.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read"))

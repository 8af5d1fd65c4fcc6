"""Approximate cosine search: inverted cells with residual codes, written as a table.

The space is cut into cells around centroids trained on a bounded sample.  A row of the
index holds the cell of a vector and, one byte a dimension, what is left of the vector
after its centroid is taken off.  Rows lie in a folder per cell; a search reads the
folders of the cells nearest to its queries and no other, and each query goes to its
cells only.  Every row carries the length of its coding error, so the scores of codes
are bounds: whatever could be among the best k of the probed cells is compared exactly.
Probing all cells therefore gives the rows of the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.bm25 import top_k
from quire.operators.vectors import MAX_QUERIES, compile_where
from quire.session import broadcast_if_small, is_small, spread

MAX_CELLS = 1_024
SAMPLE_ROWS = 16_384  # vectors that centroids are trained on, about
TRAINING_ROUNDS = 12
PART_ROWS = 100_000  # rows of a cell that lie in one file
TARGET, TARGET_K = 0.95, 10  # recall of the best k on the sample, that sets how many cells are probed
TUNING_ROWS = 512
TILE = 256  # queries that one step compares with a batch of rows


@dataclass(frozen=True)
class VectorIndex:
    rows: DataFrame  # cell, part, chunk_id, code, step, error and metadata
    centroids: np.ndarray
    parts: np.ndarray  # files of each cell
    probes: int  # cells that a search probes unless told otherwise
    columns: tuple[str, ...] = ()

    @property
    def cells(self) -> int:
        return len(self.centroids)


def unit_rows(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Rows of a list column at length one; zero vectors stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimension)
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(norms == 0, 1, norms)


def train(sample: np.ndarray, cells: int, rounds: int = TRAINING_ROUNDS) -> np.ndarray:
    """Centroids of ``sample`` by k-means; an empty cell takes the row farthest from its centroid."""
    rng = np.random.default_rng(11)
    cells = min(cells, len(sample))
    centroids = sample[rng.choice(len(sample), cells, replace=False)] if cells else np.zeros((0, sample.shape[1]))
    for _ in range(rounds if cells else 0):
        own, far = nearest_cells(sample, centroids, 1)
        own, far = own[:, 0], far[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=cells)
        empty = np.flatnonzero(counts == 0)
        centroids = sums / np.maximum(counts, 1)[:, None]
        centroids[empty] = sample[np.argsort(-far)[: len(empty)]]
    return centroids


def nearest_cells(rows: np.ndarray, centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` cells nearest to each row, nearest first, and their squared distances less the row's own length."""
    far = (centroids * centroids).sum(1) - 2 * rows @ centroids.T
    n = min(n, len(centroids))
    best = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centroids) else np.tile(np.arange(n), (len(rows), 1))
    order = np.argsort(np.take_along_axis(far, best, 1), axis=1, kind="stable")
    best = np.take_along_axis(best, order, 1)
    return best, np.take_along_axis(far, best, 1)


def probes_for(sample: np.ndarray, centroids: np.ndarray, target: float = TARGET, k: int = TARGET_K) -> int:
    """Cells that must be probed for a mean recall of ``target``.

    Rows of the sample ask for their neighbours in it.  Those are farther than the
    neighbours in the whole corpus, so the number is rather too high than too low.
    """
    asking = sample[:TUNING_ROWS]
    k = min(k, len(sample) - 1)
    if k < 1 or len(centroids) < 2:
        return max(1, len(centroids))
    scores = asking @ sample.T
    scores[np.arange(len(asking)), np.arange(len(asking))] = -2
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    own = nearest_cells(sample, centroids, 1)[0][:, 0]
    cells = nearest_cells(asking, centroids, len(centroids))[0]
    turn = np.empty_like(cells)
    np.put_along_axis(turn, cells, np.arange(cells.shape[1])[None, :], 1)
    at = np.sort(np.take_along_axis(turn, own[near], 1).ravel())
    return int(at[max(0, int(np.ceil(target * len(at))) - 1)]) + 1


def encode_rows(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cell, code (signed bytes), step and length of the coding error of each row."""
    cell = nearest_cells(rows, centroids, 1)[0][:, 0].astype(np.int32)
    rest = rows - centroids[cell]
    step = (np.abs(rest).max(axis=1, initial=0) / 127).astype(np.float32)
    code = np.rint(rest / np.where(step == 0, 1, step)[:, None]).clip(-127, 127).astype(np.int8)
    error = np.linalg.norm(rest - code * step[:, None].astype(np.float64), axis=1)
    return cell, code, step, (error * (1 + 1e-6) + 1e-12).astype(np.float32)


def _usable(corpus: DataFrame, dimension: int | None = None) -> DataFrame:
    full = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return corpus.filter(full if dimension is None else full & (F.size("embedding") == dimension))


def _coded(corpus: DataFrame, centroids: np.ndarray, columns: tuple[str, ...]) -> DataFrame:
    dimension = centroids.shape[1]
    schema = T.StructType([corpus.schema[c] for c in ("chunk_id", *columns)])
    for name, kind in (("cell", T.IntegerType()), ("code", T.BinaryType()), ("step", T.FloatType()), ("error", T.FloatType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, code, step, error = encode_rows(unit_rows(batch["embedding"], dimension), centroids)
            kept = [batch[c] for c in ("chunk_id", *columns)]
            new = [pa.array(cell), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(error)]
            yield pa.RecordBatch.from_arrays(kept + new, schema.names)

    return spread(_usable(corpus, dimension).select("chunk_id", *columns, "embedding")).mapInArrow(run, schema)


def _write_rows(coded: DataFrame, parts: np.ndarray, path: str, mode: str) -> None:
    """Rows in a folder per cell; a cell with many rows is dealt into parts of bounded size."""
    of_cell = F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("cell") + 1)
    placed = coded.withColumn("part", F.pmod(F.xxhash64("chunk_id"), of_cell).cast("int"))
    placed = placed.repartition("cell", "part").sortWithinPartitions("cell", "part", "chunk_id")
    placed.write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")


def write_index(
    corpus: DataFrame, path: str, cells: int | None = None, columns: tuple[str, ...] = (), version: str = "", part_rows: int = PART_ROWS
) -> None:
    """Index ``corpus`` (chunk_id, embedding, ``columns``) in the folder ``path``.

    ``columns`` can be filtered on in a search.  Rows without a vector, with a null or
    NaN in it, or of another length than the first are left out, as they have no cosine.
    Without ``cells`` there are about as many as the root of the number of rows, at most
    MAX_CELLS.  Centroids and the number of files of a cell come from about SAMPLE_ROWS rows.
    """
    if clash := {"chunk_id", "cell", "part", "code", "step", "error"} & set(columns):
        raise ValueError(f"the index has columns of its own named {sorted(clash)}")
    spark = corpus.sparkSession
    usable = _usable(corpus)
    first = usable.select(F.size("embedding")).first()
    dimension = first[0] if first else 0
    n = usable.filter(F.size("embedding") == dimension).count()
    cells = min(MAX_CELLS, cells or max(1, round(n**0.5)))
    share = min(1.0, 1.1 * SAMPLE_ROWS / max(1, n))
    drawn = usable.filter((F.size("embedding") == dimension) & (F.pmod(F.xxhash64("chunk_id", F.lit("s")), F.lit(1 << 30)) <= int(share * (1 << 30))))
    sample = unit_rows(drawn.select("embedding").limit(2 * SAMPLE_ROWS).toArrow()["embedding"], max(1, dimension))
    if n and not len(sample):
        sample = unit_rows(usable.limit(1).select("embedding").toArrow()["embedding"], dimension)
    centroids = train(sample, cells)
    own = nearest_cells(sample, centroids, 1)[0][:, 0] if len(sample) else np.zeros(0, int)
    held = np.bincount(own, minlength=len(centroids)) * (n / max(1, len(sample)))
    parts = np.maximum(1, np.ceil(held / part_rows)).astype(int)
    if len(centroids):
        _write_rows(_coded(corpus, centroids, columns), parts, path, "overwrite")
    settings = (probes_for(sample, centroids) if len(centroids) else 0, version, ",".join(columns))
    table = [(c, x.tolist(), int(p), *settings) for c, (x, p) in enumerate(zip(centroids, parts, strict=True))]
    schema = "cell int, centroid array<double>, parts int, probes int, version string, columns string"
    spark.createDataFrame(table or [(-1, [], 0, *settings)], schema).write.mode("overwrite").parquet(f"{path}/cells")
    if not len(centroids):
        empty = corpus.select("chunk_id", *columns).limit(0)
        empty.selectExpr("*", "0 AS part", "X'' AS code", "0F AS step", "0F AS error", "0 AS cell").write.mode("overwrite").parquet(f"{path}/rows")


def read_index(spark: SparkSession, path: str, version: str | None = None) -> VectorIndex:
    """A written index; one of another ``version`` of the vectors is refused."""
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # MAX_CELLS rows
    if version is not None and cells[0]["version"] != version:
        raise ValueError(f"the index is of vectors {cells[0]['version']!r}, not of {version!r}; build it again")
    columns = tuple(c for c in cells[0]["columns"].split(",") if c)
    probes = cells[0]["probes"]
    cells = [r for r in cells if r["cell"] >= 0]
    centroids = np.array([r["centroid"] for r in cells], np.float64) if cells else np.zeros((0, 0))
    return VectorIndex(spark.read.parquet(f"{path}/rows"), centroids, np.array([r["parts"] for r in cells], int), probes, columns)


def add_vectors(index: VectorIndex, corpus: DataFrame, path: str) -> None:
    """Append the rows of ``corpus`` whose chunk_id the index does not hold; the centroids stay."""
    known = index.rows.select("chunk_id")
    fresh = corpus.join(known, "chunk_id", "left_anti").dropDuplicates(["chunk_id"])
    _write_rows(_coded(fresh, index.centroids, index.columns), index.parts, path, "append")


class _Best:
    """For one query, the rows that may be among its best ``k``, by bounds of their scores."""

    def __init__(self, k: int):
        self.k, self.ids, self.low, self.high, self.floor = k, [], [], [], -np.inf

    def add(self, ids: np.ndarray, score: np.ndarray, error: np.ndarray) -> None:
        may = score + error >= self.floor
        if may.any():
            self.ids.append(ids[may])
            self.low.append((score - error)[may])
            self.high.append((score + error)[may])
            if sum(map(len, self.ids)) > 8 * self.k:
                self.cut()

    def cut(self) -> None:
        ids, low, high = (np.concatenate(x) for x in (self.ids, self.low, self.high))
        if len(low) > self.k:
            self.floor = max(self.floor, np.partition(low, len(low) - self.k)[len(low) - self.k])
            may = high >= self.floor
            ids, low, high = ids[may], low[may], high[may]
        self.ids, self.low, self.high = [ids], [low], [high]


def _scan(best: dict[int, _Best], table: pa.RecordBatch | pa.Table, cell: int, of: np.ndarray, queries: np.ndarray, centroid: np.ndarray, k: int) -> None:
    """Compare the rows of one cell with the queries numbered ``of``."""
    ids = table["chunk_id"].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table["chunk_id"].to_numpy()
    code = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(len(ids), -1)
    step, error = (np.asarray(table[c].to_numpy(), np.float64) for c in ("step", "error"))
    rows = code * step[:, None]
    rows += centroid
    for a in range(0, len(of), TILE):
        tile = of[a : a + TILE]
        scores = rows @ queries[tile].T
        for j, q in enumerate(tile.tolist()):
            best.setdefault(q, _Best(k)).add(ids, scores[:, j], error)


def _found(best: dict[int, _Best], query_ids: list, schema: pa.Schema) -> pa.RecordBatch:
    for b in best.values():
        b.cut()
    columns: list[list] = [[], [], [], []]
    for q, b in best.items():
        columns[0] += [query_ids[q]] * len(b.ids[0])
        columns[1] += b.ids[0].tolist()
        columns[2] += b.low[0].tolist()
        columns[3] += b.high[0].tolist()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}[kind]


def candidates(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, where: dict[str, Any] | None = None) -> DataFrame:
    """(query_id, chunk_id, low, high): rows of the probed cells that may be among the best ``k``, with bounds of their cosine."""
    dimension = index.centroids.shape[1] if index.cells else 0
    probes = max(1, min(index.probes if probes is None else probes, index.cells))
    condition = compile_where(where)
    rows = index.rows if condition is None else index.rows.filter(condition)
    rows = rows.select("cell", "part", "chunk_id", "code", "step", "error")
    wanted = queries.select("query_id", "embedding")
    wanted = _usable(wanted, dimension)
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", rows.schema["chunk_id"].dataType),
            T.StructField("low", T.DoubleType()),
            T.StructField("high", T.DoubleType()),
        ]
    )
    if not index.cells:
        return queries.sparkSession.createDataFrame([], schema)
    if is_small(wanted, max_rows=MAX_QUERIES):
        found = _by_shared_queries(index, rows, wanted, k, probes, schema)
    else:
        found = _by_routed_queries(index, rows, wanted, k, probes, schema)
    # What cannot beat the k-th best of all tasks goes.
    order = Window.partitionBy("query_id").orderBy(F.col("low").desc())
    ranked = found.withColumn("place", F.row_number().over(order))
    floor = F.max(F.when(F.col("place") == k, F.col("low"))).over(Window.partitionBy("query_id"))
    return ranked.withColumn("floor", F.coalesce(floor, F.lit(-2.0))).filter("high >= floor").drop("place", "floor")


def _by_shared_queries(index: VectorIndex, rows: DataFrame, wanted: DataFrame, k: int, probes: int, schema: T.StructType) -> DataFrame:
    """Every task holds the measured queries and reads rows of probed cells; nothing of the index moves."""
    table = wanted.toArrow()
    query_ids = table["query_id"].to_pylist()
    dimension = index.centroids.shape[1]
    matrix = unit_rows(table["embedding"], dimension)
    cells = nearest_cells(matrix, index.centroids, probes)[0]
    of_cell = {c: np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells).tolist()}
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, matrix, of_cell, index.centroids))
    arrow_schema = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, wanted_of, centroids = shared.value
        best: dict[int, _Best] = {}
        for batch in batches:
            own = batch["cell"].to_numpy()
            edges = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                cell = int(own[a])
                if cell in wanted_of:
                    _scan(best, batch.slice(a, b - a), cell, wanted_of[cell], queries, centroids[cell], k)
        if best:
            yield _found(best, names, arrow_schema)

    probed = rows.filter(F.col("cell").isin(list(of_cell))) if of_cell else rows.limit(0)
    return probed.mapInArrow(run, schema)


def _by_routed_queries(index: VectorIndex, rows: DataFrame, wanted: DataFrame, k: int, probes: int, schema: T.StructType) -> DataFrame:
    """Queries beyond what a task may hold: each goes to the parts of its own cells.

    A part has a bounded number of rows.  A cell that very many queries probe is met by
    blocks of them, so a group is bounded on both sides.
    """
    centroids, parts, dimension = index.centroids, index.parts, index.centroids.shape[1]
    routed_schema = T.StructType([*wanted.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = nearest_cells(unit_rows(batch["embedding"], dimension), centroids, probes)[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    routed = wanted.mapInArrow(route, routed_schema).select("query_id", "embedding", F.explode("cells").alias("cell"))
    asked = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MAX_CELLS rows
    blocks = [max(1, -(-2 * asked.get(c, 0) // MAX_QUERIES)) for c in range(index.cells)]

    def of_cell(values) -> Column:
        return F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("cell") + 1)

    left = routed.withColumn("block", F.pmod(F.xxhash64("query_id"), of_cell(blocks)).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), of_cell(parts) - 1)))
    right = rows.filter(F.col("cell").isin(list(asked))) if asked else rows.limit(0)
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), of_cell(blocks) - 1)))
    arrow_schema = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema])

    def compare(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return pa.Table.from_batches([], arrow_schema)
        cell, best = held["cell"][0].as_py(), {}
        queries = unit_rows(asking["embedding"], dimension)
        _scan(best, held, cell, np.arange(len(queries)), queries, centroids[cell], k)
        return pa.Table.from_batches([_found(best, asking["query_id"].to_pylist(), arrow_schema)])

    keys = ["cell", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)


def cosine(a: str, b: str) -> Column:
    """Cosine of two vector columns in double precision; 0 beside a zero vector."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    dot = F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)
    length = [F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))) for c in (a, b)]
    return F.coalesce(F.try_divide(dot, length[0] * length[1]), F.lit(0.0))


def search(
    index: VectorIndex,
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 50,
    probes: int | None = None,
    where: dict[str, Any] | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, rank) as ``vectors.search``, from the probed cells.

    ``probes`` cells per query, by default as many as the sample needed for a recall of
    TARGET; with all of them the result is that of the exact search.  ``corpus`` gives the vectors of the few candidates, whose
    cosines are exact.  ``where`` filters rows of the index before they are compared.
    """
    found = candidates(index, queries, k, probes or index.probes, where).select("query_id", "chunk_id")
    vectors = corpus.select("chunk_id", F.col("embedding").alias("_row"))
    asked = queries.select("query_id", F.col("embedding").alias("_query"))
    scored = vectors.join(broadcast_if_small(found), "chunk_id").join(broadcast_if_small(asked), "query_id")
    return top_k(scored.select("query_id", "chunk_id", cosine("_row", "_query").alias("score")), k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of each query's exact best ``k`` that ``found`` holds."""
    best = exact.filter(F.col("rank") <= k).select("query_id", "chunk_id")
    held = found.filter(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return best.join(held, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))

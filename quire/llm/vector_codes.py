"""Vector code compression: product codes, their codebooks by member-resident Lloyd rounds.

Each vector is cut into parts.  A part lives in the partition of its owner, which is a
position, an entry of that position's codebook, and a salt where the entry has many
members.  In a round every part finds its nearest entry where it lives; only parts whose
entry changes migrate, in one shuffle, to a partition of their new owner; then the owners
add up the members that reside with them.  Parts that keep their entry never move, and
nothing else leaves a partition but one sum for each of its entries.

Codebooks are small whatever the data, ``entries`` times the length of a vector; they
are all that the driver sees.  All arithmetic is on whole numbers, so results do not
depend on the partitions.  Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import cut, shared_folder, stored
from quire.llm.words import mix
from quire.session import broadcast_if_small

POSITIONS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 24  # of a scaled component; beyond it counts as this
BLOCK = 4_096  # parts that one step compares with a codebook
SHARES = 8  # an owner holds at most about this share of a partition


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int = SCALE) -> DataFrame:
    """``row, vec_id, label, ints`` of the kept vectors; ``row`` is a number of each row's own.

    Written once, so that the numbers are the same when a task runs again.
    """
    x = F.col(embedding).cast("array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    top = F.lit(float(LARGEST))
    ints = F.transform(x, lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v, top), -top) * scale).cast("double"), top), -top).cast("int"))
    own = F.col(label) if label in vectors.columns else F.lit(None).cast("int")
    kept = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), own.alias("label"), ints.alias("ints"))
    return stored(kept.select(F.monotonically_increasing_id().alias("row"), "*"))


def _parts(vectors: np.ndarray, positions: int) -> np.ndarray:
    """(position, vector, component); the last part is filled up with zeros."""
    width = -(-vectors.shape[1] // positions)
    full = np.zeros((len(vectors), width * positions), np.int64)
    full[:, : vectors.shape[1]] = vectors
    return full.reshape(len(vectors), positions, width).transpose(1, 0, 2)


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of ``book`` nearest to each row of ``values`` and its squared distance, exactly; ties to the lower entry."""
    entry, error = np.empty(len(values), np.int32), np.empty(len(values), np.int64)
    for a in range(0, len(values), BLOCK):
        x = values[a : a + BLOCK].astype(np.int64)
        most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
        if 4 * float(most) ** 2 * book.shape[1] < 2**53:  # whole numbers that doubles hold exactly
            y, c = x.astype(np.float64), book.astype(np.float64)
            far = ((y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)).astype(np.int64)
        else:
            far = np.stack([((x - c) ** 2).sum(1) for c in book], axis=1)
        entry[a : a + BLOCK] = far.argmin(1)
        error[a : a + BLOCK] = far.min(1)
    return entry, error


def owner_number(owner: tuple[int, int, int]) -> int:
    """A spread number for (position, entry, salt), the same in every process."""
    position, entry, salt = owner
    return int(mix(np.array([(salt << 20) + (position << 10) + entry + 1], np.uint64))[0] >> np.uint64(1))


def _by_entry(position: int, rows: np.ndarray, values: np.ndarray, entry: np.ndarray):
    """((position, entry), (rows, values)) of the parts of each entry."""
    order = np.argsort(entry, kind="stable")
    edges = np.flatnonzero(np.diff(entry[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = order[a:b]
        yield (position, int(entry[at[0]])), (rows[at], values[at])


def first_parts(kept: DataFrame, books: np.ndarray, length: int) -> RDD:
    """((position, entry), (rows, values)) of all parts, where their vectors are read."""
    positions = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            # flatten() and not values: a slice of a batch shares the values of the whole.
            vectors = batch.column(1).flatten().to_numpy().reshape(-1, length)
            out = []
            for position, part in enumerate(_parts(vectors, positions)):
                entry, _ = nearest(part, books[position])
                out += [(*key, own.tobytes(), values.astype(np.int32).tobytes()) for key, (own, values) in _by_entry(position, rows, part, entry)]
            columns = [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["position", "entry", "rows", "vals"])

    blocks = kept.select("row", "ints").mapInArrow(run, "position int, entry int, rows binary, vals binary")

    def unpack(row):
        rows = np.frombuffer(row[2], np.int64)
        return (row[0], row[1]), (rows, np.frombuffer(row[3], np.int32).reshape(len(rows), -1))

    return blocks.rdd.map(unpack)


def _salts(found: dict[tuple[int, int], int], partitions: int, total: int) -> dict[tuple[int, int], int]:
    """Into how many owners the parts that go to each entry are dealt."""
    share = max(1, total // (partitions * SHARES))
    return {key: min(partitions * SHARES, -(-n // share)) for key, n in found.items()}


def migrate(parts: RDD, salts: dict[tuple[int, int], int], partitions: int) -> RDD:
    """((position, entry, salt), (rows, values)), each in the partition of its owner."""

    def deal(block):
        (position, entry), (rows, values) = block
        salt = (mix(rows.astype(np.uint64)) % np.uint64(salts.get((position, entry), 1))).astype(np.int64)
        return [((position, entry, s), own) for (_, s), own in _by_entry(position, rows, values, salt)]

    return parts.flatMap(deal).partitionBy(partitions, owner_number)


def judged(state: RDD, books: np.ndarray) -> RDD:
    """(owner, (rows, values), None) of what stays and ((position, entry), (rows, values), True) of what leaves."""

    def run(blocks):
        for owner, (rows, values) in blocks:
            position, now = owner[:2]
            entry, _ = nearest(values, books[position])
            stays = entry == now
            if stays.all():
                yield owner, (rows, values), None
                continue
            if stays.any():
                yield owner, (rows[stays], values[stays]), None
            for key, own in _by_entry(position, rows[~stays], values[~stays], entry[~stays]):
                yield key, own, True

    return state.mapPartitions(run, preservesPartitioning=True)


def sums_of_residents(state: RDD, positions: int, entries: int, width: int) -> np.ndarray:
    """(position, entry, component) sums of the members, the number of members last."""

    def add_up(blocks):
        total: dict[tuple[int, int], np.ndarray] = {}
        for (position, entry, _), (_, values) in blocks:
            own = total.setdefault((position, entry), np.zeros(width + 1, np.int64))
            own[:width] += values.sum(0, dtype=np.int64)
            own[width] += len(values)
        return total.items()

    out = np.zeros((positions, entries, width + 1), np.int64)
    for (position, entry), own in state.mapPartitions(add_up).reduceByKey(np.add).collect():  # one row per entry
        out[position, entry] = own
    return out


def _kept(rdd: RDD) -> RDD:
    """``rdd`` computed once: cut in the shared folder, and held while the round works on it."""
    rdd.persist(StorageLevel.MEMORY_AND_DISK)
    rdd.checkpoint()
    return rdd


def encode_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positions: int = POSITIONS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, label, code, error`` for each kept row, codebooks by position, entry and component).

    Rows whose vector is null, empty or holds a null or a non-finite component are
    dropped, and those of another length than the kept vector of smallest id.  A length
    that ``positions`` does not divide is filled up with zeros.  Scaled components beyond
    LARGEST count as that.  Codebooks start from the kept vectors of smallest id; of one
    id the smaller vector comes first, null ids are last.  With fewer vectors than
    ``entries`` there are as many entries as vectors.  Repeated rows come out once each;
    a table without kept rows gives none.  ``entries`` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each position")
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, vec_id, embedding, label)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(1).collect()
    length = len(first[0]["ints"]) if first else positions
    kept = kept.filter(F.size("ints") == length)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    books = _parts(np.array([r["ints"] for r in start], np.int64).reshape(-1, length), positions)
    entries, width = books.shape[1:]
    schema = "row long, position int, entry int, error long"
    if not entries:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    total = positions * kept.count()
    parts = first_parts(kept, books, length)
    state = None
    for _ in range(rounds):
        if state is None:
            leaving, staying, moves = parts, None, None
            leaving = _kept(parts)
        else:
            moves = _kept(judged(state, books))
            leaving = moves.filter(lambda b: b[2]).map(lambda b: b[:2])
            staying = moves.mapPartitions(lambda bs: [b[:2] for b in bs if not b[2]], preservesPartitioning=True)
        found = leaving.map(lambda b: (b[0], len(b[1][0]))).reduceByKey(lambda a, b: a + b).collectAsMap()  # one per entry
        partitions = state.getNumPartitions() if state is not None else int(spark.conf.get("spark.sql.shuffle.partitions"))
        arrived = migrate(leaving, _salts(found, partitions, total), partitions)
        before, state = state, arrived if staying is None else staying.union(arrived)
        state = _kept(state)
        sums = sums_of_residents(state, positions, entries, width)
        used = sums[:, :, -1:] > 0
        books = np.where(used, sums[:, :, :-1] // np.maximum(sums[:, :, -1:], 1), books)
        for old in (before, moves, leaving if before is None else None):
            if old is not None:
                old.unpersist()
    if state is None:
        state = _kept(migrate(parts, {}, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def final(blocks):
        for (position, _, _), (rows, values) in blocks:
            entry, error = nearest(values, books[position])
            yield position, rows.tobytes(), entry.astype(np.int32).tobytes(), error.tobytes()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for position, rows, entry, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own),
                        pa.array(np.full(len(own), position, np.int32)),
                        pa.array(np.frombuffer(entry, np.int32)),
                        pa.array(np.frombuffer(error, np.int64)),
                    ],
                    ["row", "position", "entry", "error"],
                )

    blocks = spark.createDataFrame(state.mapPartitions(final), "position int, rows binary, entries binary, errors binary")
    coded = blocks.mapInArrow(spread, schema).groupBy("row").agg(
        F.sum("error").alias("error"),
        *(F.max(F.when(F.col("position") == p, F.col("entry"))).alias(f"entry_{p}") for p in range(positions)),
    )
    digits = [F.lpad(F.lower(F.hex(f"entry_{p}")), 2, "0") for p in range(positions)]
    coded = coded.select("row", F.concat(*digits).alias("code"), "error")
    return kept.select("row", "vec_id", "label").join(coded, "row").drop("row"), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by position, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``label_error`` beside each row of ``coded``: the errors of equal labels, nulls together, added up."""
    own = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    return coded.join(broadcast_if_small(cut(own)), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def _sql(rounds: int = ROUNDS, entries: int = ENTRIES, positions: int = POSITIONS) -> str:
    """The same in SQL: every distance of every round, one component a row."""
    distances = """SELECT a.r, a.p, min(CAST(d AS HUGEINT) * 256 + e) AS m FROM (
        SELECT a.r, a.p, b.e, sum((a.v - b.v) * (a.v - b.v)) AS d FROM comp a JOIN c{k} b ON a.p = b.p AND a.j = b.j
        GROUP BY a.r, a.p, b.e) a GROUP BY a.r, a.p"""
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({distances.format(k=k)})")
        steps.append(f"""c{k + 1} AS MATERIALIZED (
        SELECT c.p, c.e, c.j, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (
            SELECT x.p, a.m % 256 AS e, x.j, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v
            FROM comp x JOIN a{k} a ON x.r = a.r AND x.p = a.p GROUP BY ALL) n ON c.p = n.p AND c.e = n.e AND c.j = n.j)""")
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
               list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    comp AS MATERIALIZED (
        SELECT r, i // width AS p, i % width AS j, ints[i + 1] AS v
        FROM (SELECT r, ints, len(ints) // {positions} AS width, unnest(range(len(ints))) AS i FROM kept)),
    c0 AS MATERIALIZED (SELECT p, r AS e, j, v FROM comp WHERE r < {entries}),
    {", ".join(steps)},
    last AS MATERIALIZED ({distances.format(k=rounds)}),
    coded AS (
        SELECT r, string_agg(printf('%02x', CAST(m % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error
        FROM last GROUP BY r)
    SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) FROM c{rounds}) AS codebooks_sha256
    FROM coded JOIN kept k USING (r)
    """


@query("op12_vector_codes", _sql())
def op12(spark, sf_dir):
    coded, books = encode_vectors(table(spark, sf_dir, "embeddings"))
    out = with_label_errors(cut(coded))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

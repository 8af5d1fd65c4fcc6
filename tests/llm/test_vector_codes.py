import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.vector_codes import digest, encode_vectors, nearest, with_label_errors


def brute(rows, positions=4, entries=256, rounds=4):
    """Plain version on (vec_id, vector, label); vec_ids differ."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // positions
    parts = [[v[p * width : (p + 1) * width] for p in range(positions)] for _, v, _ in kept]
    books = [[list(x[p]) for x in parts[:entries]] for p in range(positions)]

    def assign(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for x in parts:
                members.setdefault(assign(x[p], book)[0], []).append(x[p])
            for e, own in members.items():
                book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, label = {}, {}
    for (i, _, y), x in zip(kept, parts, strict=True):
        best = [assign(x[p], books[p]) for p in range(positions)]
        out[i] = ("".join(f"{e:02x}" for e, _ in best), sum(d for _, d in best), y)
        label[y] = label.get(y, 0) + out[i][1]
    flat = ",".join(str(v) for book in books for c in book for v in c)
    return {i: (c, d, label[y]) for i, (c, d, y) in out.items()}, hashlib.sha256(flat.encode()).hexdigest()


def frame_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, 1, 2, "k") for i, v, y in rows], "vec_id long, embedding array<float>, label int, row long, position int, entry string").repartition(parts)


@pytest.mark.parametrize("entries, n", [(16, 300), (256, 40)])
def test_codes_against_plain_rounds(spark, entries, n):
    rng = np.random.default_rng(entries)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], int(i % 3) if i % 7 else None) for i in range(n)]
    # One vector held by very many rows, and rows that are dropped.
    rows += [(1000 + i, rows[5][1], 1) for i in range(200)]
    rows += [(-1, None, 0), (-2, [1.0, None, *[0.0] * 6], 0), (-3, [float("nan")] * 8, 0), (-4, [float("-inf")] * 8, 0)]
    coded, books = encode_vectors(frame_of(spark, rows), entries=entries)
    found = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in with_label_errors(coded).collect()}
    expected, sha = brute(rows, entries=entries)
    assert found == expected and digest(books) == sha


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(12)], 0) for i in range(150)]
    results = []
    for parts in (1, 6):
        coded, books = encode_vectors(frame_of(spark, rows, parts), entries=8)
        results.append((sorted(map(tuple, coded.collect())), digest(books)))
    assert results[0] == results[1]


def test_only_parts_that_change_entry_migrate(spark):
    from quire.llm import vector_codes as v

    kept = v.whole_vectors(frame_of(spark, [(i, [float(i % 5)] * 8, 0) for i in range(100)]), "vec_id", "embedding", "label")
    books = v._parts(np.array([[1024 * k] * 8 for k in range(5)]), 4)
    state = v.migrate(v.first_parts(kept, books, 8), {(p, 0): 3 for p in range(4)}, 4).persist()
    assert sum(len(b[1][0]) for b in state.collect()) == 400 and state.getNumPartitions() == 4
    assert not [b for b in v.judged(state, books).collect() if b[2]]
    books[2, 1] = 2048  # entry 2 of this position is now beaten by 1 on ties
    left = [b for b in v.judged(state, books).collect() if b[2]]
    assert {b[0] for b in left} == {(2, 1), (2, 0)} and sum(len(b[1][0]) for b in left) == 40
    both = state.union(v.migrate(state.filter(lambda b: False).map(lambda b: (b[0][:2], b[1])), {}, 4))
    assert both.getNumPartitions() == 4  # joined partition by partition


def test_large_numbers_are_exact():
    x = np.array([[1 << 24, -(1 << 24)], [(1 << 24) - 1, 3]])
    book = np.array([[-(1 << 24), 1 << 24], [1 << 24, 1 - (1 << 24)]])
    entry, error = nearest(x, book)
    plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in book] for r in x]
    assert entry.tolist() == [d.index(min(d)) for d in plain] and error.tolist() == [min(d) for d in plain]


def test_odd_tables(spark):
    empty = frame_of(spark, [])
    coded, books = encode_vectors(empty)
    assert coded.count() == 0 and books.shape[1] == 0 and digest(books) == hashlib.sha256(b"").hexdigest()
    # Repeated and null ids, another length, a length that 4 does not divide, no label.
    rows = [(1, [1.0, 2.0, 3.0], 0)] * 3 + [(None, [0.5, 0.5, 0.5], 1), (7, [1.0], 1), (8, [], 1), (9, [1e30, -1e30, 0.0], 1)]
    coded, books = encode_vectors(frame_of(spark, rows).drop("label"))
    found = coded.collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in found) == [(False, 1)] * 3 + [(False, 9), (True, 0)]
    assert books.shape == (4, 5, 1) and (books[3] == 0).all() and abs(books).max() == 1 << 24
    assert all(r["error"] == 0 and r["label"] is None and len(r["code"]) == 8 for r in found)
    assert with_label_errors(coded.withColumn("label", F.lit(None).cast("int"))).count() == 5

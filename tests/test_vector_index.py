"""The written vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import vector_index, vectors

DIMENSION = 12


def clustered(rows, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, DIMENSION))
    # A third of all rows around one centre.
    own = np.where(rng.random(rows) < 0.33, 0, rng.integers(0, 9, rows))
    return centres[own] + 0.3 * rng.normal(size=(rows, DIMENSION))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, [float(x) for x in v], i % 5, "keep") for i, v in enumerate(clustered(1500))]
    rows += [(9001, rows[3][1], 1, "copy"), (9002, [0.0] * DIMENSION, 1, "zero")]
    odd = [(9101, None, 1, "x"), (9102, [], 1, "x"), (9103, [float("nan")] * DIMENSION, 1, "x"), (9104, [1.0, None] * (DIMENSION // 2), 1, "x")]
    return spark.createDataFrame(rows + odd, "chunk_id long, embedding array<float>, label int, part string").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(clustered(40, seed=2))]
    return spark.createDataFrame([*rows, ("none", None), ("zero", [0.0] * DIMENSION)], "query_id string, embedding array<float>")


@pytest.fixture(scope="module")
def written(spark, corpus, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/vectors"
    vector_index.write_index(corpus, path, cells=16, columns=("label",), version="v1", part_rows=40)
    return path


def rows_of(frame):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in frame.collect())


def clean(corpus):
    return corpus.filter("chunk_id < 9100")


@pytest.mark.parametrize("shared", [True, False])
def test_all_cells_give_the_exact_rows(spark, corpus, queries, written, monkeypatch, shared):
    index = vector_index.read_index(spark, written, "v1")
    if not shared:
        monkeypatch.setattr(vector_index, "MAX_QUERIES", 10)
    found = vector_index.search(index, corpus, queries, 7, probes=index.cells)
    assert rows_of(found) == rows_of(vectors.search(clean(corpus), queries, 7))
    where = {"label": {"$in": [1, 3]}}
    found = vector_index.search(index, corpus, queries, 7, probes=index.cells, where=where)
    assert rows_of(found) == rows_of(vectors.search(clean(corpus), queries, 7, where))


@pytest.mark.parametrize("shared", [True, False])
def test_few_cells_reach_the_recall(spark, corpus, queries, written, monkeypatch, shared):
    index = vector_index.read_index(spark, written)
    assert index.probes < index.cells
    if not shared:
        monkeypatch.setattr(vector_index, "MAX_QUERIES", 10)
    asked = queries.filter("query_id <> 'zero'")
    found = vector_index.search(index, corpus, asked, 10)
    each = vector_index.recall(found, vectors.search(clean(corpus), asked, 10), 10).collect()
    assert len(each) == 40 and np.mean([r["recall"] for r in each]) >= 0.9


def test_search_reads_only_probed_folders_and_hot_cells_are_split(spark, corpus, queries, written):
    index = vector_index.read_index(spark, written)
    one = queries.filter("query_id = 'q1'")
    plan = vector_index.candidates(index, one, 5, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200]
    assert index.parts.max() > 2
    sizes = index.rows.groupBy("cell", "part").count().collect()
    assert max(r["count"] for r in sizes) < 100
    files = index.rows.select(F.input_file_name().alias("f"), "cell", "part").distinct().groupBy("cell", "part").count()
    assert files.filter("count > 1").count() == 0


def test_codes_bound_the_score(corpus):
    rows = vector_index.unit_rows(clean(corpus).select("embedding").toArrow()["embedding"], DIMENSION)
    centroids = vector_index.train(rows, 8)
    cell, code, step, error = vector_index.encode_rows(rows, centroids)
    again = centroids[cell] + code * step[:, None].astype(np.float64)
    queries = vector_index.unit_rows(clean(corpus).limit(50).select("embedding").toArrow()["embedding"], DIMENSION)
    assert (np.abs(queries @ rows.T - queries @ again.T) <= error[None, :] + 1e-9).all() and error.max() < 0.02
    assert set(cell.tolist()) == set(range(8))


def test_added_rows_are_found_and_versions_are_kept(spark, corpus, queries, tmp_path):
    path = f"{tmp_path}/v"
    clean_rows = clean(corpus).drop("part")
    vector_index.write_index(clean_rows.filter("chunk_id % 2 = 0"), path, cells=8, version="a")
    index = vector_index.read_index(spark, path, "a")
    vector_index.add_vectors(index, clean_rows, path)
    vector_index.add_vectors(vector_index.read_index(spark, path), clean_rows, path)  # again: nothing new
    index = vector_index.read_index(spark, path)
    assert index.rows.count() == clean_rows.count()
    found = vector_index.search(index, clean_rows, queries, 5, probes=index.cells)
    assert rows_of(found) == rows_of(vectors.search(clean_rows, queries, 5))
    with pytest.raises(ValueError):
        vector_index.read_index(spark, path, "b")


def test_search_plan_takes_the_index(spark, corpus, queries, written):
    from quire.plans.search import SearchConfig, hybrid_search

    index = vector_index.read_index(spark, written)
    config = SearchConfig(bm25_weight=0, hybrid_top_k=5, vector_probes=index.cells)
    found = hybrid_search(None, clean(corpus), queries, config, vectors_index=index)
    exact = hybrid_search(None, clean(corpus), queries, config)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))


def test_clashing_columns_are_refused(corpus, tmp_path):
    with pytest.raises(ValueError):
        vector_index.write_index(corpus, f"{tmp_path}/c", columns=("part",))


def test_empty_and_tiny_tables(spark, corpus, queries, tmp_path):
    nothing = corpus.limit(0)
    vector_index.write_index(nothing, f"{tmp_path}/e")
    assert vector_index.search(vector_index.read_index(spark, f"{tmp_path}/e"), nothing, queries, 3).collect() == []
    one = corpus.filter("chunk_id = 7")
    vector_index.write_index(one, f"{tmp_path}/o")
    found = vector_index.search(vector_index.read_index(spark, f"{tmp_path}/o"), one, queries, 3)
    assert rows_of(found) == rows_of(vectors.search(one, queries, 3))
    assert vector_index.search(vector_index.read_index(spark, f"{tmp_path}/o"), one, queries.limit(0), 3).collect() == []

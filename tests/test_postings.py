"""The index of blocks against plain BM25."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import bm25, postings


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(8)
    words = [a + b + c for a in "abcde" for b in "xyz" for c in "mnop"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([3, 8, 30, 120]))) for _ in range(1200)]
    texts += [texts[5]] * 40 + ["", "12 34", None, "The THE the " * 50]
    rows = [(f"c{(i * 7919) % 100_003:06d}", t, i % 3, "acl" if i % 2 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, chunk_text string, year int, venue string").repartition(6)


@pytest.fixture(scope="module")
def queries(spark):
    asked = ["axm bym czn", "exp", "the axm axm axm", "unknown", "", "dzo eyp cxn bzm axm", "axm bym czn exp dyn bxo ezn cyp"]
    return spark.createDataFrame(list(enumerate(asked)), "query_id int, query_text string")


@pytest.fixture(scope="module")
def written(spark, chunks, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('blocks')}/index"
    postings.write_blocks(chunks, path, columns=("year", "venue"), version="1", shard_chunks=300)
    return path


def rows_of(frame):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in frame.collect())


@pytest.mark.parametrize("k", [1, 10, 500])
def test_top_k_is_that_of_the_plain_index(spark, chunks, queries, written, k):
    index = postings.read_blocks(spark, written, "1")
    assert rows_of(postings.search(index, queries, k)) == rows_of(bm25.search(bm25.build_index(chunks), queries, k))


def test_filters_hold_while_blocks_are_read(spark, chunks, queries, written):
    index = postings.read_blocks(spark, written)
    scored = bm25.score(bm25.build_index(chunks), queries)
    for where, condition in [({"year": {"$gte": 1}}, "year >= 1"), ({"venue": "acl", "year": 2}, "venue = 'acl' AND year = 2"), ({"year": 9}, "year = 9")]:
        allowed = scored.join(chunks.filter(condition).select("chunk_id"), "chunk_id", "left_semi")
        assert rows_of(postings.search(index, queries, 8, where)) == rows_of(bm25.top_k(allowed, 8, decimals=None))


def test_many_queries_take_several_passes(spark, chunks, queries, written, monkeypatch):
    monkeypatch.setattr(postings, "MAX_QUERIES", 3)
    monkeypatch.setattr(postings, "MAX_PUSHED_TERMS", 2)
    index = postings.read_blocks(spark, written)
    assert rows_of(postings.search(index, queries, 5)) == rows_of(bm25.search(bm25.build_index(chunks), queries, 5))


def test_blocks_are_skipped_and_nothing_but_results_moves(spark, queries, written):
    index = postings.read_blocks(spark, written)
    told = {r["query_id"]: r for r in postings.block_statistics(index, queries, 1).collect()}
    assert all(r["read"] <= r["blocks"] for r in told.values())
    assert sum(r["read"] for r in told.values()) < 0.8 * sum(r["blocks"] for r in told.values())
    plan = postings.search(index, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "PushedFilters: [In(term" in plan.replace("Or(EqualTo(term,),", "In(term")
    assert "Exchange hashpartitioning(shard" not in plan and plan.count("Exchange") == 1


def test_shards_are_bounded_and_spread(spark, written):
    rows = postings.read_blocks(spark, written).postings
    sizes = [r["n"] for r in rows.filter("term = ''").select("n").collect()]
    assert len(sizes) >= 4 and max(sizes) < 450 and sum(sizes) == 1244
    files = rows.select(F.input_file_name().alias("f"), "shard").distinct()
    assert files.groupBy("shard").count().filter("count > 1").count() == 0
    assert files.groupBy("f").count().filter("count > 2").count() == 0


def test_vocabulary_versions_and_analyzers(spark, chunks, queries, written, tmp_path):
    plain = bm25.build_index(chunks)
    index = postings.read_blocks(spark, written)

    def words(frame):
        return {r["term"]: (r["df"], round(r["idf"], 9)) for r in frame.collect()}

    assert words(index.vocabulary) == words(plain.vocabulary)
    totals = plain.totals.first()
    assert index.chunks == totals["chunks"] and index.avg_length == pytest.approx(totals["avg_length"])
    with pytest.raises(ValueError):
        postings.read_blocks(spark, written, "2")
    postings.write_blocks(chunks, f"{tmp_path}/t", analyzer="treebank")
    other = postings.read_blocks(spark, f"{tmp_path}/t")
    assert rows_of(postings.search(other, queries, 4)) == rows_of(bm25.search(bm25.build_index(chunks, "treebank"), queries, 4))


def test_empty_tables(spark, chunks, queries, written, tmp_path):
    postings.write_blocks(chunks.limit(0), f"{tmp_path}/e")
    assert postings.search(postings.read_blocks(spark, f"{tmp_path}/e"), queries, 3).collect() == []
    assert postings.search(postings.read_blocks(spark, written), queries.limit(0), 3).collect() == []
    numbers = spark.createDataFrame([(3, "axm"), (1, "axm"), (2, None)], "chunk_id long, chunk_text string")
    postings.write_blocks(numbers, f"{tmp_path}/n")
    found = postings.search(postings.read_blocks(spark, f"{tmp_path}/n"), queries, 3)
    assert rows_of(found) == rows_of(bm25.search(bm25.build_index(numbers), queries, 3))


def test_search_plan_takes_blocks(spark, chunks, queries, written):
    from quire.plans.search import SearchConfig, hybrid_search

    config = SearchConfig(vector_weight=0, hybrid_top_k=6)
    where = {"year": {"$lte": 1}}
    found = hybrid_search(postings.read_blocks(spark, written), None, queries, config, where)
    plain = hybrid_search(bm25.build_index(chunks), None, queries, config, where, chunks)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_a_shard_is_built_in_little_more_than_its_words():
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    terms = [[f"word{(i * j) % 53}" for j in range(500)] for i in range(2_000)]
    shard = pa.table({"shard": pa.array([1] * 2_000, pa.int32()), "chunk_id": pa.array(range(2_000), pa.int64()), "terms": pa.array(terms, pa.list_(pa.string()))})
    schema = to_arrow_schema(postings._schema(T.LongType(), []))
    tracemalloc.start()  # of numpy, not of Arrow
    try:
        rows = postings._build_shard(shard, schema, [])
        taken = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows.num_rows == 54 and rows["n"].to_pylist()[0] == 2_000
    assert taken < 15 * 1_000_000  # bytes a word

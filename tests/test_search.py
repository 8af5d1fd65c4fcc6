"""BM25, vectors, fusion and the search plan."""

import math
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.operators import bm25, fusion, vectors
from quire.plans.answers import NO_CONTEXT, UNAVAILABLE_ANSWER, Generation, RateLimited, WithFallback, answer, context_blocks
from quire.plans.search import SearchConfig, search


def okapi(texts, query, k1=1.5, b=0.75, epsilon=0.25):
    docs = {i: re.findall(r"[^\W\d_]+", t.lower()) for i, t in texts.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf)
    idf = {t: floor if w < 0 else w for t, w in idf.items()}
    scores = {}
    for i, d in docs.items():
        tf = Counter(d)
        total = sum(
            idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / avg))
            for t in re.findall(r"[^\W\d_]+", query.lower())
        )
        if total > 0:
            scores[i] = total
    return scores


def questions(spark, rows):
    return spark.createDataFrame(rows, "query_id int, query_text string, embedding array<float>")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [a + b for a in "abcdefgh" for b in "xyz"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    made = {i: " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 40))) for i in range(60)}
    made[60] = made[3]
    made[61] = "12 34"
    return made


def test_bm25_matches_formula(spark, texts):
    index = bm25.build_index(spark.createDataFrame(list(texts.items()), "chunk_id bigint, chunk_text string"))
    asked = [(1, "ax by by cz"), (2, "hz gz unknown"), (3, "???")]
    queries = spark.createDataFrame(asked, "query_id int, query_text string")
    got = {}
    for r in bm25.score(index, queries).collect():
        got.setdefault(r["query_id"], {})[r["chunk_id"]] = r["score"]
    for number, query in asked:
        assert got.get(number, {}) == pytest.approx(okapi(texts, query), abs=1e-7)
    ranked = bm25.search(index, queries, 5).filter("query_id = 1").orderBy("rank").collect()
    want = sorted(okapi(texts, asked[0][1]).items(), key=lambda p: (-round(p[1], 7), p[0]))[:5]
    assert [r["chunk_id"] for r in ranked] == [i for i, _ in want]


def test_bm25_shuffled_path_agrees(spark, texts, monkeypatch):
    index = bm25.build_index(spark.createDataFrame(list(texts.items()), "chunk_id bigint, chunk_text string"))
    queries = spark.createDataFrame([(1, "ax by"), (2, "cx")], "query_id int, query_text string")
    small = bm25.search(index, queries, 10).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(bm25, "is_small", lambda *a, **k: False)
    assert [(r[0], r[1], round(r[2], 9)) for r in bm25.search(index, queries, 10).orderBy("query_id", "rank").collect()] == [
        (r[0], r[1], round(r[2], 9)) for r in small
    ]


def test_written_index_gives_the_same(spark, texts, tmp_path):
    index = bm25.build_index(spark.createDataFrame(list(texts.items()), "chunk_id bigint, chunk_text string"))
    bm25.write_index(index, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "ax by by")], "query_id int, query_text string")
    key = lambda rows: sorted((r["chunk_id"], round(r["score"], 9)) for r in rows)
    loaded = bm25.read_index(spark, str(tmp_path / "index"))
    assert key(bm25.search(loaded, queries).collect()) == key(bm25.search(index, queries).collect())


def test_empty_corpus(spark):
    index = bm25.build_index(spark.createDataFrame([], "chunk_id bigint, chunk_text string"))
    assert index.totals.first()["chunks"] == 0
    assert bm25.search(index, spark.createDataFrame([(1, "a")], "query_id int, query_text string")).count() == 0


def test_expected_best_chunk(spark, chunks):
    index = bm25.build_index(chunks, id_column="id")
    queries = spark.createDataFrame([(1, "novel transformer architecture")], "query_id int, query_text string")
    assert bm25.search(index, queries).first()["chunk_id"] == 1


def brute(corpus, queries, k):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    return {
        q: [i for _, i in sorted((-round(float(unit(v) @ unit(e)), 9), i) for i, e in corpus)[:k]] for q, v in queries
    }


def test_vectors_both_paths(spark, monkeypatch):
    rng = np.random.default_rng(1)
    corpus = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(300)]
    corpus += [(1000 + i, corpus[i][1]) for i in range(40)]
    queries = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(7)]
    table = spark.createDataFrame(corpus, "chunk_id bigint, embedding array<float>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id int, embedding array<float>")

    def ranked():
        found = {}
        for r in vectors.search(table, asked, 12).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["chunk_id"])
        return found

    assert ranked() == brute(corpus, queries, 12)
    monkeypatch.setattr(vectors, "is_small", lambda *a, **k: False)
    monkeypatch.setattr(vectors, "MAX_QUERIES", 3)
    monkeypatch.setattr(vectors, "CELL_ROWS", 50)
    assert ranked() == brute(corpus, queries, 12)


def test_vector_filters(spark, embeddings):
    asked = spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "query_id int, embedding array<float>")
    ids = lambda where: [r["chunk_id"] for r in vectors.search(embeddings, asked, 9, where).orderBy("rank").collect()]
    assert ids(None) == [2, 3, 1, 4]
    assert ids({"year": {"$gte": 2019, "$lte": 2020}}) == [2, 3]
    assert ids(vectors.search_filter("acl", 2019, 2022)) == [4]
    assert ids({"$and": [{"venue": "acl"}, {"year": {"$lte": 2018}}]}) == [1]
    with pytest.raises(ValueError):
        vectors.compile_where({"year": {"$near": 1}})


def test_encode_is_unit_length(spark):
    frame = spark.createDataFrame([("abc",), ("",)], "t string")
    rows = vectors.encode(frame, "t", lambda texts: np.array([[len(t), 4.0] for t in texts])).collect()
    assert rows[0]["embedding"] == pytest.approx([0.6, 0.8]) and rows[1]["embedding"] == pytest.approx([0, 1])
    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "e array<float>").select(vectors.normalize(F.col("e")).alias("n"))
    assert [r["n"] for r in got.collect()] == [pytest.approx([0.6, 0.8]), [0, 0]]


def lists(spark, *ids):
    return [spark.createDataFrame([(1, c, r) for r, c in enumerate(l, 1)], "query_id int, chunk_id bigint, rank int") for l in ids]


def test_rrf(spark):
    a, b = lists(spark, [1, 2, 3], [2, 4])
    got = {r["chunk_id"]: r["rrf_score"] for r in fusion.fuse([(a, 1), (b, 1)]).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 63, 4: 1 / 62})
    order = [r["chunk_id"] for r in fusion.fuse([(a, 1), (b, 1)]).orderBy("rank").collect()]
    assert order == [2, 1, 4, 3]
    tied_first, tied_second = lists(spark, [9], [5])
    assert [r["chunk_id"] for r in fusion.fuse([(tied_first, 1), (tied_second, 1)]).orderBy("rank").collect()] == [9, 5]
    weighted = {r["chunk_id"]: r["rrf_score"] for r in fusion.fuse([(a, 3), (b, 0)]).collect()}
    assert weighted == pytest.approx({1: 3 / 61, 2: 3 / 62, 3: 3 / 63})
    with pytest.raises(ValueError):
        fusion.fuse([(a, 0)])


def test_search_plan(spark, chunks, embeddings):
    table = chunks.withColumnRenamed("id", "chunk_id").withColumns(
        {"title": F.lit("T"), "venue": F.lit(None).cast("string"), "year": F.lit(None).cast("int")}
    ).filter("chunk_id <> 3")
    index = bm25.build_index(chunks, id_column="id")
    asked = questions(spark, [(1, "sentence embeddings", [0.0, 1.0, 0.0]), (2, "zzz", [0.0, 0.0, 1.0])])
    plain = search(index, embeddings, table, asked).orderBy("query_id", "rank").collect()
    # Chunk 3 is in both lists but not in the table.
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in plain] == [
        (1, 2, 1), (1, 1, 2), (1, 4, 3), (2, 4, 1), (2, 1, 2), (2, 2, 3),
    ]
    reranked = search(index, embeddings, table, asked, SearchConfig(), fusion.pair_scorer(lambda p: np.array([len(t) for _, t in p], float)), 1)
    assert {r["query_id"]: r["chunk_id"] for r in reranked.collect()} == {1: 1, 2: 1}
    sparse = search(index, embeddings, table, asked.drop("embedding"), SearchConfig(vector_weight=0))
    assert [r["chunk_id"] for r in sparse.collect()] == [2]
    dense = search(index, embeddings, table, asked.drop("query_text"), SearchConfig(bm25_weight=0), top_k=1)
    assert {r["query_id"]: r["chunk_id"] for r in dense.collect()} == {1: 2, 2: 4}
    only = search(index, embeddings, table, asked, where={"venue": "acl"}, metadata=embeddings.select("chunk_id", "venue"))
    assert {r["chunk_id"] for r in only.collect()} <= {1, 4}


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Stub:
    name = "stub"

    def __init__(self, fail=None, name="stub"):
        self.fail, self.name = fail, name

    def is_available(self):
        return True

    def generate(self, prompt, system_prompt=None, max_tokens=1024, temperature=0.1):
        if self.fail is not None:
            raise self.fail
        return Generation(f"{len(prompt)} characters", self.name)


def test_answers(spark):
    results = spark.createDataFrame(
        [(1, i, f"p{i % 3}", f"T{i}", "text", "" if i == 1 else "acl", None if i == 2 else 2020, i) for i in range(1, 8)],
        "query_id int, chunk_id int, paper_id string, title string, chunk_text string, venue string, year int, rank int",
    )
    asked = spark.createDataFrame([(1, "why?"), (2, "who?")], "query_id int, query_text string")
    blocks = {r["query_id"]: r["context"] for r in context_blocks(results, asked, 2).collect()}
    assert blocks[1] == '[1] "T1" (unknown venue, 2020)\ntext\n\n---\n\n[2] "T2" (acl, None)\ntext'
    assert blocks[2] == NO_CONTEXT
    replies, sources = answer(results, asked, Stub(), 2)
    assert {r["model"] for r in replies.collect()} == {"stub"}
    assert [(r["paper_id"], r["rank"], r["used_in_answer"]) for r in sources.orderBy("rank").collect()] == [
        ("p1", 1, True), ("p2", 2, True), ("p0", 3, False),
    ]
    failed, _ = answer(results, asked, Stub(ValueError("down")))
    assert {r["answer"] for r in failed.collect()} == {UNAVAILABLE_ANSWER}


def test_fallback_backend():
    backend = WithFallback(Stub(RateLimited("slow")), Stub(name="second"), retries=1, wait_seconds=0)
    assert backend.generate("x").model == "second" and backend.fell_back and backend.name == "second"
    with pytest.raises(ValueError):
        WithFallback(Stub(ValueError("bad")), Stub()).generate("x")


def test_tasks_of_a_search_grow_in_number_with_chunks_and_queries(spark, monkeypatch):
    def planned(chunks, queries):
        texts = spark.range(chunks).select(F.col("id").alias("chunk_id"), F.concat(F.lit("word more"), F.col("id") % 7).alias("chunk_text"))
        asked = spark.range(queries).select(F.col("id").alias("query_id"), F.lit("word more").alias("query_text"))
        scored = bm25.score(bm25.build_index(texts), asked)
        found = re.findall(r"chunk_id#\d+L, (\d+)\), REPARTITION_BY_NUM", scored._jdf.queryExecution().executedPlan().toString())
        return int(found[0]) if found else None, scored

    assert planned(100, 10)[0] is None  # adaptive execution cuts small searches
    assert planned(100_000, 500)[0] == 26  # before: a task for each core
    assert planned(200_000, 500)[0] == 51
    few = {tuple(r) for r in planned(300, 5)[1].collect()}
    monkeypatch.setattr(bm25, "TASK_ROWS", 100)
    number, scored = planned(300, 5)
    assert number == 21 and {tuple(r) for r in scored.collect()} == few


def test_tasks_of_an_index_write_grow_in_number_with_the_tokens(spark, monkeypatch, tmp_path):
    texts = spark.range(1500).select(F.col("id").alias("chunk_id"), F.concat(F.lit("word more w"), F.col("id") % 7).alias("chunk_text"))

    def written(path):
        bm25.write_index(bm25.build_index(texts), path)
        index = bm25.read_index(spark, path)
        tasks = {name.name.split("-")[1] for name in tmp_path.rglob(f"{path.rsplit('/', 1)[1]}/postings/*/part-*")}
        return len(tasks), *({tuple(r) for r in x.collect()} for x in (index.occurrences, index.vocabulary, index.totals))

    few = written(f"{tmp_path}/few")
    monkeypatch.setattr(bm25, "TASK_ROWS", 100)
    many = written(f"{tmp_path}/many")
    assert many[1:] == few[1:]
    assert few[0] <= spark.sparkContext.defaultParallelism and many[0] >= 30  # 4,500 rows; before: as many tasks in both

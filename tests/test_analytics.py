"""Counts, pairs, browsing and the corpus interface on a small corpus."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire import Corpus
from quire.operators import pairs
from quire.plans.answers import Generation


@pytest.fixture(scope="module")
def corpus(papers, authors, entities, chunks, embeddings):
    return Corpus(papers, authors, entities, chunks, embeddings)


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_counts(corpus):
    assert tuples(corpus.health()) == [(4, 4, 4)]
    assert tuples(corpus.venues_total()) == [("acl", 2), ("emnlp", 1)]
    assert tuples(corpus.venues())[0] == (None, None, 1)
    assert tuples(corpus.growth()) == [(None, 1, None, None), (2018, 1, 1, 0.0), (2019, 1, 1, 0.0), (2022, 1, 1, 0.0)]
    stats = corpus.stats().first().asDict()
    assert stats == {
        "total_papers": 4, "total_methods": 4, "total_datasets": 2, "total_tasks": 2, "total_topics": 2, "papers_with_methods": 3,
    }


def test_trends(corpus):
    assert tuples(corpus.trend("methods", "bert")) == [(2018, 1), (2019, 1)]
    assert [r["rank"] for r in corpus.top("methods", 1).filter("year = 2019").collect()] == [1, 1]
    assert tuples(corpus.list("datasets", 1)) == [("SQuAD", 2)]
    both = tuples(corpus.compare_trends({"bert": ("methods", "bert"), "mt": ("tasks", "translation")}))
    assert both == [(2018, 1, 1), (2019, 1, None)]
    assert tuples(corpus.venue_profile("acl"))[0] == ("BERT", 1)
    for bad in (lambda: corpus.trend("tools", "x"), lambda: corpus.top("methods", 101), lambda: corpus.list("methods", 0)):
        with pytest.raises(ValueError):
            bad()


def test_pairs_of_fixture(corpus):
    assert tuples(corpus.cooccurrence(top_n=1)) == [("BERT", "SQuAD", 2)]
    assert tuples(corpus.author_pairs()) == [("Ann Lee", "Zed Ott", 2)]
    assert tuples(corpus.top_authors(1)) == [("Ann Lee", 3)]


def test_pairs_with_hot_paper_and_duplicates(spark):
    rng = random.Random(11)
    rows = [("hot", f"m{i}") for i in range(200)] + [("hot", "m1")] * 50
    for p in range(60):
        rows += [(f"p{p}", f"m{min(int(rng.expovariate(0.2)), 150)}") for _ in range(rng.randrange(1, 6))]
    right = [("hot", f"d{i}") for i in range(80)] + [(f"p{p}", f"d{rng.randrange(12)}") for p in range(60) for _ in range(2)]
    frame = [(p, "method", n, None) for p, n in rows] + [(p, "dataset", n, None) for p, n in right]
    entities = spark.createDataFrame(frame, "paper_id string, entity_type string, name string, attr string")
    by_paper = {}
    for p, n in right:
        by_paper.setdefault(p, []).append(n)
    count = Counter((m, d) for p, m in rows for d in by_paper.get(p, []))
    want = sorted(((m, d, c) for (m, d), c in count.items()), key=lambda t: (-t[2], t[0], t[1]))[:15]
    assert tuples(pairs.entity_cooccurrence(entities, "methods", "datasets", 15)) == want

    authors = spark.createDataFrame([(p, n, 0) for p, n in rows], "paper_id string, name string, position int")
    names = {}
    for p, n in rows:
        names.setdefault(p, set()).add(n)
    shared = Counter((a, b) for s in names.values() for a in s for b in s if a < b)
    want = sorted(((a, b, c) for (a, b), c in shared.items()), key=lambda t: (-t[2], t[0], t[1]))[:15]
    assert tuples(pairs.author_pairs(authors, 15)) == want
    assert len(tuples(pairs.author_pairs(authors.filter("paper_id = 'p1'"), 15))) <= 15


def test_one_paper_with_very_many_names_is_many_keys(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("hot", f"a{i:03d}") for i in range(300)] + [(f"p{p}", f"a{rng.randrange(300):03d}") for p in range(40) for _ in range(3)]
    authors = spark.createDataFrame([(p, n, 0) for p, n in rows], "paper_id string, name string, position int")
    names = {}
    for p, n in rows:
        names.setdefault(p, set()).add(n)
    shared = Counter((a, b) for s in names.values() for a in s for b in s if a < b)
    want = sorted(((a, b, c) for (a, b), c in shared.items()), key=lambda t: (-t[2], t[0], t[1]))
    monkeypatch.setattr(pairs, "BLOCK_NAMES", 40)
    monkeypatch.setattr(pairs, "SEED_NAMES", 2)
    assert tuples(pairs.author_pairs(authors, len(want))) == want
    once = pairs._multiplicity(authors)
    hot = pairs._blocks(once, once)
    assert [tuple(r) for r in hot.collect()] == [("hot", 8, 8)]
    plan = pairs._pair_counts(once, once, None, hot)._jdf.queryExecution().optimizedPlan().toString()
    assert "left#" in plan and "right#" in plan


def test_browse(corpus):
    rows = corpus.browse(page_size=2).collect()
    assert [r["id"] for r in rows] == ["t::2022.acl-long.100", "s::D19-1234"]
    assert rows[0]["authors"] == ["Ann Lee", "Zed Ott"]
    second = corpus.browse(page=2, page_size=2).collect()
    assert [(r["id"], r["authors"]) for r in second] == [("s::P18-1001", ["Zed Ott", "Ann Lee"]), ("t::2022.acl-long.101", [])]
    found = corpus.browse(method="bert", author="ott", venue="acl").collect()
    assert [r["id"] for r in found] == ["s::P18-1001"]
    assert tuples(corpus.count(method="bert", year=0, venue="")) == [(2, 1)]
    with pytest.raises(ValueError):
        corpus.browse(page_size=101)
    assert [r["id"] for r in corpus.browse(limit=2, offset=1).collect()] == ["s::D19-1234", "s::P18-1001"]
    for wrong in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            corpus.browse(**wrong)


def test_paper(corpus):
    row = corpus.paper("s::P18-1001").first()
    assert row["authors"] == ["Zed Ott", "Ann Lee"]
    assert [tuple(m) for m in row["methods"]] == [("BERT", "model"), ("Transformer", None)]
    assert [tuple(m) for m in row["datasets"]] == [("SQuAD", "QA")]
    assert corpus.paper("none").count() == 0


class Echo:
    name = "echo"

    def is_available(self):
        return True

    def generate(self, prompt, system_prompt=None, max_tokens=1024, temperature=0.1):
        return Generation("ok", "echo")


def test_search_and_answer(spark, corpus):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    asked = spark.createDataFrame([(1, "sentence embeddings", [0.0, 1.0, 0.0])], "query_id int, query_text string, embedding array<float>")
    with pytest.raises(RuntimeError):
        Corpus(corpus.papers, corpus.authors, corpus.entities, corpus.chunks, corpus.embeddings).search(asked)
    corpus.build_index()
    for text in ("", None, "x" * 2001):
        with pytest.raises(ValueError):
            corpus.search(asked.withColumn("query_text", F.lit(text).cast("string")))
    results = corpus.search(asked, top_k=4)
    assert [r["chunk_id"] for r in results.orderBy("rank").collect()][:2] == [2, 3]
    filtered = corpus.search(asked, venue="acl", year_min=2020)
    assert {r["chunk_id"] for r in filtered.collect()} == {4}
    replies, sources = corpus.answer(results, asked, Echo())
    assert replies.first()["answer"] == "ok"
    listed = {r["paper_id"]: r["authors"] for r in sources.collect()}
    assert listed["s::P18-1001"] == ["Zed Ott", "Ann Lee"] and len(listed) == 3
    string_ids = corpus.embeddings.withColumn("chunk_id", F.concat(F.col("chunk_id").cast("string"), F.lit("")))
    other = Corpus(corpus.papers, corpus.authors, corpus.entities, corpus.chunks, string_ids, corpus.index)
    assert other.search(asked, top_k=1).first()["chunk_id"] == 2

"""Gazetteer and enrichment against plain regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import automaton, gazetteer
from quire.operators.lexicon import LISTS, default_lexicon
from quire.plans import enrichment

SENTENCES = [
    "We fine-tune BERT and RoBERTa on SQuAD 2.0 and GLUE.",
    "GPT-4o beats GPT-4, GPT-3.5 and gpt; XGPT and GPT2 are unrelated.",
    "neural machine translation with masked language modeling and Low-Resource data",
    "CNN/DailyMail summarization, cnn features, _BERT_ and éBERT do not count; BERT: yes",
    "llama 3.1 and LLaMA 2, seq2seq models, multi-modal reasoning and chain-of-thought reasoning",
    "",
    None,
]


def expected(text, lexicon):
    found = []
    for number, (kind, name) in enumerate(lexicon):
        if re.search(rf"\b{re.escape(name)}\b", text or "", re.IGNORECASE):
            found.append((number, kind, name))
    return found


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(str(i), s) for i, s in enumerate(SENTENCES)], "id string, text string")


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r["paper_id"], []).append((r["ord"], r["entity_type"], r["name"]))
    return {k: sorted(v) for k, v in out.items()}


def want(lexicon):
    return {str(i): e for i, s in enumerate(SENTENCES) if (e := expected(s, lexicon))}


def test_both_paths_match_regular_expressions(spark, texts):
    lexicon = default_lexicon()
    assert grouped(gazetteer.extract(texts, F.col("text")).collect()) == want(lexicon)
    frame = spark.createDataFrame([(k, n, i) for i, (k, n) in enumerate(lexicon)], "entity_type string, name string, ord int")
    assert grouped(gazetteer.join_lexicon(texts, F.col("text"), frame).collect()) == want(lexicon)


def test_overlapping_and_odd_names(spark, texts):
    lexicon = [("a", "BERT and"), ("b", "bert"), ("a", "BERT"), ("a", "3"), ("a", "llama 3.1 and LLaMA"), ("a", "and LLaMA 2"), ("a", "é")]
    assert grouped(gazetteer.extract(texts, F.col("text"), lexicon).collect()) == want(lexicon)
    with pytest.raises(ValueError):
        gazetteer.find_entities(F.lit("x"), [("a", "C++")])


def test_automaton_matches_the_join(spark, texts, monkeypatch):
    lexicon = default_lexicon() + [("a", "BERT and"), ("a", "bert"), ("b", "3"), ("a", "llama 3.1 and LLaMA"), ("a", "1 and"), ("a", "and LLaMA 2"), ("b", "é"), ("b", "GLUE.")]
    frame = spark.createDataFrame([(k, n, i) for i, (k, n) in enumerate(lexicon)] + [("a", None, 0)], "entity_type string, name string, ord int")
    joined = grouped(gazetteer.join_lexicon(texts, F.col("text"), frame.filter("name IS NOT NULL")).collect())
    assert grouped(gazetteer.extract(texts, F.col("text"), frame).collect()) == joined
    sharded = automaton.extract_by_automaton(texts, F.col("text"), frame, shard_bytes=3000)
    assert grouped(sharded.collect()) == joined and len(sharded._jdf.queryExecution().toString().split("MapInArrow")) > 5
    assert "Exchange hash" not in sharded._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(automaton, "MAX_SHARDS", 1)
    assert automaton.extract_by_automaton(texts, F.col("text"), frame, shard_bytes=900) is None
    assert gazetteer.extract(texts, F.col("text"), frame.limit(0)).collect() == []


def test_automaton_finds_overlapping_runs():
    rng = random.Random(6)
    names = {" ".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)} | {"a-b", "a - b"}
    names = sorted(names)
    machine = automaton.WordAutomaton(names)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "c", "d"]) + rng.choice([" ", " ", "-", "  ", " - "]) for _ in range(30))
        tokens = automaton.TOKENS.findall(text)
        runs = {"".join(tokens[i:j]) for i in range(len(tokens)) for j in range(i + 1, len(tokens) + 1)}
        assert machine.find(text) == {i for i, n in enumerate(names) if n in runs}


def test_lexicon_is_deduplicated():
    lexicon = default_lexicon()
    assert len({(k, n.lower()) for k, n in lexicon}) == len(lexicon)
    topics = {n.lower() for k, n in lexicon if k == "topic"}
    assert not topics & {n.lower() for k in ("method", "dataset", "task") for n in LISTS[k]}
    assert ("method", "LLaMA") in lexicon and ("method", "Llama") not in lexicon


def test_extraction_text(spark):
    rows = spark.createDataFrame([("T", "A"), ("", "A"), ("T", None), (None, "")], "t string, a string")
    got = [r[0] for r in rows.select(enrichment.extraction_text(F.col("t"), F.col("a"))).collect()]
    assert got == ["T\nA", "A", "T", ""]


def test_merge_prefers_the_model(spark):
    schema = "paper_id string, entity_type string, ord int, name string, attr string"
    model = spark.createDataFrame([("p", "method", 0, "Bert", "model"), ("p", "method", 1, "BERT", None), ("p", "task", 2, "QA", None)], schema)
    found = spark.createDataFrame([("p", "method", 5, "BERT", None), ("p", "method", 6, "LoRA", None), ("q", "method", 5, "BERT", None)], schema)
    rows = enrichment.merge_entities(model, found).collect()
    assert {(r["paper_id"], r["entity_type"], r["name"], r["attr"]) for r in rows} == {
        ("p", "method", "Bert", "model"), ("p", "method", "LoRA", None), ("p", "task", "QA", None), ("q", "method", "BERT", None),
    }


def test_enrich_and_stats(spark, papers, entities):
    todo = enrichment.unenriched(papers, entities)
    assert [r["id"] for r in todo.collect()] == ["t::2022.acl-long.101"]
    assert enrichment.unenriched(papers, entities, todo.select(F.col("id").alias("paper_id"))).count() == 0
    answers = spark.createDataFrame(
        [("s::P18-1001", '{"methods": [{"method_name": "bert"}], "tasks": ["QA"]}'), ("s::D19-1234", "sorry")],
        "paper_id string, answer string",
    )
    rows = enrichment.enrich(papers, model_answers=answers)
    got = {(r["paper_id"], r["entity_type"], r["name"]) for r in rows.collect()}
    assert ("s::P18-1001", "method", "bert") in got and ("s::P18-1001", "method", "BERT") not in got
    assert ("s::D19-1234", "method", "LoRA") in got and ("t::2022.acl-long.100", "topic", "multilingual") in got
    only = enrichment.enrich(papers, model_answers=answers, use_gazetteer=False)
    assert {r["name"] for r in only.collect()} == {"bert", "QA"}
    blank = papers.limit(0).unionByName(papers.withColumns({"title": F.lit(" "), "abstract": F.lit("")}).limit(1))
    stats = enrichment.run_stats(papers.unionByName(blank.withColumn("id", F.lit("blank"))), rows, answers).first()
    assert (stats["processed"], stats["skipped"], stats["model_used"], stats["fallback_used"]) == (4, 1, 1, 3)
    assert stats["total_methods"] == sum(1 for g in got if g[1] == "method")


def test_newest_papers_come_first(spark, papers):
    def ids(frame):
        return sorted(r["id"] for r in frame.collect())

    assert ids(enrichment.newest(papers, 1)) == ["t::2022.acl-long.100"]
    assert ids(enrichment.newest(papers, 2)) == ["s::D19-1234", "t::2022.acl-long.100"]
    assert ids(enrichment.newest(papers, 9)) == ids(papers)
    same = spark.createDataFrame([(c, 2020, t) for c, t in [("c", "2024-01-02"), ("a", "2024-01-01"), ("b", None), ("d", "2024-01-02")]], "id string, year int, created_at string")
    assert ids(enrichment.newest(same, 2)) == ["c", "d"] and ids(enrichment.newest(same, 3)) == ["a", "c", "d"]
    with pytest.raises(ValueError):
        enrichment.newest(papers, 0)


def test_service_takes_a_lexicon_frame(spark, papers, entities, tmp_path):
    from quire import Corpus
    from quire.plans import ingest
    from quire.sources.store import TableStore

    lexicon = spark.createDataFrame([("topic", "nothing KNOWN", 0), ("task", "question answering", 1)], "entity_type string, name string, ord int")
    found = Corpus(papers, None, entities).enrich_missing(lexicon).collect()
    assert {(r["paper_id"], r["name"]) for r in found} == {("t::2022.acl-long.101", "nothing KNOWN")}
    store = TableStore(spark, str(tmp_path))
    store.create()
    ingest.add_papers(store, papers.drop("venue", "volume").withColumns({"venue": F.lit("acl"), "volume": F.lit(None).cast("string"), "authors": F.array(F.lit("Ann"))}))
    ingest.enrich_papers(store, lexicon, max_papers=3)  # the paper without a year is not among them
    assert {r["paper_id"] for r in store.read("entities").collect()} == {"s::P18-1001"}
    ingest.enrich_papers(store, lexicon)
    assert {r["name"] for r in store.read("entities").collect()} == {"question answering", "nothing KNOWN"}


def test_run_stats_extract_once(spark):
    papers = spark.createDataFrame([(f"p{i}", "", "alpha beta" if i % 2 else "gamma") for i in range(6)], "id string, title string, abstract string")
    lexicon = spark.createDataFrame([("method", "alpha", 0), ("task", "gamma", 1)], "entity_type string, name string, ord int")
    stats = enrichment.run_stats(papers, enrichment.enrich(papers, lexicon))
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one shard of names, read once
    assert stats.first().asDict() == {
        "processed": 6, "skipped": 0, "model_used": 0, "fallback_used": 6,
        "total_methods": 3, "total_datasets": 0, "total_tasks": 3, "total_topics": 0,
    }

"""Metrics, pools and evaluation against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import metrics, pooling
from quire.plans import evaluation


def scores(retrieved, relevant, k_values=(1, 3, 5, 10)):
    out = {"mrr": next((1 / (i + 1) for i, x in enumerate(retrieved) if x in relevant), 0.0)}
    for k in k_values:
        hits = [i for i, x in enumerate(retrieved[:k]) if x in relevant]
        ideal = sum(1 / math.log2(i + 2) for i in range(min(k, len(relevant))))
        out[f"precision@{k}"] = len(hits) / k
        out[f"recall@{k}"] = len(hits) / len(relevant) if relevant else 0.0
        out[f"ndcg@{k}"] = sum(1 / math.log2(i + 2) for i in hits) / ideal if ideal else 0.0
        out[f"hit_rate@{k}"] = float(bool(hits))
    return out


def test_retrieval_metrics(spark):
    rng = random.Random(7)
    runs = {q: (rng.sample(range(40), rng.randrange(0, 15)), set(rng.sample(range(40), rng.randrange(0, 8)))) for q in range(30)}
    asked = spark.createDataFrame([(q,) for q in runs], "query_id int")
    retrieved = spark.createDataFrame(
        [(q, x, r) for q, (got, _) in runs.items() for r, x in enumerate(got, 1)], "query_id int, item_id int, rank int"
    )
    relevant = spark.createDataFrame([(q, x) for q, (_, rel) in runs.items() for x in rel], "query_id int, item_id int")
    rows = metrics.retrieval_metrics(asked, retrieved, relevant, hit_rate=True).collect()
    assert len(rows) == 30
    for row in rows:
        want = scores(*runs[row["query_id"]])
        assert {n: row[n] for n in want} == pytest.approx(want)
    mean = metrics.macro_average(metrics.retrieval_metrics(asked, retrieved, relevant), ["mrr"]).first()
    assert mean["mrr"] == pytest.approx(sum(scores(*r)["mrr"] for r in runs.values()) / 30)


def test_macro_average_rules(spark):
    frame = spark.createDataFrame([(1.0,), (None,)], "m double")
    assert metrics.macro_average(frame, ["m"], missing="zero").first()["m"] == 0.5
    assert metrics.macro_average(frame, ["m"], missing="skip").first()["m"] == 1.0
    with pytest.raises(ValueError):
        metrics.macro_average(frame, ["m"], missing="drop")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_lcs_length():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(0, 90))]
        assert metrics.lcs_length(a, b) == lcs(a, b)


def test_rouge_and_coverage(spark):
    rows = [
        ("the cat sat", "the cat sat on the mat", ["cat", "Mat"], 2 * 1.0 * 0.5 / 1.5, 0.5),
        ("", "x", [], 0.0, 0.0),
        (None, "x", None, 0.0, 0.0),
        ("BERT uses attention", "BERT uses attention", ["bert", "ATTENTION"], 1.0, 1.0),
    ]
    frame = spark.createDataFrame([r[:3] for r in rows], "prediction string, reference string, keywords array<string>")
    got = frame.select(metrics.rouge_l_f1("prediction", "reference"), metrics.answer_coverage(F.col("prediction"), F.col("keywords"))).collect()
    assert [tuple(g) for g in got] == [pytest.approx(r[3:]) for r in rows]


def ranked(spark, *ids):
    return spark.createDataFrame([(1, c, r) for r, c in enumerate(ids, 1)], "query_id int, chunk_id int, rank int")


def test_pool_keeps_first_seen_order(spark):
    lists = [("bm25", ranked(spark, 1, 2, 3)), ("vector", ranked(spark, 2, 4, 5)), ("hybrid", ranked(spark, 1, 4, 6))]
    rows = pooling.pool(lists).orderBy("position").collect()
    assert [(r["chunk_id"], r["methods"]) for r in rows] == [
        (1, ["bm25", "hybrid"]), (2, ["bm25", "vector"]), (3, ["bm25"]), (4, ["vector", "hybrid"]), (5, ["vector"]), (6, ["hybrid"]),
    ]
    assert pooling.pooled_ids(lists).first()["pooled_from"] == {
        "bm25": ["1", "2", "3"], "vector": ["2", "4", "5"], "hybrid": ["1", "4", "6"],
    }


def test_pool_evaluation_skips_unjudged(spark):
    rows = [
        ("q1", ["2"], {"bm25": ["1", "2"], "vector": ["2"]}),
        ("q2", ["9"], {"bm25": ["1"], "vector": []}),
        ("q3", [], {"bm25": ["1"], "vector": ["1"]}),
    ]
    frame = spark.createDataFrame(rows, "id string, relevant_chunk_ids array<string>, pooled_from map<string,array<string>>")
    got = {r["method"]: (r["n"], r["mrr"], r["hit_rate@1"]) for r in evaluation.evaluate_pools(frame).collect()}
    assert got == {"bm25": (2, 0.25, 0.0), "vector": (2, 0.5, 0.5)}


def test_evaluate_report(spark):
    examples = spark.createDataFrame(
        [(1, ["a"], "x y", ["x"]), (2, ["b"], "z", [])],
        "query_id int, relevant_paper_ids array<string>, reference_answer string, keywords array<string>",
    )
    found = spark.createDataFrame([(1, "c", 1), (1, "c", 2), (1, "a", 3)], "query_id int, paper_id string, rank int")
    answers = spark.createDataFrame([(1, "x y")], "query_id int, answer string")
    per = {r["query_id"]: r for r in evaluation.evaluate(examples, found, answers).collect()}
    assert per[1]["mrr"] == 0.5 and per[1]["rouge_l_f1"] == 1.0 and per[2]["answer_coverage"] is None
    report = evaluation.report(evaluation.evaluate(examples, found, answers)).first()
    assert (report["mrr"], report["answer_coverage"]) == (0.25, 0.5)


def test_upsert_and_next_id(spark):
    old = spark.createDataFrame([("q001", 1), ("q002", 1)], "id string, v int")
    new = spark.createDataFrame([("q002", 2), ("q011", 2), ("qx", 2)], "id string, v int")
    merged = pooling.upsert(old, new)
    assert {(r["id"], r["v"]) for r in merged.collect()} == {("q001", 1), ("q002", 2), ("q011", 2), ("qx", 2)}
    assert pooling.next_question_id(merged).first()[0] == "q012"
    assert pooling.next_question_id(old.limit(0)).first()[0] == "q001"


def test_ablations_need_the_same_lists(spark):
    from quire.plans.search import SearchConfig

    bad = [evaluation.Ablation("a", "", SearchConfig()), evaluation.Ablation("b", "", SearchConfig(rrf_k=10))]
    with pytest.raises(ValueError):
        evaluation.ablation_results(None, None, None, None, bad)


def test_short_passages_are_found_in_blocks(spark, monkeypatch):
    from quire.catalog import evaluation as queries

    documents = spark.createDataFrame([(1, "an abc text"), (2, "two words, abcd"), (3, None)], "doc_id long, text string")
    passages = spark.createDataFrame([(k, p) for k, p in enumerate(["abc", "two words", "xyz", "wo wor", "a b c d", "", None])], "item_id long, passage string")
    want = {(0, 1), (0, 2), (1, 2), (3, 2), (5, 1), (5, 2)}
    for size in (1 << 20, 40):
        monkeypatch.setattr(queries, "SHORT_BYTES", size)
        assert {tuple(r) for r in queries._short_passages(documents, passages).collect()} == want
    assert queries._short_passages(documents, passages.limit(0)).count() == 0

import random
import zlib

import pytest

from quire.llm import toxicity
from quire.llm.toxicity import Lexicon, fold, hits, learn_lexicon, match_lexicon, score_toxicity

LEXICON = Lexicon({"idiot": 3.0, "trash": 2.0, "piece of trash": 5.0, "loser": 1.0, "sly": 1.0, "sulk*": 4.0}, ("trash can", "loser tree"))


def found(text):
    return sorted(hits(text, LEXICON.automaton())[1])


@pytest.mark.parametrize(
    "text, weights",
    [
        ("You IDIOT!", [3.0]),
        ("id1ot, 1diot; !diot", [3.0, 3.0]),  # a symbol at the start of a word stays one
        ("i|d!ot d!ot id!0t", [3.0]),
        ("іԁіот Ｉｄｉｏｔ i​díót \U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", [3.0] * 4),
        ("tra$h tr@sh 7rash $ly", [1.0, 2.0, 2.0, 2.0]),
        ("idiots losers trashes", [1.0, 2.0, 3.0]),
        ("idiotic trashy closer loserx 5loser", []),
        ("piece \n of\ttrash", [5.0]),
        ("a trash can, the trash  cans and trash", [2.0]),
        ("a loser tree has losers", [1.0]),
        ("", []),
        (" \n", []),
        ("sulk sulky sulk!", [4.0]),
        ("asulky sulking-sulk", [4.0]),
    ],
)
def test_hits(text, weights):
    assert found(text) == weights


def test_many_hits_and_long_texts():
    assert len(found("idiot piece of trash " * 5_000)) == 10_000
    assert hits("x" * 1_000_000, LEXICON.automaton())[0] == 1
    assert hits("idiot", Lexicon({}).automaton()) == (1, []) and fold("​") == []


def corpus(seed=1, rows=900):
    """Invented prose; toxic rows hold insults, some disguised, and one is copied often."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(400)]
    insults = ["idiot", "m0ron", "sсum", "blorgh", "wretchy"]  # the last two are in no list
    insults += ["zoinker" + x for x in vocabulary[:60]]
    texts, labels = [], []
    copied = ["".join(rng.choices("qrstuvwxyz", k=5)) for _ in range(60)]
    for _ in range(rows):
        words = rng.choices(vocabulary, k=rng.randint(5, 200))
        bad = rng.random() < 0.3
        if bad:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randrange(len(words) + 1), rng.choice(insults))
            if rng.random() < 0.5:
                words = copied + words
        elif rng.random() < 0.2:
            words.insert(0, "trash can")
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def test_weights_are_learned_and_copies_are_not(spark):
    texts, labels = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    learned = learn_lexicon(docs, marks, Lexicon.listed())
    assert learned.weights["blorgh"] > 2 and learned.weights["wretchy"] > 2 and learned.weights["idiot"] > 2
    assert set(learned.weights) - set(Lexicon.listed().weights) == {"blorgh", "wretchy", "zoinker*"}
    alike = learn_lexicon(docs, marks.filter("toxic = 1"), Lexicon.listed())
    assert alike == Lexicon.listed()


def test_held_out_accuracy(spark):
    texts, labels = corpus(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*enumerate(labels), (None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")
    rows = score_toxicity(docs, marks).collect()
    assert len(rows) == len(texts)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    rows = toxicity.op11(spark, folder).collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    pairs = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    caught = sum(p and t for p, t in pairs) / max(1, sum(t for _, t in pairs))
    assert len(pairs) > 500 and caught > 0.85 and sum(p > t for p, t in pairs) < len(pairs) / 100


def test_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    columns = ["doc_id", "held_out", "score", "predicted", "n_words", "n_hits", "density"]
    assert score_toxicity(nothing, none).collect() == [] and score_toxicity(odd, none).columns == columns
    rows = score_toxicity(odd, none).collect()
    assert len(rows) == 6 and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True, True]
    some = spark.createDataFrame([(None, "you idiot"), (1, "you idiot"), (1, "you idiot"), (2, None)], "doc_id long, text string")
    scores = [r["score"] for r in score_toxicity(some, none).collect()]
    assert sorted(s > 0 for s in scores) == [False, True, True, True] and len(set(scores)) == 2
    counts = match_lexicon(some, LEXICON).collect()
    assert sorted((r["n_words"], r["n_hits"], r["weight"]) for r in counts) == [(0, 0, 0.0)] + [(2, 1, 3.0)] * 3

import random
import zlib

import numpy as np
import pytest

from quire.llm import byte_cnn, fourier_quality, weak_rules
from quire.llm.stats import COUNTS, text_counts
from quire.llm.words import hash_words, word_hashes


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    runs = list(zip(words, words[1:], words[2:], strict=False))
    again = {r for r in runs if runs.count(r) > 1} if len(runs) < 3000 else set()
    covered = {k + j for k, r in enumerate(runs) if r in again for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_distinct_words": len(set(words)),
    }


def test_word_hashes_do_not_depend_on_groups(texts):
    data = [(t or "").encode() for t in texts]
    long = b" ".join(data * 5)
    alone = np.concatenate([h for _, _, h in word_hashes([long])])
    assert (alone == np.concatenate([h for _, _, h in word_hashes(data * 5)])).all()
    assert len(np.unique(alone)) == len(set(long.lower().split()))
    assert hash_words(np.frombuffer(b"Ab aB", np.uint8))[0].tolist().count(hash_words(np.frombuffer(b"ab", np.uint8))[0][0]) == 2


def test_counts_match_plain_python(docs, texts):
    found = {r["doc_id"]: r.asDict() for r in text_counts(docs).collect()}
    for k, text in enumerate(texts[:-1]):  # the last is too long for the plain version's repeats
        row = found[7 * k + 3]
        assert set(row) == {"doc_id", *COUNTS}
        for name, value in brute_counts(text).items():
            assert row[name] == value, (name, text)
    assert found[7 * (len(texts) - 1) + 3]["n_words"] == 60_000


def test_em_finds_the_good_and_the_bad_rules():
    rng = random.Random(1)
    patterns = {}
    truth = []
    for _ in range(5_000):
        good = rng.random() < 0.8
        hit = [0.99, 0.98, 0.9, 0.6] if good else [0.7, 0.8, 0.6, 0.5]
        votes = tuple(0 if rng.random() < 0.1 else (1 if (rng.random() < h) == good else -1) for h in hit)
        patterns[votes] = patterns.get(votes, 0) + 1
        truth.append((votes, good))
    model = weak_rules.fit(sorted(patterns.items()), 4)
    known = sorted(patterns)
    belief = dict(zip(known, model.posteriors(known), strict=True))
    right = sum((belief[v] >= 0.5) == g for v, g in truth) / len(truth)
    assert right > 0.9 and abs(model.good - 0.8) < 0.07 and model.on_good[0] > 0.95
    assert weak_rules.fit([], 3).rounds == 0


def test_judge_cases(docs, odd, nothing, texts):
    rows = {r["doc_id"]: r for r in weak_rules.judge(docs).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts[:-1]):
        row, counts = rows[7 * k + 3], brute_counts(text)
        failed = counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]
        assert row["base_failed"] == failed and not (failed and row["kept"]) and 0 <= row["posterior"] <= 1
    assert weak_rules.judge(odd).count() == 6 and weak_rules.judge(nothing).count() == 0


def test_isotonic_never_falls():
    xs, ys = fourier_quality.isotonic([(0, 10, 1), (1, 10, 5), (2, 10, 3), (3, 10, 9)])
    assert xs == sorted(xs) and ys == sorted(ys) and len(xs) == 3


def test_normal_equations_are_the_sums(spark):
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((200, 3)), rng.random(200)
    names = ["a", "b", "c"]
    frame = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    project = fourier_quality.Projection.draw([0.0] * 3, [1.0] * 3, features=16)
    left, right = fourier_quality.normal_equations(frame.repartition(3), names, project)
    z = project(x)
    assert np.allclose(left, z.T @ z) and np.allclose(right, z.T @ y)


def test_quality_is_learned_and_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scored = fourier_quality.score_quality(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) for r in rows)
    assert all((r["score"] >= 0.3) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    # Labels of held-out rows change nothing.
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    again = {r["doc_id"]: r["score"] for r in fourier_quality.score_quality(docs, other).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-6) for r in rows)


def test_quality_without_labels(spark, docs, odd, nothing):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, score int")
    assert {r["score"] for r in fourier_quality.score_quality(docs, labels).collect()} == {0.5}
    alike = spark.createDataFrame([(k, 1, 0) for k in range(0, 2000)] * 2, "doc_id long, quality int, score int")
    assert {r["predicted"] for r in fourier_quality.score_quality(docs, alike).collect()} == {1}
    assert fourier_quality.score_quality(odd, labels).count() == 6 and fourier_quality.score_quality(nothing, labels).count() == 0


def test_windows_cover_every_byte():
    data = [b"x" * 300, b"", b"y" * 128, b"z"]
    rows, owner, sizes = byte_cnn.windows(data)
    assert owner.tolist() == [0, 0, 0, 2, 3] and sizes.tolist() == [128, 128, 44, 128, 1]
    assert b"".join(r[:n].tobytes() for r, n in zip(rows, sizes, strict=True)) == b"".join(data)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(3)
    net = byte_cnn.Network.start(["a", "b"], seed=2)
    rows, labels = rng.integers(97, 103, (4, 16)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        p = net.probabilities(net.pooled(rows, net.tables()).astype(np.float64))
        return -np.log(p[np.arange(4), labels]).mean()

    for parameter, gradient in zip(net.parameters(), byte_cnn._gradients(net, rows, labels), strict=True):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        kept = parameter[at]
        parameter[at] = kept + 1e-2
        up = loss()
        parameter[at] = kept - 1e-2
        down = loss()
        parameter[at] = kept
        assert (up - down) / 2e-2 == pytest.approx(gradient[at], rel=0.15, abs=2e-3)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = byte_cnn.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_language_cases(odd, nothing, docs):
    rows = byte_cnn.identify(odd).collect()
    assert len(rows) == 6 and {r["lang_pred"] for r in rows} <= {"en", "und"}
    assert {(r["lang_pred"], r["score"]) for r in byte_cnn.identify(docs).collect()} == {("und", 0.0)}  # no labels
    assert byte_cnn.identify(nothing).count() == 0

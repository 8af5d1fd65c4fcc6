import collections
import math
import zlib

import numpy as np
import pytest

from quire.llm import ngram_trie
from quire.llm.elias_fano import EliasFano, encode, read_arrays, write_arrays
from quire.llm.shared import new_folder


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 0), (1, 10**9), (1000, 1000), (5000, 10**12), (50_000, 10**6), (200, 7)])
def test_elias_fano(tmp_path, n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
    meta, arrays = encode(values, "x")
    write_arrays(f"file://{tmp_path}/a", meta, arrays)
    sequence = EliasFano(*read_arrays(f"file://{tmp_path}/a"), "x")
    assert (sequence[np.arange(n)] == values).all() if n else sequence.n == 0
    distinct = np.unique(values)
    sequence = EliasFano(*encode(distinct, "x"), "x")
    queries = np.concatenate([distinct, rng.integers(0, 2 * top + 2, 500).astype(np.uint64)])
    place = {int(v): k for k, v in enumerate(distinct)}
    assert sequence.find(queries).tolist() == [place.get(int(q), -1) for q in queries]


def plain_model(texts):
    one, two, three = (collections.Counter() for _ in range(3))
    for words in texts:
        one.update(words)
        two.update(zip(words, words[1:], strict=False))
        three.update(zip(words, words[1:], words[2:], strict=False))
    n, v = sum(one.values()), len(one)

    def discount(counts):
        a, b = (sum(c == k for c in counts) for k in (1, 2))
        return min(0.95, max(0.1, a / (a + 2 * b))) if a + b else 0.5

    d1 = discount(one.values())
    d2 = discount([c for (a, b), c in two.items() if one[a] > 1 and one[b] > 1])
    d3 = discount([c for (a, b, e), c in three.items() if two[a, b] > 1 and two[b, e] > 1])
    used2, used3 = collections.Counter(), collections.Counter()
    for (a, _), c in two.items():
        used2[a] += (c - d2) / one[a] if c > 1 else 0
    for (a, b, _), c in three.items():
        used3[a, b] += (c - d3) / two[a, b] if c > 1 else 0

    def p(w, v1, u):
        x = (one[w] - d1) / n if w in one else d1 * v / n
        if v1 is not None:
            x = (1 - used2[v1]) * x + ((two[v1, w] - d2) / one[v1] if two[v1, w] > 1 else 0)
            if u is not None:
                x = (1 - used3[u, v1]) * x + ((three[u, v1, w] - d3) / two[u, v1] if three[u, v1, w] > 1 else 0)
        return x

    return one, n, v, p


@pytest.mark.parametrize("keys", [2_000_000, 60])
def test_scores_match_a_plain_model(spark, docs, texts, keys, monkeypatch):
    monkeypatch.setattr(ngram_trie, "FILE_KEYS", keys)  # many files, lists shared between them
    monkeypatch.setattr(ngram_trie, "HELD_KEYS", 500)
    found = {r["doc_id"]: r for r in ngram_trie.score_texts(docs, new_folder(spark, "trie-test")).collect()}
    words = {7 * k + 3: [*(t or "").encode().lower().split(), None] for k, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    one, n, v, p = plain_model([w for i, w in words.items() if not held[i]])
    for i, w in words.items():
        row = found[i]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (held[i], len(w), n)
        assert row["n_known"] == sum(x in one for x in w)
        assert row["base_score"] == pytest.approx(sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        exact = sum(math.log10(p(x, w[k - 1] if k else None, w[k - 2] if k > 1 else None)) for k, x in enumerate(w))
        assert abs(row["score"] - exact) <= 0.03 * len(w), (i, row["score"], exact)


def test_scores_of_odd_rows(spark, odd, nothing):
    rows = ngram_trie.score_texts(odd, new_folder(spark, "trie-test")).collect()
    assert len(rows) == 6 and all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert ngram_trie.score_texts(nothing, new_folder(spark, "trie-test")).count() == 0
    alone = ngram_trie.score_texts(odd.filter("doc_id IS NULL"), new_folder(spark, "trie-test")).collect()
    assert {(r["train_tokens"], r["base_score"], r["score"]) for r in alone} == {(0, 0.0, 0.0)}


def whole_model(texts):
    """The interpolated model of all n-grams, without any cut-off."""
    one, two, three = (collections.Counter() for _ in range(3))
    for words in texts:
        one.update(words)
        two.update(zip(words, words[1:], strict=False))
        three.update(zip(words, words[1:], words[2:], strict=False))
    n, v = sum(one.values()), len(one)

    def discount(counts):
        a, b = (sum(c == k for c in counts) for k in (1, 2))
        return min(0.95, max(0.1, a / (a + 2 * b)))

    d1, d2, d3 = (discount(c.values()) for c in (one, two, three))
    used2, used3 = collections.Counter(), collections.Counter()
    for (a, _), c in two.items():
        used2[a] += (c - d2) / one[a]
    for (a, b, _), c in three.items():
        used3[a, b] += (c - d3) / two[a, b]

    def p(w, v1, u):
        x = (one[w] - d1) / n if w in one else d1 * v / n
        if v1 is not None:
            x = (1 - used2[v1]) * x + ((two[v1, w] - d2) / one[v1] if two[v1, w] else 0)
            if u is not None:
                x = (1 - used3[u, v1]) * x + ((three[u, v1, w] - d3) / two[u, v1] if three[u, v1, w] else 0)
        return x

    return p


@pytest.mark.parametrize("keys", [2_000_000, 60])
def test_query_scores_with_all_pairs_and_triples(spark, docs, texts, keys, monkeypatch):
    monkeypatch.setattr(ngram_trie, "FILE_KEYS", keys)
    monkeypatch.setattr(ngram_trie, "HELD_KEYS", 500)
    monkeypatch.setattr(ngram_trie, "table", lambda *_: docs)
    found = {r["doc_id"]: r["score"] for r in ngram_trie.op8(spark, "").collect()}
    words = {7 * k + 3: [*(t or "").encode().lower().split(), None] for k, t in enumerate(texts)}
    p = whole_model([w for i, w in words.items() if zlib.crc32(str(i).encode()) % 5 != 1])
    for i, w in words.items():
        exact = sum(math.log10(p(x, w[k - 1] if k else None, w[k - 2] if k > 1 else None)) for k, x in enumerate(w))
        assert abs(found[i] - exact) <= 0.03 * len(w), (i, found[i], exact)


def test_large_counts_beside_their_bytes():
    c = np.array([1.0, 254, 255, 3, 256, 10**7])
    level = object.__new__(ngram_trie.Level)
    level.before, level.parts = np.array([0, 2]), [(None, ngram_trie._counts(c[k], "pairs")) for k in (slice(2), slice(2, 6))]
    places = np.array([5, 0, 4, 2, 2, 1, 3])
    assert level.values(places, "counts").tolist() == c[places].tolist()


@pytest.mark.parametrize(("keys", "block"), [(2_000_000, 1_500_000), (60, 1_500_000), (500, 700)])
def test_whole_model_keeps_exact_counts_over_files_and_blocks(spark, docs, texts, keys, block, monkeypatch):
    """Probabilities follow from counts, whatever the ranges, and lists and pairs that files share count once."""
    monkeypatch.setattr(ngram_trie, "FILE_KEYS", keys)
    monkeypatch.setattr(ngram_trie, "BLOCK_TOKENS", block, raising=False)
    same = spark.createDataFrame([(10**6 + k, "p q " + "p q r " * 200) for k in range(20)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(same)
    found = {r["doc_id"]: r["score"] for r in ngram_trie.score_texts(rows, new_folder(spark, "trie-test"), least=1).collect()}
    words = {7 * k + 3: [*(t or "").encode().lower().split(), None] for k, t in enumerate(texts)}
    words |= {10**6 + k: [*("p q " + "p q r " * 200).encode().split(), None] for k in range(20)}
    p = whole_model([w for i, w in words.items() if zlib.crc32(str(i).encode()) % 5 != 1])
    for i, w in words.items():
        exact = sum(math.log10(p(x, w[k - 1] if k else None, w[k - 2] if k > 1 else None)) for k, x in enumerate(w))
        assert found[i] == pytest.approx(exact, rel=1e-9), i

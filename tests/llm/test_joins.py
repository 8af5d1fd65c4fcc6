import random

import pytest

from quire.llm.components import connected_components
from quire.llm.containment import clean_documents, find_items
from quire.llm.jaccard_join import index_keys, jaccard_components, jaccard_links, prefix_length, set_members


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("most_pairs", [100, 0])
def test_jaccard_components_match_all_pairs(docs, texts, most_pairs):
    expected = brute_components([(7 * k + 3, t) for k, t in enumerate(texts)])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, most_pairs=most_pairs).collect()}
    assert found == expected
    assert sum(i != c for i, (_, c) in expected.items()) > 40


def test_jaccard_odd_rows(odd, nothing):
    rows = sorted(((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard_components(odd).collect()))
    assert rows == [(-1, -1), (-1, 1), (1, 1), (2, 2), (2, 2), (2, 2)]
    assert jaccard_components(nothing).count() == 0


@pytest.mark.parametrize("documents, held", [(3, 200_000), (64, 40)])
def test_links_in_small_blocks(monkeypatch, docs, documents, held):
    from quire.llm import jaccard_join

    whole = sorted(map(tuple, jaccard_links(docs, most_nodes=3).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCUMENTS", documents)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", held)
    assert sorted(map(tuple, jaccard_links(docs, most_nodes=3).collect())) == whole and len(whole) > 40


def test_links_of_a_large_group(spark):
    """600 texts near one original, above the threshold and below it."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(600):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    expected = set()
    for a in range(600):
        for b in range(a + 1, 600):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                expected.add((a, b, both, len(sets[a]), len(sets[b])))
    found = jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert 1_000 < len(expected) < 600 * 599 // 2


def test_a_shared_passage_makes_no_group_of_all_its_documents(monkeypatch, spark):
    """120 texts of 60 words of their own and one passage; only two of them are near copies."""
    from quire.llm import jaccard_join

    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(k, " ".join(f"x{rng.randrange(10**9)}" for _ in range(60)) + " " + passage) for k in range(120)]
    rows.append((120, rows[7][1].replace("p40", "other")))
    tried = []

    def counted(pairs, *more):
        tried.append(pairs.count())
        return verified(pairs, *more)

    verified = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", counted)
    links = jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), most_nodes=20).collect()
    assert [(r["a"], r["b"]) for r in links] == [(7, 120)]
    assert sum(tried) <= 120


def test_linked_sets_share_an_index_key():
    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(2, 60)
        x = np.array(sorted(rng.sample(range(1, 10**6), n)), np.uint64)
        y = x.tolist()
        for _ in range(rng.randint(1, max(1, n // 8))):
            y[rng.randrange(len(y))] = rng.randrange(1, 10**6)
        y = np.unique(np.array(y, np.uint64))
        both = len(set(x.tolist()) & set(y.tolist()))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        frequent = np.unique(np.array(rng.sample(x.tolist(), rng.randint(0, n)), np.uint64))
        shared = -(-75 * (len(x) + len(y)) // 175)
        keys = [dict(zip(*(v.tolist() for v in index_keys(s, frequent)), strict=True)) for s in (x, y)]
        meet = keys[0].keys() & keys[1].keys()
        assert any(keys[0][k] <= len(x) - shared + 1 and keys[1][k] <= len(y) - shared + 1 for k in meet)
    assert prefix_length(1) == 1 and prefix_length(100) == 27


def test_components_of_long_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 400)] + [(500, 500)]
    random.Random(1).shuffle(links)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 400)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forests_keep_components(monkeypatch, spark):
    from quire.llm import components

    rng = random.Random(4)
    links = [(a, b) for g in range(3) for a in range(100 * g, 100 * g + 60) for b in range(a + 1, 100 * g + 60) if rng.random() < 0.3]
    links += [(None, 4), (5, None), (7, 7)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long").repartition(3)
    assert components.forests(frame).count() <= 3 * 3 * 59
    expected = {100 * g + k: 100 * g for g in range(3) for k in range(60)}
    for most in (components.NODES_AT_ONCE, 5):
        monkeypatch.setattr(components, "NODES_AT_ONCE", most)
        assert {r["node"]: r["component"] for r in connected_components(frame).collect()} == expected


def test_items_are_found_in_short_and_long_texts(spark, docs, texts):
    long = texts[-1].split()
    rng = random.Random(3)
    near = long[500:540]
    near[20] = "new"
    cases = [" ".join(long[1000:1040]).upper(), " ".join(near), "one", "two words", None, "", "nowhere to be found at all here", texts[20], texts[20]]
    cases += [" ".join(rng.sample(long[:5000], 30)) for _ in range(20)]
    items = spark.createDataFrame([(k, t, 9) for k, t in enumerate(cases)], "item_id long, text string, doc_id int")
    expected = set()
    for k, t in enumerate(texts):
        held = shingles(t)
        for j, item in enumerate(cases):
            wanted = shingles(item)
            if wanted and 100 * len(wanted & held) >= 75 * len(wanted):
                expected.add((7 * k + 3, j, len(wanted), len(wanted & held)))
    found = find_items(docs, items).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected) > 6
    kept = clean_documents(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {7 * k + 3 for k in range(len(texts))} - {e[0] for e in expected}


def test_items_in_blocks(monkeypatch, spark, docs, texts):
    from quire.llm import containment

    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts[10:40])], "item_id long, text string")
    whole = sorted(map(tuple, find_items(docs, items).collect()))
    monkeypatch.setattr(containment, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, find_items(docs, items).collect())) == whole


def test_items_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(None, "a b c d e f"), (4, "q w e r t y")], "item_id long, text string")
    found = sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in find_items(odd, items).collect())
    assert found == [(-1, -1), (1, -1), (2, 4), (2, 4), (2, 4)]
    assert find_items(nothing, items).count() == 0 and find_items(odd, items.limit(0)).count() == 0
    assert clean_documents(odd, items).count() == 1


@pytest.mark.parametrize("most_nodes", [200, 2])
def test_all_links_of_distinct_sets(docs, texts, most_nodes):
    sets, node = {7 * k + 3: frozenset(shingles(t)) for k, t in enumerate(texts)}, {}
    for i in sorted(sets):
        if sets[i]:
            node.setdefault(sets[i], i)
    expected = set()
    for x, a in node.items():
        for y, b in node.items():
            both = len(x & y)
            if a < b and both and 100 * both >= 75 * len(x | y):
                expected.add((a, b, both, len(x), len(y)))
    found = [tuple(r) for r in jaccard_links(docs, most_nodes=most_nodes).collect()]
    assert set(found) == expected and len(found) == len(expected) > 70
    assert {tuple(r) for r in set_members(docs).collect()} == {(i, len(s), node.get(s)) for i, s in sets.items()}


def test_shortcut_gives_the_same_components(docs):
    whole, short = (sorted(map(tuple, jaccard_components(docs, most_pairs=0, shortcut=x).collect())) for x in (False, True))
    assert whole == short


def test_a_group_of_near_copies_costs_its_nodes(monkeypatch, spark):
    from quire.llm import jaccard_join

    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(60):
        words = list(base)
        words[rng.randrange(150)] = f"own{k}"
        rows.append((5 * k + 2, " ".join(words)))
    # Between the group and the last row, which links with the one before it only.
    rows += [(1_000, " ".join(base[:112])), (1_001, " ".join(base[:95]))]
    tried, verified = [], jaccard_join.verified

    def counting(pairs, sets, threshold):
        pairs = jaccard_join.cut(pairs)
        tried.append(pairs.count())
        return verified(pairs, sets, threshold)

    monkeypatch.setattr(jaccard_join, "verified", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert found == brute_components(rows)
    assert sum(tried) <= 62 * (jaccard_join.LEAST_HASHES + 2)  # before: 1,830 pairs

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quire.llm.spelling import group_variants, near_words, spelling_variants, word_counts


def brute_counts(rows, typo=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo and h % typo == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def brute_groups(counts, times=2):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        out[w] = (form, n, len(near), None if form is None else counts[form])
    for w in list(out):
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w] = (*out[w][:1], root, *out[w][1:4])
    return out


def test_near_words_are_those_one_edit_apart(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abà", k=rng.randint(0, 9))) for _ in range(500)} | {"", "a", "ab", "aaaaaaaaaa", "aaaaaaaaaaa", "z" * 5000, "z" * 5001}
    frame = spark.createDataFrame([(w,) for w in words] + [("ab",), (None,)], "word string")
    found = [tuple(r) for r in near_words(frame).collect()]
    expected = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(found) == len(expected) and {frozenset(p) for p in found} == expected


def test_groups_against_brute_force(spark):
    rng = random.Random(4)
    counts = {"".join(rng.choices("abcd", k=rng.randint(5, 8))): rng.choice([3, 4, 6, 8, 13, 40, 100]) for _ in range(400)}
    # A chain of doubling counts, and a hub: many words near one.
    counts |= {"qqqqq" + "x" * k: 3 * 2**k for k in range(9)} | {f"hub{chr(97 + k)}hub": 5 for k in range(26)} | {"hubhub": 10}
    frame = spark.createDataFrame([*counts.items(), (None, 7)], "word string, n long")
    found = {r["word"]: tuple(r)[1:] for r in group_variants(frame).collect()}
    assert found == brute_groups(counts)
    assert found["qqqqq"][1] == "qqqqq" + "x" * 8


def test_whole_query_on_documents(spark, docs, texts):
    rows = [(7 * k + 3, t) for k, t in enumerate(texts)]
    rng = random.Random(9)
    known = ["letter", "lettres", "größer", "straße", "water", "wather"]
    extra = [(9000 + k, " ".join(rng.choices(known, k=120)).title() + " 12water34×÷") for k in range(40)]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(more).withColumns({"word": F.lit("x"), "n": F.lit(1), "key": F.lit(2)})
    counts = brute_counts(rows + extra)
    assert {r["word"]: r["n"] for r in word_counts(all_docs).collect()} == counts
    found = {r["word"]: tuple(r)[1:] for r in spelling_variants(all_docs).collect()}
    assert found == brute_groups(counts) and any(f[0] for f in found.values())


def test_odd_rows(spark, odd, nothing):
    assert spelling_variants(nothing).collect() == []
    assert spelling_variants(odd).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    same = spark.createDataFrame([(None, "wordy"), (1, "wordy wordy"), (1, "wordy"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in spelling_variants(same, typo=None).collect()] == [("wordy", None, "wordy", 4, 0, None)]

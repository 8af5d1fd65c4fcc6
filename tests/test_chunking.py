"""Chunking against a plain Python model."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators.chunking import chunk_papers, number_chunks

SCHEMA = "id string, abstract string, full_text string"


def windows(text, size, shared):
    tokens, found, start = text.split(), [], 0
    while start < len(tokens):
        found.append(" ".join(tokens[start : start + size]))
        if start + size >= len(tokens):
            break
        start += size - shared
    return found


@pytest.mark.parametrize("size,overlap", [(512, 50), (13, 4), (26, 0)])
def test_fixed_windows(spark, size, overlap):
    rng = random.Random(5)
    rows = [(str(n), "short abstract", " ".join(str(rng.randrange(99)) for _ in range(n))) for n in (0, 1, 9, 10, 11, 17, 355, 393, 394, 748, 1500)]
    got: dict[str, list] = {}
    options = {"chunk_size": size, "overlap": overlap}
    for r in chunk_papers(spark.createDataFrame(rows, SCHEMA), "fixed", **options).orderBy("paper_id", "chunk_index").collect():
        got.setdefault(r["paper_id"], []).append(r["chunk_text"])
    w, s = int(size / 1.3), int(overlap / 1.3)
    assert got == {i: windows(full or abstract, w, s) for i, abstract, full in rows}


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunk_papers(spark.createDataFrame([("a", "b", "c")], SCHEMA), "fixed", chunk_size=50, overlap=50)


def test_abstract(spark):
    rows = [("a", "  some text ", None), ("b", " \n", "x"), ("c", None, None)]
    got = chunk_papers(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["paper_id"], r["chunk_text"], r["chunk_type"], r["token_count"]) for r in got] == [("a", "some text", "abstract", 2)]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        chunk_papers(spark.createDataFrame([], SCHEMA), "page")


def test_sections(spark):
    body = " ".join(["word"] * 60)
    full = f"{body}\nIntroduction\nMethod\n{body}\n2. Related  Work \n\n{body}\nConclusions\nshort\n\x01\x03 {body}"
    rows = [
        ("full", "abs", full),
        ("plain", "abs", body),
        ("tiny", "the abstract", "Introduction\nfew words"),
        ("none", "the abstract", " "),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in chunk_papers(frame, "section").orderBy("paper_id", "chunk_index").collect():
        got.setdefault(r["paper_id"], []).append((r["chunk_index"], r["chunk_type"], r["chunk_text"]))
    assert [k for _, k, _ in got["full"]] == ["preamble", "introduction", "section", "conclusion"]
    assert [i for i, _, _ in got["full"]] == [0, 1, 2, 3]
    # A heading right after another one belongs to its text.
    assert got["full"][1][2] == f"Introduction\nMethod\n{body}"
    assert got["full"][3][2].endswith(f"\x01\x03 {body}")
    assert [k for _, k, _ in got["plain"]] == ["full_text"]
    assert got["tiny"] == [(0, "abstract", "the abstract")] and got["none"] == [(0, "abstract", "the abstract")]
    kept = re.sub(r"\s+", " ", " ".join(t for _, _, t in got["full"]))
    assert kept.count("word") == 240


def test_numbering_is_dense_and_stable(spark):
    rows = [(f"p{i % 50}", i) for i in range(500)]
    frame = spark.createDataFrame(rows, "paper_id string, chunk_index int")
    one = {(r["paper_id"], r["chunk_index"]): r["id"] for r in number_chunks(frame, 8).collect()}
    two = {(r["paper_id"], r["chunk_index"]): r["id"] for r in number_chunks(frame.repartition(7, F.rand()), 8).collect()}
    assert one == two and sorted(one.values()) == list(range(1, 501))

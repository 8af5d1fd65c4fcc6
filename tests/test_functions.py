"""Text, identifier and label functions against plain Python."""

import pytest
from pyspark.sql import functions as F

from quire.functions import ids, labels, text
from quire.functions.model_output import parse_extraction

TEXTS = ["", "  ", "one", " a\tb\n c ", " nbsp inside and end ", "line\x85sep\x1cx", "don't stop, GPT-4 3.5!"]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def run(spark, values, *expressions, kind="string"):
    rows = column(spark, values, kind).select("i", *expressions).orderBy("i").collect()
    return [tuple(r)[1:] if len(expressions) > 1 else r[1] for r in rows]


def test_words_strip_blank_match_python(spark):
    x = F.col("x")
    got = run(spark, TEXTS, text.words(x), text.strip(x), text.has_text(x), text.estimate_tokens(text.word_count(x)))
    want = [(t.split(), t.strip(), bool(t.strip()), int(len(t.split()) * 1.3)) for t in TEXTS]
    assert got == want


def test_token_estimate_truncates(spark):
    got = spark.range(3000).select(text.estimate_tokens(F.col("id"))).collect()
    assert [r[0] for r in got] == [int(n * 1.3) for n in range(3000)]


def clean(value):
    lines = []
    for line in (part.strip() for part in value.split("\n")):
        if line or (lines and lines[-1]):
            lines.append(line)
    return "\n".join(lines)


def test_clean_lines(spark):
    samples = ["a\n\n\n\nb", "\n\n a \n \n\t\nb\n", "a\n\n\n", "a\n", "", "\n \n", "x\n\ny\n\n\n\nz "]
    assert run(spark, samples, text.clean_lines(F.col("x"))) == [clean(s) for s in samples]


def test_treebank_terms(spark):
    assert run(spark, ["Don't use GPT-4, it's 3.5!"], text.treebank_terms(F.col("x"))) == [
        ["do", "n't", "use", "gpt-4", ",", "it", "'s", "3.5", "!"]
    ]


def test_like_keeps_wildcards_and_backslashes(spark):
    values = ["a\\b", "A_B", "axb", "100%"]
    assert run(spark, values, text.contains_like(F.col("x"), "\\b")) == [True, False, False, False]
    assert run(spark, values, text.contains_like(F.col("x"), "a_b")) == [True, True, True, False]


@pytest.mark.parametrize(
    "acl_id,booktitle,venue,volume",
    [
        ("P18-1001", None, "acl", None),
        ("D19-1234", None, "emnlp", None),
        ("W18-5401", None, "workshop", None),
        ("2022.acl-long.220", None, "acl", "long"),
        ("2023.findings-emnlp.1", None, "findings", "emnlp"),
        ("2021.tacl.3", None, "tacl", None),
        (None, "Proceedings of the NAACL", "acl", None),
        ("", "North American Chapter", "naacl", None),
        (None, "Computational Linguistics, Volume 1", "cl", None),
        ("X99", "Unknown", None, None),
        (None, None, None, None),
    ],
)
def test_venue_and_volume(spark, acl_id, booktitle, venue, volume):
    row = (
        spark.createDataFrame([(acl_id, booktitle)], "a string, b string")
        .select(ids.venue_from_id(F.col("a"), F.col("b")), ids.volume_from_id(F.col("a")))
        .first()
    )
    assert tuple(row) == (venue, volume)


def test_venue_ids(spark):
    values = [["ACL"], ["foo", "Findings"], ["Foo", "bar"], [], None]
    assert run(spark, values, ids.venue_from_ids(F.col("x")), kind="array<string>") == [
        "acl", "findings", "foo", None, None,
    ]


def test_authors(spark):
    values = ["A B and C D", "A B, C D,, ", "Solo", "", None]
    assert run(spark, values, ids.authors_from_text(F.col("x"))) == [["A B", "C D"], ["A B", "C D"], ["Solo"], [], []]
    structs = [[("A", "B"), ("", ""), (None, "C")], None]
    got = run(spark, structs, ids.authors_from_structs(F.col("x")), kind="array<struct<first:string,last:string>>")
    assert got == [["A B", "C"], []]


def test_paper_ids(spark):
    x = F.col("x")
    got = run(spark, ["s::a::b/c", "plain"], ids.paper_source(x), ids.paper_source_id(x), ids.safe_file_name(x))
    assert got == [("s", "b/c", "s_a_b_c"), ("unknown", "plain", "plain")]
    assert run(spark, ["12", "x1", None], ids.parse_chunk_id(x)) == [12, None, None]


def test_labels(spark):
    assert run(spark, [999, 1000, 1234567], labels.count_label(F.col("x")), kind="bigint") == ["999", "1.0K", "1.2M"]
    assert run(spark, ["acl", "conll", "new", "", None], labels.venue_label(F.col("x"))) == [
        "ACL", "CoNLL", "NEW", "Unknown", "Unknown",
    ]
    base, volume = labels.split_composite_venue(F.col("x"))
    assert run(spark, ["findings-acl", "acl"], base, volume) == [("findings", "acl"), ("acl", None)]


def test_truncate(spark):
    x = F.col("x")
    got = run(spark, ["short", "hello world"], text.truncate(x, 6), text.truncate(x, 6, "…", True))
    assert got == [("short", "short"), ("hello ...", "hello…")]


def test_model_output(spark):
    good = '{"methods": [{"method_name": " BERT ", "method_type": "model"}, {"method_name": "X", "method_type": "odd"}, 3,'
    good += ' {"method_name": ""}], "datasets": [{"dataset_name": "SQuAD"}], "tasks": ["QA", 1, " "], "topics": ["bias"]}'
    raws = [good, f"```json\n{good}\n```", f"Here: {good} ok?", "no json", "[1, 2]", '{"methods": "oops"}', None]
    rows = run(spark, raws, parse_extraction(F.col("x")))
    for row in rows[:3]:
        assert [(m["name"], m["attr"]) for m in row["methods"]] == [("BERT", "model"), ("X", None)]
        assert [(d["name"], d["attr"]) for d in row["datasets"]] == [("SQuAD", None)]
        assert row["tasks"] == ["QA"] and row["topics"] == ["bias"]
    assert rows[3] is None and rows[4] is None and rows[6] is None
    assert rows[5]["methods"] == [] and rows[5]["tasks"] == []

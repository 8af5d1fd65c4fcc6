"""Rows between two places of an order."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import selection
from quire.operators.selection import Key, in_order


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(12)
    made = []
    for i in range(700):
        # Half of all rows share a year, and many titles a long beginning; ids tell them apart.
        year = rng.choice([2020] * 5 + [2018, 2019, 2021, None])
        title = rng.choice(["A common beginning of titles " + rng.choice("abcé"), "ü" * rng.randint(1, 4), f"t{rng.randrange(50)}", "", None])
        made.append((f"id{i:05d}", year, title))
    rng.shuffle(made)
    return made


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, year int, title string").repartition(5).cache()


def ordered(rows):
    """Newest first, nulls last; then titles, nulls first; then ids."""
    return [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is not None, (r[2] or "").encode(), r[0]))]


def keys():
    return [Key(F.col("year"), descending=True, text=False), Key(F.col("title")), Key(F.col("id"))]


@pytest.mark.parametrize("n, offset", [(1, 0), (5, 0), (30, 0), (700, 0), (900, 0), (20, 333), (400, 100), (1, 699), (300, 650), (10, 700), (0, 5)])
def test_any_place_and_number(frame, rows, monkeypatch, n, offset):
    monkeypatch.setattr(selection, "EDGE_ROWS", 12)
    got = [r["id"] for r in in_order(frame, keys(), n, offset).collect()]
    assert sorted(got) == sorted(ordered(rows)[offset : offset + n])


def test_large_choices_order_no_more_than_the_edges(frame, monkeypatch):
    monkeypatch.setattr(selection, "EDGE_ROWS", 12)
    plan = in_order(frame, keys(), 500, 50)._jdf.queryExecution().optimizedPlan().toString()
    limits = [int(x.split()[0].rstrip(",")) for x in plan.split("GlobalLimit ")[1:]]
    assert limits and max(limits) <= 12 and "Union" in plan
    small = in_order(frame, keys(), 5, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in small and "GlobalLimit 5" in small


def test_equal_keys_and_empty_tables(frame, monkeypatch):
    monkeypatch.setattr(selection, "EDGE_ROWS", 12)
    assert in_order(frame, [Key(F.lit("same"))], 40, 10).count() == 40
    assert in_order(frame.limit(0), keys(), 40, 10).collect() == []

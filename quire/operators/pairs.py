"""Most frequent pairs of names that share a paper.

A paper with very many names would emit a quadratic number of pairs, so names
that cannot be part of a top pair are removed first.  A pair is never more
frequent than its rarer name allows.  The pairs among a few of the most frequent
names give a count that the n-th best pair is known to reach; every name whose
own bound lies below it is dropped.  The result is exact.

What is left of a paper with many names is dealt into blocks of names, and pairs
of blocks are the keys of the join, so that one paper is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.model import entities_of
from quire.session import broadcast_if_small, scratch_folder

SEED_NAMES = 32
BLOCK_NAMES = 512  # names of one paper that a key of the join holds on either side


def _multiplicity(rows: DataFrame) -> DataFrame:
    """(paper_id, name, mult), written once: duplicates are counted once before any join.

    Grouping by both columns spreads a hot paper over the tasks.
    """
    rows = rows.filter(F.col("paper_id").isNotNull() & F.col("name").isNotNull())
    counted = rows.groupBy("paper_id", "name").agg(F.count("*").alias("mult"))
    path = scratch_folder(rows.sparkSession, "names")
    counted.write.parquet(path)
    return rows.sparkSession.read.schema(counted.schema).parquet(path)


def _support(side: DataFrame) -> DataFrame:
    return side.groupBy("name").agg(F.sum("mult").alias("support"), F.max("mult").alias("max_mult"))


def _blocks(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """(paper_id, left_blocks, right_blocks) of papers with more than a block of names on a side; None without any."""

    def size(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("paper_id").agg(F.count("*").alias(name))

    sizes = size(left, "n_left").join(size(right, "n_right"), "paper_id")
    hot = sizes.filter((F.col("n_left") > BLOCK_NAMES) | (F.col("n_right") > BLOCK_NAMES))
    blocks = {f"{s}_blocks": F.ceil(F.col(f"n_{s}") / BLOCK_NAMES).cast("int") for s in ("left", "right")}
    path = scratch_folder(left.sparkSession, "blocks")
    hot.select("paper_id", *(c.alias(n) for n, c in blocks.items())).write.parquet(path)
    hot = left.sparkSession.read.parquet(path)
    return None if hot.isEmpty() else hot


def _pair_counts(left: DataFrame, right: DataFrame, condition: Column | None, hot: DataFrame | None = None) -> DataFrame:
    """(a, b, pairs); the papers of ``hot`` meet block by block."""
    left = left.select("paper_id", F.col("name").alias("a"), F.col("mult").alias("mult_a"))
    right = right.select("paper_id", F.col("name").alias("b"), F.col("mult").alias("mult_b"))
    if hot is None:
        joined = left.join(right, "paper_id")
    else:
        papers = broadcast_if_small(hot)

        def dealt(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
            # Rows of other papers are one block.
            side = side.join(papers, "paper_id", "left")
            block = F.coalesce(F.pmod(F.xxhash64(name), F.col(f"{own}_blocks")).cast("int"), F.lit(0))
            others = F.sequence(F.lit(0), F.coalesce(F.col(f"{other}_blocks"), F.lit(1)) - 1)
            return side.withColumn(own, block).withColumn(other, F.explode(others)).drop("left_blocks", "right_blocks")

        joined = dealt(left, "a", "left", "right").join(dealt(right, "b", "right", "left"), ["paper_id", "left", "right"])
    if condition is not None:
        joined = joined.filter(condition)
    return joined.groupBy("a", "b").agg(F.sum(F.col("mult_a") * F.col("mult_b")).alias("pairs"))


def top_pairs(left: DataFrame, right: DataFrame, top_n: int, condition: Column | None = None) -> DataFrame:
    """Top pairs (a, b, pairs) of ``left`` and ``right``, frames of (paper_id, name, mult) that are cheap to read again."""
    supports = [_support(left), _support(right)]
    most = [s.agg(F.max("max_mult")).scalar() for s in supports]

    def only(side: DataFrame, support: DataFrame) -> DataFrame:
        names = support.orderBy(F.desc("support"), "name").limit(SEED_NAMES).select("name")
        return side.join(F.broadcast(names), "name", "left_semi")

    seed_pairs = _pair_counts(only(left, supports[0]), only(right, supports[1]), condition)
    best = seed_pairs.orderBy(F.desc("pairs")).limit(top_n)
    # Fewer than top_n seed pairs give no floor.
    floor = best.agg(F.when(F.count("*") >= top_n, F.min("pairs")).otherwise(F.lit(0)).alias("floor")).first()["floor"]

    def reachable(side: DataFrame, support: DataFrame, other: Column) -> DataFrame:
        names = support.filter(F.col("support") * other >= floor).select("name")
        return side.join(names, "name", "left_semi") if floor > 0 else side

    left, right = reachable(left, supports[0], most[1]), reachable(right, supports[1], most[0])
    pairs = _pair_counts(left, right, condition, _blocks(left, right))
    return pairs.orderBy(F.desc("pairs"), "a", "b").limit(top_n)


def entity_cooccurrence(entities: DataFrame, left_kind: str, right_kind: str, top_n: int = 20) -> DataFrame:
    """Names of two kinds that occur in the same papers most often."""
    left = _multiplicity(entities_of(entities, left_kind))
    right = _multiplicity(entities_of(entities, right_kind))
    singular = {k: k[:-1] + "_name" for k in (left_kind, right_kind)}
    return top_pairs(left, right, top_n).select(
        F.col("a").alias(singular[left_kind]), F.col("b").alias(singular[right_kind]), F.col("pairs").alias("co_count")
    )


def author_pairs(authors: DataFrame, top_n: int = 20) -> DataFrame:
    """Author pairs with the most shared papers; a repeated name counts once per paper."""
    once = _multiplicity(authors).withColumn("mult", F.lit(1).cast("long"))
    return top_pairs(once, once, top_n, F.col("a") < F.col("b")).select(
        F.col("a").alias("author_a"), F.col("b").alias("author_b"), F.col("pairs").alias("shared_papers")
    )

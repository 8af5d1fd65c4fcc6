"""Connected components of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut


NODES_AT_ONCE = 200_000  # of one forest


def forests(links: DataFrame) -> DataFrame:
    """``a, b`` of fewer links with the same components.

    Each task puts the links that it reads into trees and passes on a link to its root for
    each node, after NODES_AT_ONCE nodes at the latest.  A dense group costs its nodes, not its links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(node: int) -> int:
            while parent[node] != node:
                parent[node] = node = parent[parent[node]]
            return node

        def trees() -> pa.RecordBatch:
            found = [(node, root(node)) for node in parent]
            ends = list(zip(*(f for f in found if f[0] != f[1]), strict=True)) or [[], []]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                low, high = sorted((root(a), root(b)))
                parent[high] = low
            if len(parent) > NODES_AT_ONCE:
                yield trees()
        yield trees()

    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    return links.mapInArrow(run, "a long, b long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links(a, b)``; a component is its smallest node.

    Large-star and small-star steps alternate: each node passes its smallest neighbour
    on, first to its larger, then to its smaller neighbours, until every node points
    straight at the smallest of its component.  A component of diameter d takes about
    log d rounds; no step emits pairs of neighbours or collects a group.  Each round is
    cut, so a lost executor costs no more than the round it works on.
    """
    edges = cut(
        forests(links).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    while True:
        # Large star: every larger neighbour of a node is tied to the node's smallest one.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours and the node itself are tied to the smallest one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(tied.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        if edges.count() == new.count() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )

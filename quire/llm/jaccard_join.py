"""N-gram Jaccard join over token-combination prefixes.

A document's set holds its distinct five-word shingles; two documents link when
100 * |intersection| >= 75 * |union|.  Shingles are ordered, rare class first, by hash
within a class.  Two linked sets share at least k shingles among the first
|x| - ceil(0.75 |x|) + k of either, the k-extended prefix.  With k = 2, a linked pair
therefore shares either a rare shingle of the prefix or two frequent ones, so it is
enough to index the rare shingles of the prefix singly and the frequent ones by pairs.
Keys carry their place in the set: two sets of known sizes need a key further ahead
than the prefix alone says.
A passage that very many documents hold is frequent: it stands behind the rare
shingles, mostly outside the prefix, and never makes a group of all its documents.

Copies are merged first: documents with equal sets are one node, and ``set_members`` says
of which node a document is.  ``jaccard_links`` gives every link between two nodes with
its overlap.  Shingles whose groups are large are the frequent class.  Keys of a set are in
order of place, each with the one before it: a pair that shares a key and the one before
is tried for an earlier key already.  ``jaccard_components`` follows from these links.

``shortcut=True`` gives the same components without the links inside them.  With all
shingles indexed singly, each node is tried against the head it shares most keys with, the
smallest node of a key's group.  What this links is one component already, however
large a group of near copies is; it needs no further pairs among its members.  Some
rounds like it follow in groups that are still dense.  The
frequent class are the shingles whose groups still hold many pairs from different
components: passages that unlike documents share.  With that class the index is built
again, and the pairs of one key in different components are tried.

Any class gives the same links; only the number of candidates depends on it.  All pairs
are verified on whole sets, after bitmaps of the sets have ruled out most others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.registry import query, table
from quire.llm.shared import cut, stored
from quire.llm.words import mix, shingle_sets, slices, texts_of
from quire.session import broadcast_if_small

WIDTH = 5
THRESHOLD = 75  # per cent
COMBINATION = 2
# With the shortcut, a shingle is frequent when its index group holds more pairs from
# different components.
MOST_PAIRS = 50
# For the links, a shingle is frequent when more nodes have it.
MOST_NODES = 200
# Rounds in which nodes of dense groups are tried against some nodes of the largest
# component, before all that is left is tried; they change the work, not the links.
ROUNDS, TRIES = 2, 8
SEED = np.uint64(0x9E3779B97F4A7C15)
# Least hashes of a set by which near copies find the head of their class.
LEAST_HASHES = 4
# Hashes below are the lower half of a set, in whose order prefixes are taken.
HALF = np.uint64(1 << 63)


def prefix_length(size: int, threshold: int = THRESHOLD, k: int = COMBINATION) -> int:
    """Length of the k-extended prefix of a set."""
    return min(size, size - -(-threshold * size // 100) + k)


def index_keys(hashes: np.ndarray, frequent: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, rare shingles of the prefix and pairs of frequent ones, with their places.

    The place of a pair is that of its second shingle.  A set of one shingle links with
    equal sets only, which are merged already.
    """
    length = prefix_length(len(hashes), threshold)
    if len(frequent) == 0:
        return hashes[:length], np.arange(length)
    place = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    common = frequent[place] == hashes
    rare = hashes[~common][:length]
    often = hashes[common][: length - len(rare)]
    if len(often) < COMBINATION:
        return rare, np.arange(len(rare))
    second, first = np.tril_indices(len(often), -1)  # in order of place
    with np.errstate(over="ignore"):
        pairs = mix(mix(often[first]) * SEED + often[second])
    return np.concatenate([rare, pairs]), np.concatenate([np.arange(len(rare)), len(rare) + second])


def may_link(a: str, b: str, threshold: int) -> Column:
    """Whether sets of sizes ``n_a`` and ``n_b`` that share a key at ``pos_a`` and ``pos_b`` can link.

    Linked sets share at least s = ceil(t (n_a + n_b) / (1 + t)) shingles, so two of
    these are among the first n - s + 2 of either set.
    """
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    shared = F.floor((threshold * (n_a + n_b) + (99 + threshold)) / (100 + threshold))
    sizes = 100 * F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b)
    reach = COMBINATION - 1
    return sizes & (F.col(f"pos_{a}") <= n_a - shared + reach) & (F.col(f"pos_{b}") <= n_b - shared + reach)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(values))


def signature(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    with np.errstate(over="ignore"):
        one = np.bitwise_xor.reduce(mix(hashes)) if len(hashes) else np.uint64(0)
        two = mix(hashes + SEED).sum(dtype=np.uint64)
    return one.tobytes() + two.tobytes()


def least_hashes(hashes: np.ndarray) -> list[int]:
    """The least of a set's hashes in several orders; two sets share one as often as their Jaccard similarity."""
    with np.errstate(over="ignore"):
        return [int(mix(hashes + SEED * np.uint64(k + 2)).min().view(np.int64)) for k in range(LEAST_HASHES)] if len(hashes) else []


def signed_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, sig, least`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, sigs, least = [], [], []
            for hashes in shingle_sets(texts_of(batch.column(1)), WIDTH):
                sizes.append(len(hashes))
                sigs.append(signature(hashes))
                least.append(least_hashes(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(least, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "sig", "least"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sig binary, least array<long>")


def keyed_sets(docs: DataFrame, frequent: np.ndarray, threshold: int) -> DataFrame:
    """``doc_id, n, keys, places`` of each document, with the frequent class set apart."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, keys, places = [], [], []
            for hashes in shingle_sets(texts_of(batch.column(1)), WIDTH):
                found, at = index_keys(hashes, shared.value, threshold)
                sizes.append(len(hashes))
                keys.append(found)
                places.append(at)
            flat = pa.array(np.concatenate(places).astype(np.int32))
            lists = _lists(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), lists, pa.ListArray.from_arrays(lists.offsets, flat)],
                ["doc_id", "n", "keys", "places"],
            )

    return docs.mapInArrow(run, "doc_id long, n int, keys array<long>, places array<int>")


def halves_of_sets(docs: DataFrame, threshold: int, first: np.ndarray | None = None) -> DataFrame:
    """``doc_id, keys`` of each document: the lower half of its shingles, that of hashes below HALF.

    With the frequent class ``first`` of the lower half, it is the upper half, and only of
    documents whose prefixes reach into it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def reaches(lower: np.ndarray, length: int) -> bool:
        place = np.minimum(np.searchsorted(shared.value, lower), len(shared.value) - 1)
        rare = int((shared.value[place] != lower).sum()) if len(shared.value) else len(lower)
        return rare < length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, keys = [], []
            for row, hashes in enumerate(shingle_sets(texts_of(batch.column(1)), WIDTH)):
                cut_at = int(np.searchsorted(hashes, HALF))
                if shared.value is None or reaches(hashes[:cut_at], prefix_length(len(hashes), threshold)):
                    rows.append(row)
                    keys.append(hashes[:cut_at] if shared.value is None else hashes[cut_at:])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), _lists(keys)], ["doc_id", "keys"])

    return docs.mapInArrow(run, "doc_id long, keys array<long>")


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each shingle's hash, in at least four times as many bits as there are shingles."""
    size = 1 << max(6, int(4 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def shared_at_most(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    """Upper bound of the intersection: each bit that only one set has stands for a shingle that only it has."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(u) > len(v):  # the low bits of a hash are the same in maps of any size
        u = u[: len(u) // 2] | u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] | v[len(v) // 2 :]
    only_x, only_y = int(np.bitwise_count(u & ~v).sum()), int(np.bitwise_count(v & ~u).sum())
    return min(n_x - only_x, n_y - only_y)


# A cell holds the sets of two blocks of documents and the pairs between them.  A block has
# about so many documents and shingles at most, or one document.
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 64, 200_000


def blocks(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``doc_id, block`` of the documents in ``pairs(a, b)``; ``sizes(doc_id, n)`` has their sets' sizes.

    Documents with the same smallest partner stand together, dealt into blocks by hash:
    in a group of near copies all do, so that a set goes to one cell for each block of
    partners, not for each partner.  Two blocks of one hash only make a larger cell.
    """
    ends = pairs.select(F.col("b").alias("doc_id"), "a").unionByName(pairs.select(F.col("a").alias("doc_id"), "a"))
    placed = ends.groupBy("doc_id").agg(F.min("a").alias("label")).join(sizes, "doc_id")
    placed = cut(placed.groupBy("doc_id", "label").agg(F.max("n").alias("n")))
    parts = placed.groupBy("label").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_DOCUMENTS, F.sum("n") / BLOCK_SHINGLES)).alias("parts")
    )
    block = F.xxhash64("label", F.pmod(F.xxhash64("doc_id"), "parts"))
    return cut(placed.join(broadcast_if_small(parts), "label").select("doc_id", block.alias("block")))


def in_cells(pairs: DataFrame, placed: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """``x, y, role, a, b`` and the columns of ``values(doc_id, ...)``, cell by cell.

    The rows of role 0 are the cell's documents (as ``a``), those of role 1 its pairs.
    """
    side = lambda c, x: broadcast_if_small(placed.select(F.col("doc_id").alias(c), F.col("block").alias(x)))
    # Written, as the cells' members, their measuring and the pairs themselves read it.
    dealt = stored(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y", "a", "b"))
    members = dealt.select("x", "y", F.col("a").alias("doc_id")).unionByName(dealt.select("x", "y", F.col("b").alias("doc_id"))).distinct()
    held = values.join(broadcast_if_small(members), "doc_id")
    held = held.select("x", "y", F.lit(0).alias("role"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), *columns)
    dealt = dealt.withColumn("role", F.lit(1)).select("x", "y", "role", "a", "b")
    return held.unionByName(dealt, allowMissingColumns=True).repartition("x", "y").sortWithinPartitions("x", "y", "role")


class Cell:
    """What is known of the documents of the cell that is being read."""

    def __init__(self) -> None:
        self.key, self.held = None, {}

    def enter(self, key: tuple) -> None:
        if key != self.key:
            self.key, self.held = key, {}

    def add(self, doc_id: int, value) -> None:
        """Repeated rows of an id are all kept."""
        self.held.setdefault(doc_id, []).append(value)

    def both(self, a: int, b: int) -> Iterator[tuple]:
        return ((x, y) for x in self.held.get(a, ()) for y in self.held.get(b, ()))


def possible(pairs: DataFrame, placed: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps of their sets do not rule out; no link is lost."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [(len(h), bitmap(h)) for h in shingle_sets(texts_of(batch.column(1)), WIDTH)]
            arrays = [batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([b for _, b in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "bits"])

    wanted = broadcast_if_small(placed.select("doc_id"))
    marked = docs.join(wanted, "doc_id", "left_semi").mapInArrow(mark, "doc_id long, n long, bits binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Cell()
        for batch in batches:
            keep = []
            for x, y, role, a, b, n, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cell.enter((x, y))
                if role == 0:
                    cell.add(a, (bits, n))
                    continue
                for (u, n_u), (v, n_v) in cell.both(a, b):
                    shared = shared_at_most(u, n_u, v, n_v)
                    if 100 * shared >= threshold * (n_u + n_v - shared):
                        keep.append((a, b))
                        break
            columns = list(zip(*keep, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return in_cells(pairs, placed, marked, ["n", "bits"]).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: Sets, threshold: int) -> DataFrame:
    """``a, b, shared, n_a, n_b`` of the different pairs of documents that link.

    Bitmaps rule most others out, whole sets decide.
    """
    pairs = stored(pairs)
    placed = blocks(pairs, sets.nodes.select(F.col("node").alias("doc_id"), "n"))
    pairs = cut(possible(pairs, placed, sets.source, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Cell()
        for batch in slices(batches):
            rows = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            keep = []
            for (x, y, role, a, b), found in zip(rows, shingle_sets(texts_of(batch.column(5)), WIDTH), strict=True):
                cell.enter((x, y))
                if role == 0:
                    cell.add(a, found.copy())
                    continue
                for u, v in cell.both(a, b):
                    if not len(u) or not len(v):
                        continue
                    place = np.minimum(np.searchsorted(v, u), len(v) - 1)
                    shared = int((v[place] == u).sum())
                    if 100 * shared >= threshold * (len(u) + len(v) - shared):
                        keep.append((a, b, shared, len(u), len(v)))
                        break
            columns = list(zip(*keep, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "shared", "n_a", "n_b"])

    found = in_cells(pairs, placed, sets.source, ["text"])
    return found.mapInArrow(run, "a long, b long, shared long, n_a long, n_b long")


@dataclass
class Sets:
    """The sets of documents: one node for all that are equal."""

    source: DataFrame  # doc_id, text
    base: DataFrame  # doc_id, n_shingles, sig, least of each row
    nodes: DataFrame  # sig, node, n, least
    others: DataFrame  # ids that stay out of the index

    @staticmethod
    def of(docs: DataFrame, doc_id: str, text: str) -> Sets:
        source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        base = stored(signed_sets(source))
        nodes = base.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sig")
        nodes = stored(nodes.agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("least").alias("least")))
        # Copies and texts that only equal texts can link with stay out of the index.
        others = base.select("doc_id").join(nodes.filter("n > 1").select(F.col("node").alias("doc_id")), "doc_id", "left_anti")
        return Sets(source, base, nodes, broadcast_if_small(cut(others.filter("doc_id IS NOT NULL").distinct())))

    def members(self) -> DataFrame:
        named = self.base.join(self.nodes.select("sig", "node"), "sig", "left")
        return named.select("doc_id", "n_shingles", "node", "sig")

    def keyed(self, frequent: np.ndarray, threshold: int, classes: DataFrame | None = None) -> DataFrame:
        """``key, node, n, at, before, class`` of the nodes: the place of a key and the key before it.

        ``class`` is that of ``classes(node, component)``, null for a node that is in none.
        """
        keyed = keyed_sets(self.source, frequent, threshold).filter("doc_id IS NOT NULL").join(self.others, "doc_id", "left_anti")
        keyed = keyed.withColumn("class", F.lit(None).cast("long"))
        if classes is not None:
            found = broadcast_if_small(classes.select(F.col("node").alias("doc_id"), F.col("component").alias("class")))
            keyed = keyed.drop("class").join(found, "doc_id", "left")
        keyed = keyed.select("doc_id", "n", "class", F.posexplode("keys").alias("i", "key"), "keys", "places")
        return keyed.select(
            "key", F.col("doc_id").alias("node"), "n", F.get("places", F.col("i")).alias("at"), F.get("keys", F.col("i") - 1).alias("before"), "class"
        )


def head_links(sets: Sets, threshold: int) -> DataFrame:
    """``a, b`` of links between a node and the smallest one with a least hash of its own: LEAST_HASHES pairs a node at most are tried."""
    spots = sets.nodes.filter("n > 1").select("node", "n", F.posexplode("least").alias("i", "h"))
    heads = spots.groupBy("i", "h").agg(F.min(F.struct("node", "n")).alias("head"), F.max("node").alias("last")).filter("head.node <> last")
    heads = heads.select("i", "h", F.col("head.node").alias("a"), F.col("head.n").alias("n_a"))
    near = 100 * F.least("n", "n_a") >= threshold * F.greatest("n", "n_a")
    pairs = spots.join(heads, ["i", "h"]).filter((F.col("a") < F.col("node")) & near).select("a", F.col("node").alias("b")).distinct()
    return stored(verified(pairs, sets, threshold).select("a", "b"))


def frequent_class(sets: Sets, threshold: int, most_nodes: int) -> np.ndarray:
    """Shingles that more than ``most_nodes`` nodes have, as far as they can come into a prefix.

    Prefixes alone do not tell: frequent shingles leave them and others move up, those of
    the same passage as a rule.  A prefix is about the lowest quarter of a set, so the
    lower half is counted for all nodes, and the upper half for those whose prefixes
    reach into it without the lower half's frequent shingles.  The second class changes no
    other prefix, so no shingle is a single key of more than ``most_nodes`` nodes.
    """

    def often(halves: DataFrame) -> DataFrame:
        # Only the counts of the keys that many nodes have leave the pass.
        halves = halves.filter("doc_id IS NOT NULL").join(sets.others, "doc_id", "left_anti").select(F.explode("keys").alias("key"))
        return cut(halves.groupBy("key").agg(F.count("*").alias("nodes")).filter(F.col("nodes") > most_nodes).select(F.col("key").alias("token")))

    lower = often(halves_of_sets(sets.source, threshold))
    upper = often(halves_of_sets(sets.source, threshold, held_tokens(lower)))
    return held_tokens(lower.unionByName(upper))


def all_links(sets: Sets, threshold: int, most_nodes: int = MOST_NODES, classes: DataFrame | None = None) -> DataFrame:
    """``a, b, shared, n_a, n_b`` of all links between nodes, a < b; with ``classes`` of those between different classes."""

    frequent = frequent_class(sets, threshold, most_nodes)
    # Both sides of the join are one shuffle of the index; keys of one node end there.
    index = sets.keyed(frequent, threshold, classes)
    left, right = (
        index.select(
            F.col("key").alias(f"key_{x}"), F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n_{x}"),
            F.col("at").alias(f"pos_{x}"), F.col("before").alias(f"before_{x}"), F.col("class").alias(f"class_{x}"),
        )
        for x in "ab"
    )
    # Places rise along the keys of a set, so the pair passes for the key before as well.
    first = F.coalesce(F.col("before_a") != F.col("before_b"), F.lit(True))
    apart = F.coalesce(F.col("class_a") != F.col("class_b"), F.lit(True))
    tried = left.join(right, (F.col("key_a") == F.col("key_b")) & (F.col("node_a") < F.col("node_b")) & apart & first & may_link("a", "b", threshold))
    return verified(tried.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), sets, threshold)


def jaccard_links(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, most_nodes: int = MOST_NODES
) -> DataFrame:
    """``a, b, shared, n_a, n_b`` of each link between two distinct sets, a < b.

    A set goes by its node, the smallest id of the documents that have it; ``shared`` is
    the size of the intersection, ``n_a`` and ``n_b`` those of the sets.  With
    ``set_members`` this gives all linked documents: those of one node link with each
    other, and with those of every linked node.
    """
    return all_links(Sets.of(docs, doc_id, text), threshold, most_nodes)


def set_members(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, node`` for each row: the node of its set, null for the empty set."""
    return Sets.of(docs, doc_id, text).members().drop("sig")


def jaccard_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: int = THRESHOLD,
    most_pairs: int = MOST_PAIRS,
    shortcut: bool = False,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the row's own included.
    Words are runs without ASCII white space, A-Z lower-cased.  A text with fewer words
    than five has its whole sequence as its only shingle; a null or empty text has none
    and is linked with nothing.  Rows with a null id are counted but start no component:
    their component is that of the texts they link with, else null.  Repeated rows come
    out once each.  Ids must name one text; other columns are not read.

    Near copies are linked with the head of their class first, and then all pairs are
    tried whose nodes are not in one class already: a group of near copies costs its nodes,
    not its pairs, and no component can change.  ``jaccard_links`` has all links.
    ``shortcut`` gives the same components from fewer links between classes;
    ``most_pairs`` is its measure of dense groups.
    """
    sets = Sets.of(docs, doc_id, text)
    if shortcut:
        # Written first: a task that verifies and builds forests at once would hold two Python workers.
        links = stored(linked_components(sets, threshold, most_pairs).select("a", "b"))
    else:
        inside = head_links(sets, threshold)
        classes = cut(connected_components(inside))
        links = inside.unionByName(stored(all_links(sets, threshold, classes=classes).select("a", "b")))
    labels = connected_components(links)
    out = sets.members().join(labels, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    alone = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


def linked_components(sets: Sets, threshold: int, most_pairs: int) -> DataFrame:
    """``a, b`` of links that join the same components as all links do."""
    def indexed(frequent: np.ndarray) -> DataFrame:
        """``key, node, pos, n, head, pos_h, n_h`` of keys that several nodes have; head is the smallest of them."""
        # Size and place travel as one number.
        spot = F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")
        keyed = sets.keyed(frequent, threshold).select("key", "node", spot.alias("spot"))
        group = Window.partitionBy("key")
        keyed = keyed.withColumn("h", F.min(F.struct("node", "spot")).over(group)).withColumn("last", F.max("node").over(group))
        size = lambda c: F.shiftright(c, 32).cast("int")
        place = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        return stored(
            keyed.filter("h.node <> last").select(
                "key", "node", place("spot").alias("pos"), size("spot").alias("n"),
                F.col("h.node").alias("head"), place("h.spot").alias("pos_h"), size("h.spot").alias("n_h"),
            )
        )

    index = indexed(np.empty(0, np.uint64))
    # The head that a node shares most keys with: what links here is one component.
    heads = index.filter("head <> node").select(
        F.col("head").alias("a"), F.col("pos_h").alias("pos_a"), F.col("n_h").alias("n_a"),
        F.col("node").alias("b"), F.col("pos").alias("pos_b"), F.col("n").alias("n_b"),
    )
    heads = heads.filter(may_link("a", "b", threshold)).groupBy("a", "b").agg(F.count("*").alias("keys"))
    heads = heads.groupBy("b").agg(F.min(F.struct(-F.col("keys"), "a")).alias("best"))
    heads = cut(heads.select(F.col("best.a").alias("a"), "b"))
    links = cut(verified(heads, sets, threshold).select("a", "b"))

    def by_component(index: DataFrame) -> DataFrame:
        """``key, pos, node, n, component`` of the keys whose nodes are in different components."""
        placed = index.select("key", "pos", "node", "n").join(broadcast_if_small(labels), "node", "left")
        placed = placed.withColumn("component", F.coalesce("component", "node"))
        group = Window.partitionBy("key")
        placed = placed.withColumn("lo", F.min("component").over(group)).withColumn("hi", F.max("component").over(group))
        return stored(placed.filter("lo <> hi").drop("lo", "hi"))

    for turn in range(ROUNDS + 1):
        labels = cut(connected_components(links))
        placed = by_component(index)
        parts = cut(placed.groupBy("key", "component").agg(F.count("*").alias("n")))
        dense = parts.groupBy("key").agg(
            ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"),
            F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("largest"),
        )
        dense = cut(dense.filter(F.col("pairs") > most_pairs).select("key", (-F.col("largest.c")).alias("main")))
        if turn == ROUNDS or dense.isEmpty():
            break
        # Near copies that their head did not link: each is tried against some nodes of
        # the largest component of its keys, others in every round.
        chance = F.xxhash64("key", "node", F.lit(turn))
        inside = placed.join(dense, "key")
        chosen = inside.filter("component = main").groupBy("key").agg(F.min(F.struct(chance.alias("x"), "node", "pos", "n")).alias("h"))
        chosen = chosen.select("key", F.col("h.node").alias("a"), F.col("h.pos").alias("pos_a"), F.col("h.n").alias("n_a"))
        outside = inside.filter("component <> main").select(
            F.col("key").alias("k"), F.col("node").alias("b"), F.col("pos").alias("pos_b"), F.col("n").alias("n_b")
        )
        tries = outside.join(chosen, (F.col("k") == F.col("key")) & may_link("a", "b", threshold))
        tries = tries.groupBy("a", "b").agg(F.count("*").alias("keys"))
        order = Window.partitionBy("b").orderBy(F.desc("keys"), F.xxhash64("a", "b", F.lit(turn)))
        tries = tries.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= TRIES).select("a", "b")
        links = cut(links.unionByName(verified(tries, sets, threshold).select("a", "b")))
    frequent = held_tokens(dense.select(F.col("key").alias("token")))
    if len(frequent):
        placed = by_component(indexed(frequent))
    left, right = (
        placed.select(F.col("key").alias(f"key_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("node", "pos", "n", "component"))) for x in "ab"
    )
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
    rest = left.join(right, (F.col("key_a") == F.col("key_b")) & apart & may_link("a", "b", threshold))
    rest = rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    return links.unionByName(verified(rest, sets, threshold).select("a", "b"))


MOST_FREQUENT = 4_000_000


def held_tokens(frequent: DataFrame) -> np.ndarray:
    """The frequent class in order of hash; empty where it is too large to hold.

    Without a class all shingles are indexed singly, which finds the same links.
    """
    if frequent.count() > MOST_FREQUENT:
        return np.empty(0, np.uint64)
    found = frequent.toArrow().column("token").to_numpy().view(np.uint64)
    return np.sort(found)


SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(w)]
        ELSE list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i + 4])) END)) AS s FROM words),
reps AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tok AS (SELECT node, n, unnest(s) AS t FROM reps WHERE n > 1),
few AS (SELECT t FROM tok GROUP BY t HAVING count(*) > 1),
kept AS (SELECT node, n, t FROM tok SEMI JOIN few USING (t)),
pairs AS (
    SELECT a.node AS a, b.node AS b, count(*) AS shared, min(a.n) AS na, min(b.n) AS nb
    FROM kept a JOIN kept b ON a.t = b.t AND a.node < b.node AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
    GROUP BY a.node, b.node),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (na + nb - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT DISTINCT a AS node, a AS goal FROM both_ways
    UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.goal),
comp AS (SELECT node, min(goal) AS component FROM reach GROUP BY node),
named AS (SELECT s, coalesce(component, node) AS component_id FROM reps LEFT JOIN comp USING (node))
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN named ON sets.s = named.s"""


@query("op9_jaccard_join", SQL)
def op9(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))

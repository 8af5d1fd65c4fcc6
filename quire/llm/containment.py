"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document when the document holds at least the given share of
the item's distinct five-word shingles, wherever they stand and however long the
document is.  Items are partitioned by size, in powers of two.  The items of a
partition are probed by their bottom-k MinHash sketch, the k shingles of smallest hash.
With containment of at least t, at most n - ceil(t n) of the n shingles of an item are
missing, so a sketch of one more than that cannot miss the document altogether: k is
chosen per size for that, and the search loses nothing.  Documents too small for a
size partition do not probe it.  Candidates are verified on the shingles themselves.

The items are the stated query set.  They are read in blocks of bounded bytes; each
block goes to every task, which probes and verifies in one pass over its documents.
No text is shuffled, and a document of any length is one row of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import cut
from quire.llm.words import shingle_sets, slices, texts_of
from quire.session import broadcast_if_small

WIDTH = 5
THRESHOLD = 75  # per cent
BLOCK_BYTES = 8 << 20


def needed(size: int, threshold: int = THRESHOLD) -> int:
    """Fewest shared shingles: the smallest m with 100 m >= threshold * size."""
    return -(-threshold * size // 100)


def sequences(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = text.lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


@dataclass
class SizeClass:
    """Items of one size partition: sketch hashes in order, and the item of each."""

    smallest: int  # shingles a document must hold to contain any of them
    hashes: np.ndarray
    items: np.ndarray


class Block:
    """A block of items, ready for probing."""

    def __init__(self, ids: list, texts: list[bytes], width: int, threshold: int) -> None:
        self.ids, self.texts, self.width, self.threshold = ids, texts, width, threshold
        parts: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.sizes = []
        for k, hashes in enumerate(shingle_sets(texts, width)):
            self.sizes.append(len(hashes))
            if len(hashes):
                sketch = hashes[: len(hashes) - needed(len(hashes), threshold) + 1]
                parts.setdefault(len(hashes).bit_length(), []).append((k, sketch))
        self.classes = []
        for size in sorted(parts):
            hashes = np.concatenate([s for _, s in parts[size]])
            items = np.repeat([k for k, _ in parts[size]], [len(s) for _, s in parts[size]])
            order = np.argsort(hashes, kind="stable")
            smallest = min(needed(self.sizes[k], threshold) for k, _ in parts[size])
            self.classes.append(SizeClass(smallest, hashes[order], items[order]))
        self.exact: dict[int, set] = {}

    def candidates(self, document: np.ndarray) -> list[int]:
        """Items one of whose sketch hashes is in the document's sorted hashes."""
        found = []
        for part in self.classes:
            if len(document) < part.smallest:
                break  # the later ones are larger
            if len(part.hashes) < len(document):
                place = np.minimum(np.searchsorted(document, part.hashes), len(document) - 1)
                hit = document[place] == part.hashes
            else:
                place = np.minimum(np.searchsorted(part.hashes, document), len(part.hashes) - 1)
                hit = np.isin(part.hashes, document[part.hashes[place] == document])
            if hit.any():
                found.append(np.unique(part.items[hit]))
        return np.concatenate(found).tolist() if found else []

    def shared(self, text: bytes, items: list[int]) -> list[tuple[int, int]]:
        """(item, shingles shared with the text) for those that reach the threshold."""
        held, out = sequences(text, self.width), []
        for k in items:
            if k not in self.exact:
                self.exact[k] = sequences(self.texts[k], self.width)
            both = len(self.exact[k] & held)
            if both >= needed(len(self.exact[k]), self.threshold):
                out.append((k, both))
        return out


def item_blocks(items: DataFrame) -> Iterator[tuple[list, list[bytes]]]:
    """The items in blocks of about BLOCK_BYTES, read partition by partition."""
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row[0])
        texts.append((row[1] or "").encode())
        size += len(texts[-1])
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared`` for each document row and item it contains.

    ``n_shingles`` counts the item's distinct shingles, ``n_shared`` those in the
    document; 100 * n_shared >= threshold * n_shingles.  Words are runs without ASCII
    white space, A-Z lower-cased.  A text with fewer words than ``width`` has its whole
    sequence as its only shingle; null and empty texts and items contain nothing and are
    found nowhere.  Repeated rows are reported once each; other columns are not read.
    Without items, or without documents, the result is empty.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shingles int, n_shared int"
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    wanted = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    found = []
    for ids, texts in item_blocks(wanted):
        block = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            probe = Block(*block.value, width, threshold)
            for batch in slices(batches):
                keys, documents = batch.column(0).to_pylist(), texts_of(batch.column(1))
                rows = []
                for k, hashes in enumerate(shingle_sets(documents, width)):
                    if len(hashes) and (maybe := probe.candidates(hashes)):
                        for item, both in probe.shared(documents[k], maybe):
                            rows.append((keys[k], probe.ids[item], probe.sizes[item], both))
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "n_shingles", "n_shared"])

        found.append(source.mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item; all their columns.

    A row with a null id is kept or dropped by its text like any other.
    """
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(options.get("text", "text"))))
    found = find_items(keyed.select("_key", options.get("text", "text")), items, doc_id="_key", **options)
    found = broadcast_if_small(cut(found.select(F.col("doc_id").alias("_key")).distinct()))
    return keyed.join(found, "_key", "left_anti").drop("_key")


SQL = r"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
grams AS (
    SELECT kind, id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [w]
        ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END)) AS g
    FROM words WHERE len(w) > 0),
sizes AS (SELECT id, count(*) AS n FROM grams WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, CAST(min(n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared
FROM (SELECT id, g FROM grams WHERE kind = 'd') d
JOIN (SELECT id, g FROM grams WHERE kind = 'b') b ON d.g = b.g
JOIN sizes s ON s.id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * min(n)"""


@query("op6_decontamination", SQL)
def op6(spark, sf_dir):
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

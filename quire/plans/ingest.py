"""Loading a source into the corpus tables, and rebuilding what derives from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quire.model import ENTITY_KINDS, TABLES
from quire.operators import bm25, browse, postings, sketches, vectors
from quire.operators.chunking import chunk_papers, stable_chunk_ids
from quire.plans import enrichment
from quire.sources import store
from quire.sources.store import TableStore


STAGED, STAGED_CHUNKS = "staged_papers", "staged_chunks"


def add_papers(tables: TableStore, incoming: DataFrame, order: str | None = None) -> None:
    """Append papers with new ids and their authors; loading a source twice changes nothing.

    Of several rows with one id the first counts, by ``order`` or else as they come.
    The choice is written once, and both appends read it, so a paper and its authors
    are always from the same row.
    """
    if order is None:
        order = "load_order"
        incoming = incoming.withColumn(order, F.monotonically_increasing_id())
    tables.overwrite(STAGED, store.new_papers(tables.read("papers"), incoming, order))
    fresh = tables.read(STAGED)
    rows = store.new_author_rows(tables.read("authors"), store.author_rows(fresh))
    tables.append("authors", rows.select(*TABLES["authors"].names))
    tables.append("papers", fresh.withColumn("created_at", F.current_timestamp()).select(*TABLES["papers"].names))


def rebuild_chunks(tables: TableStore, strategy: str = "fixed") -> None:
    """Replace all chunks; a chunk that did not change keeps its id."""
    chunks = stable_chunk_ids(chunk_papers(tables.read("papers"), strategy))
    # Checked before it becomes the version that others read.
    tables.overwrite(STAGED_CHUNKS, chunks.select(*TABLES["chunks"].names))
    fresh = tables.read(STAGED_CHUNKS)
    twice = fresh.groupBy("id").count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"two chunks have the id {twice[0]['id']}")
    tables.overwrite("chunks", fresh)


def rebuild_index(tables: TableStore, path: str, analyzer: str = "letters") -> None:
    chunks = tables.read("chunks")
    bm25.write_index(bm25.build_index(chunks, analyzer, id_column="id"), path, version=chunks_version(chunks))


def rebuild_blocks(tables: TableStore, path: str, analyzer: str = "letters") -> None:
    """The index of blocks, with year and venue of the papers to filter on."""
    chunks = tables.read("chunks")
    rows = browse.chunks_with_papers(chunks, tables.read("papers"))
    postings.write_blocks(rows, path, analyzer, ("year", "venue"), chunks_version(chunks), id_column="id")


def open_blocks(tables: TableStore, path: str) -> postings.BlockIndex:
    """The written index of blocks; one that was built from other chunks is refused."""
    return postings.read_blocks(tables.spark, path, version=chunks_version(tables.read("chunks")))


def open_index(tables: TableStore, path: str) -> bm25.Bm25Index:
    """The written index; one that was built from other chunks is refused."""
    return bm25.read_index(tables.spark, path, version=chunks_version(tables.read("chunks")))


def chunks_version(chunks: DataFrame) -> str:
    """A digest of the set of chunks."""
    row = chunks.agg(F.count("*").alias("n"), F.bit_xor("id").alias("x"), F.sum(F.col("id") % 1_000_003).alias("s")).first()
    return f"{row['n']}-{row['x'] or 0}-{row['s'] or 0}"


def pair_vectors(chunks: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors whose chunk is still there, and chunks that have none."""
    kept = existing.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select(*existing.columns)
    missing = chunks.join(existing.select(F.col("chunk_id").alias("id")), "id", "left_anti").select(*chunks.columns)
    return kept, missing


def embed_chunks(tables: TableStore, encoder: Callable[[list[str]], np.ndarray], only_new: bool = True) -> None:
    """Give every chunk its vector, and drop vectors of chunks that are gone.

    Only chunks without a vector are encoded, or, with ``only_new`` off, all of them.
    """
    chunks, existing = tables.read("chunks"), tables.read("embeddings")
    kept, missing = pair_vectors(chunks, existing if only_new else existing.limit(0))
    meta = tables.read("papers").select(F.col("id").alias("paper_id"), "title", "year", "venue")
    encoded = vectors.encode(missing, "chunk_text", encoder).join(meta, "paper_id")
    rows = encoded.withColumnRenamed("id", "chunk_id").select(*TABLES["embeddings"].names)
    tables.overwrite("embeddings", kept.select(*TABLES["embeddings"].names).unionByName(rows))


def update_full_texts(tables: TableStore, updates: DataFrame) -> None:
    from quire.sources.fulltext import update_full_text

    tables.overwrite("papers", update_full_text(tables.read("papers"), updates))


def enrich_papers(
    tables: TableStore, lexicon: list[tuple[str, str]] | DataFrame | None = None, max_papers: int | None = None
) -> dict[str, int]:
    """Append the entities of papers that have none, and count them; with ``max_papers`` of the newest only.

    Newest is by year, then by time of loading; ties go to the smaller id.
    """
    todo = enrichment.unenriched(tables.read("papers"), tables.read("entities"))
    if max_papers is not None:
        todo = enrichment.newest(todo, max_papers)
    return append_entities(tables, enrichment.enrich(todo, lexicon))


STAGED_ENTITIES, SKETCHES = "staged_entities", "entity_sketches"


def append_entities(tables: TableStore, rows: DataFrame) -> dict[str, int]:
    """Append entity rows; the numbers of rows in all and by type, observed while they are written.

    Rows are computed once.  The kept sketches of the distinct names and papers are
    united with sketches of the new rows; nothing old is read.
    """
    seen = Observation("appended")
    types = {f"{kind}": F.count_if(F.col("entity_type") == value) for kind, value in ENTITY_KINDS.items()}
    observed = rows.select(*TABLES["entities"].names).observe(seen, F.count("*").alias("rows"), *(c.alias(n) for n, c in types.items()))
    kept = entity_sketches(tables)
    tables.overwrite(STAGED_ENTITIES, observed)
    fresh = tables.read(STAGED_ENTITIES)
    tables.append("entities", fresh)
    tables.overwrite(SKETCHES, sketches.united(kept, sketches.distinct_sketches(fresh)))
    return dict(seen.get)


def entity_sketches(tables: TableStore) -> DataFrame:
    """The kept sketches of the entities; made again where rows came or went without them."""
    entities = tables.read("entities")
    if tables.exists(SKETCHES):
        kept = tables.read(SKETCHES)
        # The number of rows is in the files' footers.
        if (kept.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]) == entities.count():
            return kept
    return sketches.distinct_sketches(entities)

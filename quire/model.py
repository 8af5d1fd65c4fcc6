"""Schemas of the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAPERS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("abstract", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("venue", T.StringType()),
        T.StructField("volume", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

AUTHORS = T.StructType(
    [
        T.StructField("paper_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("position", T.IntegerType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("paper_id", T.StringType(), False),
        T.StructField("chunk_text", T.StringType(), False),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("token_count", T.IntegerType()),
    ]
)

# One table for methods, datasets, tasks and topics; ``attr`` is the method type
# of a method and the task type of a dataset.
ENTITIES = T.StructType(
    [
        T.StructField("paper_id", T.StringType(), False),
        T.StructField("entity_type", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("attr", T.StringType()),
    ]
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
        T.StructField("paper_id", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("venue", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)

TABLES = {"papers": PAPERS, "authors": AUTHORS, "chunks": CHUNKS, "entities": ENTITIES, "embeddings": EMBEDDINGS}

# Plural entity kind -> value of ``entity_type``.
ENTITY_KINDS = {"methods": "method", "datasets": "dataset", "tasks": "task", "topics": "topic"}


def entity_type(kind: str) -> str:
    """Value of ``entity_type`` for a plural kind; unknown kinds are an error."""
    if kind not in ENTITY_KINDS:
        raise ValueError(f"unknown entity type {kind!r}, use one of {sorted(ENTITY_KINDS)}")
    return ENTITY_KINDS[kind]


def entities_of(entities: DataFrame, kind: str) -> DataFrame:
    return entities.filter(F.col("entity_type") == entity_type(kind))


def check_range(name: str, value: int | None, low: int, high: int | None) -> None:
    """Argument limits of the service interface; ``high`` may be open."""
    if value is not None and (value < low or (high is not None and value > high)):
        bounds = f"at least {low}" if high is None else f"between {low} and {high}"
        raise ValueError(f"{name} must be {bounds}, got {value}")

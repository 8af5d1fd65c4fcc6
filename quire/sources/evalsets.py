"""Evaluation files: datasets, judged sets, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET_SCHEMA = (
    "name string, description string, examples array<struct<query:string, relevant_paper_ids:array<string>, "
    "reference_answer:string, keywords:array<string>, metadata:map<string,string>>>"
)

EVAL_SET_SCHEMA = (
    "id string, question string, type string, expected_keywords array<string>, relevant_chunk_ids array<string>, "
    "irrelevant_chunk_ids array<string>, skipped_chunk_ids array<string>, relevant_paper_ids array<string>, "
    "pooled_from map<string,array<string>>, annotated_at string, "
    "generation_scores struct<faithfulness:boolean, relevance:int, citation_accuracy:boolean>"
)

QUESTION_SCHEMA = "id string, question string, type string, expected_keywords array<string>, created_at string"
QUESTION_TYPES = ["factual", "comparison", "analytical", "unanswerable"]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a dataset file; the file's name stands in for a missing name."""
    data = _read(spark, path, DATASET_SCHEMA)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1)
    rows = data.select(
        F.coalesce("name", stem).alias("dataset"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.posexplode("examples").alias("position", "example"),
    )
    return rows.select(
        "dataset",
        "description",
        "position",
        "example.query",
        "example.relevant_paper_ids",
        "example.reference_answer",
        F.coalesce("example.keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("example.metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def read_eval_set(spark: SparkSession, path: str, judged_only: bool = True) -> DataFrame:
    """Judged questions; by default those with a relevant chunk."""
    data = _read(spark, path, EVAL_SET_SCHEMA)
    return data.filter(F.size("relevant_chunk_ids") > 0) if judged_only else data


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, QUESTION_SCHEMA)


def generation_scores(eval_set: DataFrame) -> DataFrame:
    return eval_set.filter(F.col("generation_scores").isNotNull()).select("id", "generation_scores.*")

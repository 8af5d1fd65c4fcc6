"""From raw documents to token files: quality, near copies, benchmark leaks, mixture, tokens.

Each stage is one operator of ``quire.llm`` applied to all that the stage before kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ORACLES, QUERIES
from quire.llm.containment import clean_documents
from quire.llm.fourier_quality import score_quality
from quire.llm.jaccard_join import jaccard_components
from quire.llm.mixing import mix_sources
from quire.llm.registry import query, table
from quire.llm.shared import cut, new_folder, stored
from quire.llm.token_store import default_vocabulary, read_tokens, write_tokens
from quire.session import broadcast_if_small

__all__ = ["ORACLES", "ORACLE_SQL", "QUERIES", "STAGES", "run"]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in ``ids(doc_id)``; the texts stay in place while the ids are measured to be few."""
    return docs.join(broadcast_if_small(cut(ids)), "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; rows without an id are judged by their text too."""
    found = score_quality(docs, table(spark, sf_dir, "labels"))
    # Rows of one id differ in text at most; an id goes when all of its rows are rejected.
    rejected = found.groupBy("doc_id").agg(F.max("predicted").alias("best")).filter("best = 0 AND doc_id IS NOT NULL")
    return without(docs, rejected.select("doc_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts, the one of smallest id; one row of each id."""
    found = stored(jaccard_components(docs))
    # Copies of one row are one document.
    other = found.filter("doc_id <> component_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    kept = without(docs, other)
    if again.isEmpty():
        return kept
    once = without(kept, again)
    return once.unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    taken = mix_sources(docs).filter("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    taken = broadcast_if_small(cut(taken.select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"))))
    often = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")))
    return often.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture; one row per document, read back from them."""
    folder = new_folder(spark, "tokens")
    write_tokens(docs, folder, default_vocabulary())
    return read_tokens(spark, folder)


STAGES = [
    ("quality classifier", quality),
    ("near copies", near_copies),
    ("benchmark leaks", leaks),
    ("source mixture", mixture),
    ("token files", tokens),
]
# A trained classifier is the first stage, and a tokenizer the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline")(run)

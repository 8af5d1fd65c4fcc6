"""Pools of candidates from several rankers, and the judged sets made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.ids import question_number
from quire.operators.metrics import union_all


def pool(lists: list[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, chunk_id, position, methods): each candidate once, where the
    first list that has it puts it, with the names of all lists that have it."""
    rows = union_all(
        [
            ranked.select("query_id", "chunk_id", "rank", F.lit(i).alias("list_no"), F.lit(name).alias("method"))
            for i, (name, ranked) in enumerate(lists)
        ]
    )
    seen = rows.groupBy("query_id", "chunk_id").agg(
        F.min(F.struct("list_no", "rank")).alias("first"),
        F.transform(F.array_sort(F.collect_set(F.struct("list_no", "method"))), lambda m: m["method"]).alias("methods"),
    )
    order = Window.partitionBy("query_id").orderBy("first")
    return seen.withColumn("position", F.row_number().over(order)).drop("first")


def pooled_ids(lists: list[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, pooled_from): map of list name -> ids as text, best first.  Lists are bounded top-k."""
    named = [
        ranked.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("id")))).alias("r"))
        .select("query_id", F.lit(name).alias("method"), F.transform("r", lambda x: x["id"]).alias("ids"))
        for name, ranked in lists
    ]
    pairs = union_all(named).groupBy("query_id").agg(F.collect_list(F.struct("method", "ids")).alias("m"))
    return pairs.select("query_id", F.map_from_entries("m").alias("pooled_from"))


def method_lists(eval_set: DataFrame) -> DataFrame:
    """(query_id, method, item_id, rank) of an evaluation set's pools, entries with judgements only."""
    judged = eval_set.filter(F.size("relevant_chunk_ids") > 0)
    by_method = judged.select(F.col("id").alias("query_id"), F.explode("pooled_from").alias("method", "ids"))
    return by_method.select("query_id", "method", F.posexplode("ids").alias("pos", "item_id")).select(
        "query_id", "method", "item_id", (F.col("pos") + 1).alias("rank")
    )


def relevant_papers(judged: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, paper_id, position): papers of the judged chunks (query_id,
    chunk_id, position), each at its first chunk."""
    found = judged.join(chunks.select("chunk_id", "paper_id"), "chunk_id")
    first = found.groupBy("query_id", "paper_id").agg(F.min("position").alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "paper_id")
    return first.withColumn("position", F.row_number().over(order)).drop("at")


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace rows with the same key; other rows stay."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def next_question_id(questions: DataFrame) -> DataFrame:
    """The id after the highest ``qNNN``, padded to three digits."""
    number = F.coalesce(F.max(question_number(F.col("id"))), F.lit(0)) + 1
    return questions.agg(F.format_string("q%03d", number).alias("next_id"))

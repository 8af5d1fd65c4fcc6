"""Retrieval and answer metrics, for all queries and cut-offs in one pass."""

from __future__ import annotations

import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K_VALUES = (1, 3, 5, 10)
_WORD = re.compile(r"\w+")


def metric_names(k_values: tuple[int, ...] = K_VALUES, hit_rate: bool = False) -> list[str]:
    kinds = ["precision", "recall", "ndcg"] + (["hit_rate"] if hit_rate else [])
    return ["mrr"] + [f"{kind}@{k}" for k in k_values for kind in kinds]


def retrieval_metrics(
    queries: DataFrame,
    retrieved: DataFrame,
    relevant: DataFrame,
    k_values: tuple[int, ...] = K_VALUES,
    keys: tuple[str, ...] = ("query_id",),
    hit_rate: bool = False,
) -> DataFrame:
    """One row per query: mrr and precision, recall, ndcg (and hit_rate) at each k.

    ``retrieved`` has the keys, item_id and rank; ``relevant`` query_id and item_id.
    A query without relevant or retrieved items scores zero.
    """
    judged = relevant.select("query_id", "item_id").distinct()
    totals = judged.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    rank = F.col("rank")
    per_k: list[Column] = []
    for k in k_values:
        inside = rank <= k
        per_k += [
            F.count_if(inside).alias(f"_hits@{k}"),
            F.sum(F.when(inside, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)).alias(f"_dcg@{k}"),
        ]
    hits = (
        retrieved.select(*keys, "item_id", "rank")
        .join(judged, ["query_id", "item_id"])
        .groupBy(*keys)
        .agg(F.min("rank").alias("_first"), *per_k)
    )
    joined = queries.select(*keys).join(hits, list(keys), "left").join(totals, "query_id", "left")

    def at(kind: str, k: int) -> Column:
        count, n = F.col(f"`_hits@{k}`"), F.col("n_relevant")
        if kind == "precision":
            return count / F.lit(float(k))
        if kind == "recall":
            return F.try_divide(count, n)
        if kind == "hit_rate":
            return (count > 0).cast("double")
        gains = [1.0 / math.log2(i + 2) for i in range(k)]
        ideal = F.array(*[F.lit(math.fsum(gains[: i + 1])) for i in range(k)])
        return F.col(f"`_dcg@{k}`") / F.get(ideal, F.least(n, F.lit(k)).cast("int") - 1)

    columns = {"mrr": F.lit(1.0) / F.col("_first")}
    for name in metric_names(k_values, hit_rate)[1:]:
        kind, k = name.split("@")
        columns[name] = at(kind, int(k))
    return joined.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(name) for name, c in columns.items()])


def macro_average(
    scores: DataFrame, names: list[str], by: tuple[str, ...] = (), missing: str = "zero"
) -> DataFrame:
    """Mean of each metric; a missing value counts as zero or is skipped."""
    if missing not in ("zero", "skip"):
        raise ValueError("missing must be 'zero' or 'skip'")

    def mean(name: str) -> Column:
        value = F.col(f"`{name}`")
        return F.avg(F.coalesce(value, F.lit(0.0)) if missing == "zero" else value).alias(name)

    return scores.groupBy(*by).agg(F.count("*").alias("n"), *[mean(name) for name in names])


def first_per_item(retrieved: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Ranked items with repetitions removed, renumbered from 1."""
    best = retrieved.groupBy(*keys, "item_id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy(*keys).orderBy("rank")
    return best.withColumn("rank", F.row_number().over(order))


def lcs_length(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming
    (Crochemore et al., 2001): one bit per left token, one step per right token."""
    places: dict[str, int] = {}
    for i, token in enumerate(left):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(left)) - 1
    row = full
    for token in right:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def rouge_l(prediction: str | None, reference: str | None) -> float:
    left, right = _WORD.findall((prediction or "").lower()), _WORD.findall((reference or "").lower())
    common = lcs_length(left, right) if left and right else 0
    if not common:
        return 0.0
    precision, recall = common / len(left), common / len(right)
    return 2 * precision * recall / (precision + recall)


@F.pandas_udf(T.DoubleType())
def rouge_l_f1(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """ROUGE-L F1 of whole texts."""
    return pd.Series([rouge_l(p, r) for p, r in zip(prediction, reference, strict=True)], dtype="float64")


def answer_coverage(prediction: Column, keywords: Column) -> Column:
    """Share of the keywords that occur in the prediction as substrings, ignoring case."""
    text = F.lower(prediction)
    hits = F.filter(keywords, lambda k: F.contains(text, F.lower(k)))
    return F.coalesce(F.try_divide(F.size(hits), F.size(keywords)), F.lit(0.0))


def generation_metrics(answers: DataFrame) -> DataFrame:
    """Adds rouge_l_f1 and answer_coverage to (prediction, reference, keywords);
    coverage is null where there are no keywords."""
    covered = answer_coverage(F.col("prediction"), F.col("keywords"))
    return answers.withColumns(
        {
            "rouge_l_f1": rouge_l_f1("prediction", "reference"),
            "answer_coverage": F.when(F.size("keywords") > 0, covered),
        }
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """Share of faithful answers, mean relevance of 5, share of accurate citations."""
    flags = {name: F.avg(F.col(name).cast("int")).alias(name) for name in ("faithfulness", "citation_accuracy")}
    return scores.agg(F.count("*").alias("n"), F.avg("relevance").alias("relevance"), *flags.values())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

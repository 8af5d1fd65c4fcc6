"""Evaluating search and answers, and comparing search configurations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import fusion, metrics, pooling
from quire.operators.bm25 import Bm25Index
from quire.plans.search import SearchConfig, attach_chunks, candidate_lists, held
from quire.session import is_small


def evaluate(
    examples: DataFrame, sources: DataFrame, answers: DataFrame, k_values: tuple[int, ...] = metrics.K_VALUES
) -> DataFrame:
    """Metrics of each example.

    ``examples`` has query_id, relevant_paper_ids, reference_answer and keywords;
    ``sources`` query_id, paper_id and rank; ``answers`` query_id and answer.
    """
    relevant = examples.select("query_id", F.explode("relevant_paper_ids").alias("item_id"))
    ranked = metrics.first_per_item(sources.select("query_id", F.col("paper_id").alias("item_id"), "rank"))
    found = metrics.retrieval_metrics(examples, ranked, relevant, k_values)
    generated = metrics.generation_metrics(
        examples.join(answers.select("query_id", "answer"), "query_id", "left").select(
            "query_id",
            F.coalesce("answer", F.lit("")).alias("prediction"),
            F.col("reference_answer").alias("reference"),
            "keywords",
        )
    )
    return found.join(generated.select("query_id", "rouge_l_f1", "answer_coverage"), "query_id")


def report(per_example: DataFrame, k_values: tuple[int, ...] = metrics.K_VALUES) -> DataFrame:
    """Means over all examples; an example without keywords counts zero coverage."""
    names = metrics.metric_names(k_values) + ["rouge_l_f1", "answer_coverage"]
    return metrics.macro_average(per_example, names, missing="zero")


def evaluate_pools(eval_set: DataFrame, k_values: tuple[int, ...] = metrics.K_VALUES) -> DataFrame:
    """Mean metrics of each pooled method of an evaluation set; entries without
    relevant chunks do not count."""
    judged = eval_set.filter(F.size("relevant_chunk_ids") > 0)
    relevant = judged.select(F.col("id").alias("query_id"), F.explode("relevant_chunk_ids").alias("item_id"))
    asked = judged.select(F.col("id").alias("query_id"), F.explode(F.map_keys("pooled_from")).alias("method"))
    scores = metrics.retrieval_metrics(
        asked, pooling.method_lists(eval_set), relevant, k_values, ("query_id", "method"), hit_rate=True
    )
    return metrics.macro_average(scores, metrics.metric_names(k_values, True), ("method",), "skip")


@dataclass(frozen=True)
class Ablation:
    name: str
    description: str
    config: SearchConfig = field(default_factory=SearchConfig)


# The standard comparison: names and weights are fixed values.
DEFAULT_ABLATIONS = [
    Ablation("full_pipeline", "both lists at equal weight, then reranked: the standard search", SearchConfig()),
    Ablation("no_reranker", "both lists at equal weight in their fused order", SearchConfig(use_reranker=False)),
    Ablation("bm25_only", "the term list alone, then reranked", SearchConfig(vector_weight=0)),
    Ablation("vector_only", "the vector list alone, then reranked", SearchConfig(bm25_weight=0)),
    Ablation("bm25_heavy", "three parts of the term list to one of the vector list, then reranked", SearchConfig(bm25_weight=3)),
    Ablation("vector_heavy", "three parts of the vector list to one of the term list, then reranked", SearchConfig(vector_weight=3)),
]


def ablation_results(
    index: Bm25Index,
    embeddings: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    ablations: list[Ablation] = DEFAULT_ABLATIONS,
    scorer: Callable[[Column, Column], Column] = fusion.term_overlap,
    top_k: int = 5,
) -> DataFrame:
    """(config, query_id, chunk_id, paper_id, rank) of all configurations.

    Both rankers run once: every configuration weighs the same two lists, and a
    candidate is scored once however many configurations keep it.
    """
    base = ablations[0].config
    if any((a.config.hybrid_top_k, a.config.rrf_k) != (base.hybrid_top_k, base.rrf_k) for a in ablations):
        raise ValueError("configurations compared together need the same hybrid_top_k and rrf_k")
    queries = held(queries)
    lists = candidate_lists(index, embeddings, queries, SearchConfig(hybrid_top_k=base.hybrid_top_k))
    rows = metrics.union_all(
        [
            ranked.select("query_id", "chunk_id", "rank", F.lit(number).alias("list_no"))
            for number, (ranked, _) in enumerate(lists)
        ]
    )
    settings = F.array(
        *[
            F.struct(
                F.lit(a.name).alias("config"),
                F.array(F.lit(float(a.config.bm25_weight)), F.lit(float(a.config.vector_weight))).alias("weights"),
                F.lit(a.config.use_reranker).alias("rerank"),
            )
            for a in ablations
        ]
    )
    per_config = rows.select("*", F.explode(settings).alias("s")).select(
        "query_id",
        "chunk_id",
        "rank",
        "list_no",
        F.col("s.config").alias("config"),
        F.col("s.rerank").alias("rerank"),
        F.get("s.weights", "list_no").alias("list_weight"),
    )
    fused = fusion.fuse_rows(per_config, base.hybrid_top_k, base.rrf_k, ("config", "rerank", "query_id"))
    # One row per candidate, holding its place in each configuration.
    candidates = fused.groupBy("query_id", "chunk_id").agg(
        F.collect_list(F.struct("config", "rerank", "rank")).alias("places")
    )
    texts = queries.select("query_id", "query_text")
    if is_small(texts):
        texts = F.broadcast(texts)
    found = attach_chunks(candidates, chunks, queries, base.hybrid_top_k * len(ablations)).join(texts, "query_id")
    scored = found.select(
        "query_id",
        "chunk_id",
        "paper_id",
        scorer(F.col("query_text"), F.col("chunk_text")).alias("ce_score"),
        "places",
    )
    placed = scored.select("query_id", "chunk_id", "paper_id", "ce_score", F.inline("places"))
    key = F.when(F.col("rerank"), F.col("ce_score")).otherwise(F.lit(0.0))
    order = Window.partitionBy("config", "query_id").orderBy(key.desc(), "rank")
    ranked = placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.select("config", "query_id", "chunk_id", "paper_id", "rank")


def ablation_summary(
    results: DataFrame,
    queries: DataFrame,
    relevant: DataFrame,
    ablations: list[Ablation] = DEFAULT_ABLATIONS,
    k_values: tuple[int, ...] = metrics.K_VALUES,
) -> DataFrame:
    """One row of mean metrics per configuration; a paper counts once per query.

    ``relevant`` has query_id and item_id (paper ids).
    """
    names = F.array(*[F.struct(F.lit(a.name).alias("config"), F.lit(a.description).alias("description")) for a in ablations])
    asked = queries.select("query_id", F.inline(names))
    items = results.select("config", "query_id", F.col("paper_id").alias("item_id"), "rank")
    ranked = metrics.first_per_item(items, ("config", "query_id"))
    scores = metrics.retrieval_metrics(asked, ranked, relevant, k_values, ("config", "query_id"))
    summary = metrics.macro_average(scores, metrics.metric_names(k_values), ("config",))
    texts = {a.name: a.description for a in ablations}
    label = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return summary.withColumn("description", label[F.col("config")])

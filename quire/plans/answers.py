"""Answers from search results: context, prompt, generation, sources."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import fusion

# Wording and layout of context and prompt.
NO_CONTEXT = "No relevant papers found."
UNKNOWN_VENUE = "unknown venue"
BLOCK_RULE = "\n\n---\n\n"
PROMPT_HEAD = "Below are excerpts from relevant research papers.\n\n"
PROMPT_TASK = (
    "Based on the above excerpts, answer the following question. "
    "Cite papers by their number (e.g., [1], [2]) when referencing specific findings."
)
UNAVAILABLE_ANSWER = (
    "⚠ The language model is temporarily unavailable. "
    "Here are the most relevant papers found for your query — "
    "browse the sources below for details."
)
UNAVAILABLE_MODEL = "none (generation failed)"

SYSTEM_PROMPT = (
    "Answer from the given paper excerpts only, cite the papers you use, "
    "and say so when the excerpts are not enough."
)


@dataclass
class Generation:
    answer: str
    model: str
    usage: dict[str, Any] = field(default_factory=dict)


class Backend(Protocol):
    """A language model.  Instances travel to the tasks, so they must pickle."""

    name: str

    def is_available(self) -> bool: ...

    def generate(
        self, prompt: str, system_prompt: str | None = None, max_tokens: int = 1024, temperature: float = 0.1
    ) -> Generation: ...


class RateLimited(Exception):
    """Raised by a backend that asks its caller to slow down."""


class WithFallback:
    """Try ``first``; on a rate limit wait and retry, then use ``second`` for good."""

    def __init__(self, first: Backend, second: Backend, retries: int = 1, wait_seconds: float = 1.0):
        self.first, self.second = first, second
        self.retries, self.wait_seconds = retries, wait_seconds
        self.fell_back = False

    @property
    def name(self) -> str:
        return (self.second if self.fell_back else self.first).name

    def is_available(self) -> bool:
        return self.first.is_available() or self.second.is_available()

    def generate(self, prompt: str, system_prompt: str | None = None, max_tokens: int = 1024, temperature: float = 0.1):
        arguments = (prompt, system_prompt, max_tokens, temperature)
        for attempt in range(0 if self.fell_back else self.retries + 1):
            try:
                return self.first.generate(*arguments)
            except RateLimited:
                if attempt < self.retries:
                    time.sleep(self.wait_seconds)
        if not self.fell_back and not self.second.is_available():
            raise RateLimited(self.first.name)
        self.fell_back = True
        return self.second.generate(*arguments)


def context_blocks(results: DataFrame, queries: DataFrame, context_k: int = 5) -> DataFrame:
    """(query_id, query_text, context): numbered excerpts of the first results.

    At most ``context_k`` rows of a query are grouped.
    """
    number = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "))
    venue = F.coalesce(F.nullif("venue", F.lit("")), F.lit(UNKNOWN_VENUE))
    year = F.coalesce(F.col("year").cast("string"), F.lit("None"))
    header = F.concat(number, F.lit('"'), "title", F.lit('" ('), venue, F.lit(", "), year, F.lit(")"))
    block = F.concat(header, F.lit("\n"), "chunk_text")
    blocks = (
        results.filter(F.col("rank") <= context_k)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
        .select("query_id", F.array_join(F.transform("blocks", lambda b: b["block"]), BLOCK_RULE).alias("context"))
    )
    return (
        queries.select("query_id", "query_text")
        .join(blocks, "query_id", "left")
        .withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))
    )


def prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit(PROMPT_HEAD), context, F.lit("\n\n---\n\n" + PROMPT_TASK + "\n\nQuestion: "), question
    )


def generate(
    prompts: DataFrame,
    backend: Backend,
    column: str = "prompt",
    system_prompt: str = SYSTEM_PROMPT,
    max_tokens: int = 1024,
    temperature: float = 0.1,
) -> DataFrame:
    """Add ``answer`` and ``model``; a failed call gives the fixed answer, not an error."""

    @F.pandas_udf("answer string, model string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                try:
                    result = backend.generate(text, system_prompt, max_tokens, temperature)
                    rows.append((result.answer, result.model))
                except Exception:
                    rows.append((UNAVAILABLE_ANSWER, UNAVAILABLE_MODEL))
            yield pd.DataFrame(rows, columns=["answer", "model"])

    return prompts.withColumn("generated", run(F.col(column))).select("*", "generated.*").drop("generated")


def answer(results: DataFrame, queries: DataFrame, backend: Backend, context_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Answers per query and their source papers."""
    asked = context_blocks(results, queries, context_k)
    asked = asked.withColumn("prompt", prompt(F.col("query_text"), F.col("context")))
    return generate(asked, backend), fusion.sources(results, context_k)

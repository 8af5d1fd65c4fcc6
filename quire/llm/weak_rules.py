"""Quality rules by weak supervision: rules vote or abstain, EM weighs them.

Each rule says good, bad or nothing about a text.  Under the usual model the votes
are independent given the true label, and a rule that votes is right with one
accuracy on good documents and another on bad ones.  Expectation-maximisation over
the votes of all documents that pass the base test finds the accuracies and the share of good documents; a
document is kept when its posterior probability of being good is at least one half.

The votes of a document are one of at most 3**rules patterns, so EM runs over the
counts of patterns and its work on the driver does not grow with the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import cut
from quire.llm.stats import share, text_counts

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def vote(bad: Column, good: Column) -> Column:
    """-1 where ``bad`` holds, else 1 where ``good`` holds, else 0."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def default_rules() -> dict[str, Column]:
    """The rules over the columns of ``text_counts``."""
    words, per_word = F.col("n_words"), share("word_chars", "n_words")
    symbols, upper = share("n_symbols", "n_words"), F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    letters = (F.col("n_upper") + F.col("n_lower") + F.col("n_high")) / F.greatest(F.col("n_bytes"), F.lit(1))
    repeats, lines, ends = share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"), share("n_ends", "n_words")
    return {
        "length": vote(words < 30, words >= 50),
        "word_length": vote((per_word < 2.5) | (per_word > 15), per_word.between(3, 11)),
        "symbols": vote(symbols > 0.1, symbols < 0.02),
        "upper_case": vote(upper > 0.5, upper < 0.2),
        "letters": vote(letters < 0.74, letters > 0.78),
        "repeated_words": vote(repeats > 0.3, repeats < 0.1),
        "repeated_lines": vote(lines > 0.3, lines < 0.1),
        "sentence_ends": vote((words > 50) & (ends > 0.5), ends.between(0.002, 0.35)),
        "variety": vote((words > 30) & (F.col("n_distinct_words") < 0.2 * F.sqrt(words * 30)), F.col("n_distinct_words") > F.sqrt(words * 30) * 0.6),
    }


@dataclass
class Model:
    """How often a rule that votes is right, on good and on bad documents, and the share of good ones."""

    on_good: list[float]
    on_bad: list[float]
    good: float
    rounds: int = 0

    def weights(self) -> list[tuple[float, float]]:
        """Log likelihood ratios of good to bad for a vote of -1 and of 1."""
        return [(math.log((1 - a) / b), math.log(a / (1 - b))) for a, b in zip(self.on_good, self.on_bad, strict=True)]

    def prior(self) -> float:
        return math.log(self.good / (1 - self.good))

    def posteriors(self, patterns: list[tuple[int, ...]]) -> list[float]:
        weights, out = self.weights(), []
        for votes in patterns:
            x = self.prior() + sum(w[v > 0] for v, w in zip(votes, weights, strict=True) if v)
            out.append(1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x)))
        return out

    def values(self) -> list[float]:
        return [*self.on_good, *self.on_bad, self.good]


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200, tolerance: float = 1e-6) -> Model:
    """EM over (votes, documents); ``patterns`` must be in a fixed order.

    On good documents a voting rule is right with a probability from 0.5 to 0.999, on
    bad ones from 1 less that number to 0.999: no vote speaks against what it says,
    which also fixes which of the two classes is called good.  One pseudo-document
    per outcome smooths the estimates.  Without documents the start values come back.
    """
    model, total = Model([0.99] * rules, [0.2] * rules, 0.7), sum(n for _, n in patterns)
    for step in range(1, rounds + 1):
        if not total:
            break
        beliefs = model.posteriors([v for v, _ in patterns])
        on_good, on_bad = [], []
        for j in range(rules):
            mass = {(1, 1): 1.0, (1, -1): 1.0, (0, 1): 1.0, (0, -1): 1.0}
            for (v, n), p in zip(patterns, beliefs, strict=True):
                if v[j]:
                    mass[1, v[j]] += n * p
                    mass[0, v[j]] += n * (1 - p)
            on_good.append(min(0.999, max(0.5, mass[1, 1] / (mass[1, 1] + mass[1, -1]))))
            on_bad.append(min(0.999, max(1 - on_good[-1], mass[0, -1] / (mass[0, 1] + mass[0, -1]))))
        good = sum(n * p for (_, n), p in zip(patterns, beliefs, strict=True))
        new = Model(on_good, on_bad, min(0.99, max(0.01, (good + 1) / (total + 2))), step)
        moved = max(abs(a - b) for a, b in zip(new.values(), model.values(), strict=True))
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, votes, ``base_failed``, ``posterior`` and ``kept`` for each row of ``docs``.

    A null or empty text has no words, fails the base test and is not kept.  Equal
    texts get equal verdicts, repeated rows one row each; other columns of ``docs``
    are not read.  An empty table gives an empty result.
    """
    rules = rules or default_rules()
    names = list(rules)
    counts = text_counts(docs, doc_id, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = cut(counts.select("doc_id", *BASE, failed.alias("base_failed"), *(c.cast("int").alias(f"vote_{n}") for n, c in rules.items())))
    votes = [f"vote_{n}" for n in names]
    # At most 3**len(rules) rows, whatever the size of the corpus.
    open_cases = voted.filter(~F.col("base_failed")).groupBy(*votes)
    patterns = sorted((tuple(r[v] for v in votes), r["n"]) for r in open_cases.agg(F.count("*").alias("n")).collect())
    model = fit(patterns, len(names))
    odds = F.lit(model.prior())
    for v, (no, yes) in zip(votes, model.weights(), strict=True):
        odds = odds + F.when(F.col(v) < 0, no).when(F.col(v) > 0, yes).otherwise(0.0)
    scored = voted.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


@query("op3_quality_rules")
def quality_rules(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", F.round("posterior", 9).alias("posterior"))

"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each text becomes a vector of statistics, scaled to mean 0 and deviation 1 over the
labelled rows.  Cosines of random projections of it approximate a Gaussian kernel, so
a linear model on them is a kernel model.  Every task adds up the normal equations of
its labelled rows, X'X and X'y; the sums, whose size depends on the number of features
only, are added by row of the matrix and solved with a ridge.  The scores of all
labelled rows are counted in bins, pool-adjacent-violators makes the share of good rows
rise with the score, and the share at a text's score is its probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import cut
from quire.llm.stats import share, text_counts

FEATURES = 256
WIDTH = 2.0  # of the kernel, in deviations per square root of a statistic
RIDGE = 1e-3  # times the number of labelled rows
BINS = 512
SEED = 7
CUT = 0.3  # predicted good from here


def statistics() -> dict[str, Column]:
    """What the classifier sees of a text, from its counts."""
    c = F.col
    one = F.lit(1.0)
    letters = c("n_upper") + c("n_lower") + c("n_high")
    capped = lambda x, top: F.least(x, F.lit(float(top)))
    return {
        "words": F.log1p("n_words"),
        "word_length": capped(share("word_chars", "n_words"), 40),
        "symbols": F.sqrt(capped(share("n_symbols", "n_words"), 4)),
        "letters": letters / F.greatest(c("n_bytes"), one),
        "upper": c("n_upper") / F.greatest(c("n_upper") + c("n_lower"), one),
        "digits": F.sqrt(c("n_digits") / F.greatest(c("n_bytes"), one)),
        "beyond_ascii": c("n_high") / F.greatest(c("n_bytes"), one),
        "ends": F.sqrt(capped(share("n_ends", "n_words"), 2)),
        "commas": F.sqrt(capped(share("n_commas", "n_words"), 2)),
        "marks": F.sqrt(capped(share("n_marks", "n_words"), 2)),
        "same_lines": share("n_dup_lines", "n_lines"),
        "same_words": share("n_repeat_words", "n_words"),
        "variety": F.log1p("n_distinct_words") - 0.8 * F.log1p("n_words"),
        "line_length": F.log1p(share("n_words", "n_lines")),
    }


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


@dataclass(frozen=True)
class Projection:
    """Random directions of the kernel, on scaled statistics."""

    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @staticmethod
    def draw(mean: list[float], deviation: list[float], features: int = FEATURES, width: float = WIDTH) -> Projection:
        rng = np.random.default_rng(SEED)
        d = len(mean)
        directions = rng.standard_normal((d, features)) / (width * np.sqrt(d) / 2)
        return Projection(np.array(mean), np.array(deviation), directions, rng.uniform(0, 2 * np.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Features of the rows of ``x``, a constant last; statistics count up to 8 deviations."""
        scaled = np.clip((x - self.mean) / self.deviation, -8, 8)
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])


def normal_equations(labelled: DataFrame, names: list[str], project: Projection) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over all labelled rows; each task sends one sum, added up row by row."""
    size = len(project.phases) + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = project(_matrix(batch, names))
            total[:, :size] += x.T @ x
            total[:, size] += x.T @ batch.column("y").to_numpy(zero_copy_only=False)
        values = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * (size + 1)), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), values], ["i", "v"])

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], "v": [np.sum(np.stack(frame["v"].to_list()), axis=0)]})

    parts = labelled.mapInArrow(add_up, "i int, v array<double>")
    rows = parts.groupBy("i").applyInPandas(together, "i int, v array<double>").collect()  # one row per feature
    total = np.zeros((size, size + 1))
    for row in rows:
        total[row["i"]] = row["v"]
    return total[:, :size], total[:, size]


def isotonic(counts: list[tuple[int, float, float]]) -> tuple[list[float], list[float]]:
    """Bins and shares of good rows that never fall, by pool-adjacent-violators.

    ``counts`` has (bin, rows, good rows) in order of bins.  A pseudo-row of the mean
    label in each pool keeps the shares off 0 and 1.
    """
    total, good = sum(n for _, n, _ in counts), sum(g for _, _, g in counts)
    mean = good / total
    pools: list[list[float]] = []  # sum of bins, rows, good rows
    for at, n, g in counts:
        pools.append([at * n, n, g])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    values = [(g + mean) / (n + 1) for _, n, g in pools]
    return [s / n for s, n, _ in pools], np.maximum.accumulate(values).tolist()


def score_quality(
    docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Learns from the rows of ``labels(doc_id, quality)`` whose crc32 remainder is not
    ``part`` and that have a document; a null label or id teaches nothing, several
    labels of an id count with their mean.  A null text counts as empty and is scored.
    Equal texts get equal scores; repeated rows come out once each.  Where nothing can
    be learned the score is 0.5 (no label) or the share of good labels (all labels
    alike).  Other columns of either table are not read.
    """
    stats = statistics()
    names = list(stats)
    counts = text_counts(docs, doc_id, text)
    seen = cut(counts.select("doc_id", *(c.cast("double").alias(n) for n, c in stats.items())))
    seen = seen.withColumn("held_out", held_out(F.col("doc_id"), parts, part))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    marks = marks.filter("y IS NOT NULL").groupBy("doc_id").agg(F.avg("y").alias("y"))
    labelled = cut(seen.filter(~F.col("held_out")).join(marks, "doc_id").select("y", *names))
    sums = [f(n).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("d", F.stddev_pop))]
    row = labelled.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.min("y").alias("lo"), F.max("y").alias("hi"), *sums).first()
    if not row["n"] or row["lo"] == row["hi"]:
        score = F.lit(0.5 if not row["n"] else float(row["y"]))
        return seen.select("doc_id", "held_out", score.alias("score"), (score >= CUT).cast("int").alias("predicted"))
    project = Projection.draw([row[f"m_{n}"] for n in names], [max(row[f"d_{n}"], 1e-9) for n in names])
    left, right = normal_equations(labelled, names, project)
    ridge = RIDGE * row["n"] / len(right) * np.eye(len(right))
    ridge[-1, -1] = 0  # the constant is free
    weights = np.linalg.solve(left + ridge, right)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = project(_matrix(batch, names)) @ weights
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in KEPT if n in batch.schema.names), pa.array(values)], [*(n for n in KEPT if n in batch.schema.names), "raw"])

    place = F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * (BINS / 2)).cast("int")
    fitted = labelled.mapInArrow(raw, "y double, raw double").groupBy(place.alias("bin"))
    bins = fitted.agg(F.count("*").alias("n"), F.sum("y").alias("g")).collect()  # BINS rows
    xs, ys = isotonic(sorted((r["bin"], float(r["n"]), r["g"]) for r in bins))

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.clip(batch.column("raw").to_numpy(), -0.5, 1.5) * (BINS / 2)
            score = np.interp(value - 0.5, xs, ys)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    out = seen.mapInArrow(raw, "doc_id long, held_out boolean, raw double")
    out = out.mapInArrow(calibrated, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


KEPT = ("doc_id", "held_out", "y")


@query("op2_quality")
def op2(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Counts over whole texts that the quality operators judge by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.words import SPACES, shingle_hashes, slices, word_hashes

COUNTS = (
    "n_chars n_bytes n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_distinct_words "
    "n_upper n_lower n_digits n_high n_ends n_commas n_marks"
).split()
_BLANK = bytes(SPACES).decode()
# Bytes of each class; high bytes are those of characters beyond ASCII.
_CLASSES = {
    "n_symbols": b"#*$%&|<>",
    "n_upper": bytes(range(65, 91)),
    "n_lower": bytes(range(97, 123)),
    "n_digits": b"0123456789",
    "n_high": bytes(range(128, 256)),
    "n_ends": b".!?",
    "n_commas": b",;:",
    "n_marks": b"!?=+_@/\\^~{}[]()\"",
}


def repeated_words(words: np.ndarray, width: int = 3) -> int:
    """Words inside runs of ``width`` words that occur twice or more, first ones included."""
    runs = shingle_hashes(words, width)
    ordered = np.sort(runs)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again) == 0:
        return 0
    place = np.minimum(np.searchsorted(again, runs), len(again) - 1)
    covered = np.zeros(len(words), bool)
    hit = again[place] == runs
    for k in range(width):
        covered[k : k + len(runs)] |= hit
    return int(covered.sum())


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _count_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [t or "" for t in batch.column(1).to_pylist()]
    data = [t.encode() for t in texts]
    out = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    for first, bounds, hashes in word_hashes(data, lower=False):
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), first):
            bins = np.bincount(np.frombuffer(data[i], np.uint8), minlength=256)
            out["n_words"][i], out["n_chars"][i], out["n_bytes"][i] = b - a, len(texts[i]), len(data[i])
            out["word_chars"][i] = len(texts[i]) - bins[list(SPACES)].sum()
            for name, members in _CLASSES.items():
                out[name][i] = bins[list(members)].sum()
            out["n_lines"][i], out["n_dup_lines"][i] = repeated_lines(texts[i])
            out["n_repeat_words"][i] = repeated_words(hashes[a:b])
            ordered = np.sort(hashes[a:b])
            out["n_distinct_words"][i] = len(ordered) and 1 + int((ordered[1:] != ordered[:-1]).sum())
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c]) for c in COUNTS)], ["doc_id", *COUNTS])


def text_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``COUNTS`` per row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _count_batch(batch)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def share(part: str, whole: str) -> Column:
    """``part`` / ``whole``, 0 where there is nothing to divide by."""
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))

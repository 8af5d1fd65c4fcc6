"""Language identification by a byte convolutional network.

A text is cut into windows of fixed length.  In a window every filter of every width
looks at each run of that many bytes, its largest response is kept (max pooling), and a
softmax over these maxima gives the languages' probabilities.  A text's prediction is
the mean over all of its windows, weighted by their bytes.

The network is trained in numpy, by Adam, on a bounded sample of windows of labelled
texts.  The bound is per language and does not grow with the corpus.  The first layer,
embedding times filter, is folded into a table of byte and offset for prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.words import slices

LENGTH = 128  # bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
DEPTH = 8  # of the byte embedding
# The training sample: windows per language, and at most so many from one text.
WINDOWS_PER_LANGUAGE = 3_000
WINDOWS_PER_TEXT = 3
EPOCHS, BATCH, RATE = 4, 64, 4e-3
WINDOWS_AT_ONCE = 128
UNKNOWN = "und"


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def windows(data: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, as rows padded with 0; the text and the bytes of each."""
    counts = np.array([-(-len(d) // length) for d in data], np.int64)
    padded = b"".join(d + bytes(-len(d) % length) for d in data)
    rows = np.frombuffer(padded, np.uint8).reshape(-1, length)
    owner = np.repeat(np.arange(len(data)), counts)
    sizes = np.full(len(rows), length, np.int64)
    last = np.cumsum(counts)[counts > 0] - 1
    sizes[last] = [len(d) - (n - 1) * length for d, n in zip(data, counts.tolist(), strict=True) if n]
    return rows, owner, sizes


@dataclass
class Network:
    """Weights; ``classes`` in a fixed order."""

    classes: list[str]
    embedding: np.ndarray  # 256, DEPTH
    filters: list[np.ndarray]  # width, DEPTH, FILTERS
    biases: list[np.ndarray]
    dense: np.ndarray  # filters of all widths, classes
    offset: np.ndarray

    @staticmethod
    def start(classes: list[str], seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(
            classes,
            draw(256, DEPTH, scale=0.5),
            [draw(w, DEPTH, FILTERS, scale=1 / np.sqrt(w * DEPTH)) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            draw(len(WIDTHS) * FILTERS, len(classes), scale=0.1),
            np.zeros(len(classes), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.dense, self.offset]

    def tables(self) -> list[np.ndarray]:
        """Response to byte b at place k of a run: one 256 x FILTERS table per width and place."""
        return [np.einsum("bd,kdf->kbf", self.embedding, f).astype(np.float32) for f in self.filters]

    def pooled(self, rows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Largest response of every filter in every window."""
        out = []
        for table_of, bias in zip(tables, self.biases, strict=True):
            span = rows.shape[1] - len(table_of) + 1
            response = table_of[0].take(rows[:, :span], axis=0)
            for k in range(1, len(table_of)):
                response += table_of[k].take(rows[:, k : k + span], axis=0)
            out.append(np.maximum(response.max(axis=1) + bias, 0))
        return np.hstack(out)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        logits = pooled @ self.dense + self.offset
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)


def _gradients(net: Network, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Mean cross-entropy gradient, in the order of ``parameters``."""
    n, length = rows.shape
    best, tops = [], []
    for filters, bias in zip(net.filters, net.biases, strict=True):
        width = len(filters)
        span = length - width + 1
        response = np.zeros((n, span, FILTERS), np.float32)
        folded = np.einsum("bd,kdf->kbf", net.embedding, filters)
        for k in range(width):
            response += folded[k].take(rows[:, k : k + span], axis=0)
        at = response.argmax(axis=1)
        best.append(at)
        tops.append(np.take_along_axis(response, at[:, None], axis=1)[:, 0] + bias)
    raw = np.hstack(tops)
    hidden = np.maximum(raw, 0)
    error = net.probabilities(hidden)
    error[np.arange(n), labels] -= 1
    error /= n
    back = (error @ net.dense.T) * (raw > 0)
    d_embedding, d_filters, d_biases = np.zeros_like(net.embedding), [], []
    for j, (filters, at) in enumerate(zip(net.filters, best, strict=True)):
        part = back[:, j * FILTERS : (j + 1) * FILTERS]
        d_biases.append(part.sum(axis=0))
        d_filter = np.zeros_like(filters)
        for k in range(len(filters)):
            seen = np.take_along_axis(rows, at + k, axis=1)  # n, FILTERS: the byte that each maximum saw
            d_filter[k] = np.einsum("nfd,nf->df", net.embedding[seen], part)
            np.add.at(d_embedding, seen.ravel(), (part[:, :, None] * filters[k].T[None]).reshape(-1, DEPTH))
        d_filters.append(d_filter)
    return [d_embedding, *d_filters, *d_biases, hidden.T @ error, error.sum(axis=0)]


def train(rows: np.ndarray, labels: np.ndarray, classes: list[str], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Adam on the windows; the same input gives the same network."""
    net, rng = Network.start(classes, seed), np.random.default_rng(seed)
    weight = net.parameters()
    first, second = [np.zeros_like(p) for p in weight], [np.zeros_like(p) for p in weight]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, m, v, g in zip(weight, first, second, _gradients(net, rows[order[k : k + BATCH]], labels[order[k : k + BATCH]]), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def training_windows(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The bounded sample: windows, their class and the classes.

    Texts are chosen by a hash of id and text with a chance that gives each language
    about as many windows as it may have, pieces of a text at places fixed by the hash.
    """
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # languages
    classes = sorted(counts)
    if not classes:
        return np.empty((0, LENGTH), np.uint8), np.empty(0, np.int64), []
    wanted = WINDOWS_PER_LANGUAGE / WINDOWS_PER_TEXT
    chance = F.element_at(F.create_map(*(F.lit(x) for c in classes for x in (c, min(1.0, wanted / counts[c])))), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    room = F.greatest(F.length("text") - LENGTH, F.lit(0)) + 1
    pieces = F.array(
        *(F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id, text, {k}), room) as int), {LENGTH})") for k in range(WINDOWS_PER_TEXT))
    )
    chosen = labelled.filter(draw < chance).withColumn("room", room)
    sample = chosen.select("lang", "doc_id", F.explode(F.array_distinct(pieces)).alias("piece"))
    taken = sorted((r["lang"], r["doc_id"], r["piece"]) for r in sample.collect())  # about WINDOWS_PER_LANGUAGE each
    data = [p.encode()[:LENGTH] for _, _, p in taken]
    rows, owner, _ = windows(data)
    place = {c: k for k, c in enumerate(classes)}
    return rows, np.array([place[lang] for lang, _, _ in taken])[owner], classes


def identify(
    docs: DataFrame, parts: int = 4, part: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``.

    Learns from rows with text and a language whose crc32 remainder is not ``part``.
    ``und`` with score 0 stands where a text is null or has no letter, and everywhere if
    there is nothing to learn from; the score is the mean probability of the language
    over all windows.  Equal texts get equal answers, ties go to the first language in
    order; repeated rows come out once each; other columns are not read.
    """
    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    ).withColumn("held_out", held_out(F.col("doc_id"), parts, part))
    readable = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows, labels, classes = training_windows(source.filter(~F.col("held_out") & F.col("lang").isNotNull() & readable))
    if not classes:
        return source.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    net = train(rows, labels, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for k, total in mean_probabilities(net, tables, texts):
                best[k], score[k] = net.classes[int(total.argmax())], float(min(1.0, total.max()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    given = source.select("doc_id", "held_out", F.when(readable, F.col("text")).alias("text"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def mean_probabilities(net: Network, tables: list[np.ndarray], texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(place, mean probabilities) of each text that is not null or empty, in groups of windows."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < WINDOWS_AT_ONCE * LENGTH):
            if texts[at]:
                group.append((at, texts[at].encode()))
                size += len(group[-1][1])
            at += 1
        if not group:
            continue
        total = np.zeros((len(group), len(net.classes)))
        rows, owner, sizes = windows([d for _, d in group])
        for k in range(0, len(rows), WINDOWS_AT_ONCE):
            stretch = slice(k, k + WINDOWS_AT_ONCE)
            p = net.probabilities(net.pooled(rows[stretch], tables))
            np.add.at(total, owner[stretch], p * sizes[stretch, None])
        for (place, data), p in zip(group, total, strict=True):
            yield place, p / len(data)


@query("op1_language")
def op1(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))

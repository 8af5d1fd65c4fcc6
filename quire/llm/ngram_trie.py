"""Language-model scores from an Elias-Fano n-gram trie.

The model is an interpolated trigram model with absolute discounting:

    P(w)     = (c(w) - D1) / N,  unknown words together D1 V / N
    P(w|v)   = (c(vw) - D2) / c(v)   + g(v)  P(w)
    P(w|uv)  = (c(uvw) - D3) / c(uv) + g(uv) P(w|v)

The first part of a line is there for the n-grams that the model keeps; g is what these
leave, so each line sums to 1.  D is n1 / (n1 + 2 n2) of each order.  With least = 1, as
the query has it, every n-gram of the training rows is kept.

The trie has three levels: words by hash, then the successors of each word, then the
successors of each pair.  A level is a row of files, each over a range of keys.  In a file,
the pointers to the lists and the lists themselves (made monotone by running sums) are
Elias-Fano sequences.  Scoring tasks map the files into memory and touch the pages they need.

The whole model takes one shuffle for both upper levels (``train_whole``).  Each position
is a triple, and the last pair of a text one with no third word, so pairs are the prefixes
of triples.  A task sorts the triples of some texts and deals them as packed blocks by ranges;
the task of a range counts them and writes its part of both levels.  Counts are stored, a
byte each, and probabilities follow from them: g is D times the length of a list over the
count of its head.

A pruned model counts, deals and sorts pairs and triples one after the other (``train``).
Its discounted probabilities and weights g are quantised to a byte, and a third word is
stored as its place among the successors of the second, which is a small number.  It
keeps pairs and triples seen ``least`` times or more.  Its counting drops what cannot
occur so often early (pairs of words and triples of pairs that are not kept), so that its
discounts come from the rest.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quire.llm.elias_fano import EliasFano, encode, read_arrays, write_arrays
from quire.llm.registry import query, table
from quire.llm.shared import new_folder
from quire.llm.words import slices, texts_of, word_hashes

END = np.int64(0x5E9D_0F_D0C)  # stands for the end of a text
BITS = 31  # of a child in a key: up to 2**31 words, and 2**32 pairs as parents; triples are none
FILE_KEYS = 2_000_000
LEAST = 2  # count from which a pruned model keeps pairs and triples
GROUP_TOKENS = 150_000
HELD_KEYS = 3_000_000
CODES = 256
TOP = 255  # byte of a count that is kept beside the others
BLOCK_TOKENS = 1_500_000  # tokens whose triples are sorted together; their places take RANK bits each
RANK = 21
SCORED_TOKENS = 600_000  # tokens that are scored together
# Positions that the ranges of the whole model are laid by: of so many tokens, so many triples.
SAMPLE_TOKENS, SAMPLE_KEYS = 8_000_000, 200_000
NONE = np.int64(-(1 << 63))  # before every third word


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def token_groups(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of tokens with an end after each text, bounds of the texts), some texts at a time."""
    tokens, sizes, held = [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    for _, bounds, hashes in word_hashes(texts):
        tokens.append(np.insert(hashes.view(np.int64), bounds[1:], END))
        sizes.append(np.diff(bounds) + 1)
        held += len(tokens[-1])
        if held >= GROUP_TOKENS:
            yield joined()
            tokens, sizes, held = [], [], 0
    if tokens:
        yield joined()


def _counted(docs: DataFrame, name: str, prepare: Callable[[], Callable]) -> DataFrame:
    """(name, c): counts of the keys that ``prepare()`` makes a function for, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of = prepare()
        waiting, held = [], 0
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(counts[k : k + 100_000])], [name, "c"])

        for batch in slices(batches):
            for tokens, bounds in token_groups(texts_of(batch.column(0))):
                found = keys_of(tokens, bounds)
                waiting.append(found)
                held += len(found)
                if held > HELD_KEYS:
                    keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
                    yield from out()
                    waiting, held = [], 0
        if waiting:
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            yield from out()

    part = docs.select("text").mapInArrow(run, f"{name} long, c long")
    return part.groupBy(name).agg(F.sum("c").alias("c"))


def _discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes for positive values, and the value of each byte.

    Half of the codes are quantiles of the logarithms.  The others are an even grid over
    them, as most values of a whole model are one of few and leave the rest no quantile.
    """
    logs = np.log(values)
    half = CODES // 2
    book = np.zeros(1)
    if len(logs):
        book = np.unique(np.concatenate([np.quantile(logs, (np.arange(half) + 0.5) / half), np.linspace(logs.min(), logs.max(), half)]))
    middles = (book[1:] + book[:-1]) / 2
    return np.searchsorted(middles, logs).astype(np.uint8), np.exp(book).astype(np.float64)


def _counts(c: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Counts as bytes, with the places and values of larger ones; triples need none."""
    if name == "triples":
        return {}
    large = np.flatnonzero(c >= TOP)
    return {"counts": np.minimum(c, TOP).astype(np.uint8), "counts.at": large, "counts.large": c[large].astype(np.int64)}


@dataclass
class Files:
    """The files of a level: path, entries before, and first key of each."""

    paths: list[str]
    before: list[int]
    first: list[int]
    # Sums of lists that two files share, by parent.
    shared: dict[int, float]


class Words:
    """The first level: words seen ``least`` times or more with their counts, and of a pruned model words seen once."""

    def __init__(self, files: Files) -> None:
        self.parts = [read_arrays(p)[1] for p in files.paths]
        self.before, self.first = np.array(files.before, np.int64), np.array(files.first, np.int64)

    def _by_file(self, first: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(file, places of its queries)."""
        if len(self.parts) == 1:
            yield 0, np.arange(len(queries))
            return
        file = np.maximum(np.searchsorted(first, queries, side="right") - 1, 0)
        order = np.argsort(file, kind="stable")
        cuts = np.searchsorted(file[order], np.arange(len(self.parts) + 1))
        for k in range(len(self.parts)):
            if cuts[k] < cuts[k + 1]:
                yield k, order[cuts[k] : cuts[k + 1]]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among the kept ones, else -1."""
        out = np.full(len(hashes), -1, np.int64)
        for k, at in self._by_file(self.first, hashes):
            words = self.parts[k]["words"]
            if len(words):
                place = np.minimum(np.searchsorted(words, hashes[at]), len(words) - 1)
                hit = words[place] == hashes[at]
                out[at[hit]] = place[hit] + self.before[k]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of the words with these numbers."""
        out = np.zeros(len(ids), np.int64)
        for k, at in self._by_file(self.before, ids):
            out[at] = self.parts[k]["counts"][ids[at] - self.before[k]]
        return out

    def once(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each word was seen once and is not kept."""
        out = np.zeros(len(hashes), bool)
        for k, at in self._by_file(self.first, hashes):
            words = self.parts[k]["once"]
            if len(words):
                place = np.minimum(np.searchsorted(words, hashes[at]), len(words) - 1)
                out[at] = words[place] == hashes[at]
        return out


class Level:
    """Successors of the entries of the level above."""

    def __init__(self, files: Files) -> None:
        self.before, self.first, self.shared = np.array(files.before, np.int64), np.array(files.first, np.int64), files.shared
        self.parts = []
        for path in files.paths:
            meta, arrays = read_arrays(path)
            self.parts.append((meta, arrays, EliasFano(meta, arrays, "pointers"), EliasFano(meta, arrays, "children")))
        self.shared_keys = np.array(sorted(files.shared), np.int64)
        self.shared_values = np.array([files.shared[k] for k in sorted(files.shared)])

    def _files(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if self.parts:
            yield from self._dealt(np.maximum(np.searchsorted(self.first, keys, side="right") - 1, 0))

    def _dealt(self, file: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(file, places of its queries)."""
        order = np.argsort(file, kind="stable")
        cuts = np.searchsorted(file[order], np.arange(len(self.parts) + 1))
        for k in range(len(self.parts)):
            if cuts[k] < cuts[k + 1]:
                yield k, order[cuts[k] : cuts[k + 1]]

    def _list(self, k: int, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the parents' lists in file k."""
        meta, _, pointers, children = self.parts[k]
        place = parents - meta["parent"]
        known = (place >= 0) & (place < pointers.n - 1)
        inside = np.where(known, place, 0)
        start = np.where(known, pointers[inside].astype(np.int64), np.where(place < 0, 0, children.n))
        end = np.where(known, pointers[inside + 1].astype(np.int64), start)
        return start, end

    def start(self, parents: np.ndarray) -> np.ndarray:
        """Place in the level where each parent's list starts."""
        out = np.zeros(len(parents), np.int64)
        for k, at in self._files(parents << BITS):
            out[at] = self.before[k] + self._list(k, parents[at])[0]
        return out

    def find(self, parents: np.ndarray, children: np.ndarray) -> np.ndarray:
        """Place of each child in its parent's list, -1 where it is not."""
        out = np.full(len(parents), -1, np.int64)
        for k, at in self._files((parents << BITS) | children):
            # Queries come in order, so one parent's stand together.
            heads = np.flatnonzero(np.diff(parents[at], prepend=-1))
            start, end = self._list(k, parents[at[heads]])
            sequence = self.parts[k][3]
            if not sequence.n:
                continue
            base = np.where(start > 0, sequence[np.clip(start - 1, 0, sequence.n - 1)].astype(np.int64) + 1, 0)
            run = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(at)))
            live = np.flatnonzero((start < end)[run])
            if not len(live):
                continue
            run = run[live]
            place = sequence.find((base[run] + children[at[live]]).astype(np.uint64))
            hit = (place >= start[run]) & (place < end[run])
            out[at[live[hit]]] = self.before[k] + place[hit]
        return out

    def values(self, places: np.ndarray, name: str = "prob") -> np.ndarray:
        """Numbers stored with the entries at ``places``."""
        out = np.zeros(len(places))
        if not self.parts:
            return out
        for k, at in self._dealt(np.searchsorted(self.before, places, side="right") - 1):
            arrays = self.parts[k][1]
            stored = arrays[name][places[at] - self.before[k]]
            out[at] = arrays[f"{name}.book"][stored] if f"{name}.book" in arrays else stored
            if f"{name}.large" in arrays:
                high = np.flatnonzero(stored == TOP)
                out[at[high]] = arrays[f"{name}.large"][np.searchsorted(arrays[f"{name}.at"], places[at[high]] - self.before[k])]
        return out

    def weights(self, parents: np.ndarray) -> np.ndarray:
        """What the lists of the parents leave to the level above; 1 without a list."""
        out = np.ones(len(parents))
        for k, at in self._files(parents << BITS):
            # The first file with the parent: its key starts at or behind the list's.
            for j in (k, k + 1):
                if j < len(self.parts):
                    meta, arrays, pointers, _ = self.parts[j]
                    place = parents[at] - meta["parent"]
                    known = np.flatnonzero((place >= 0) & (place < pointers.n - 1))
                    out[at[known]] = np.minimum(out[at[known]], arrays["left.book"][arrays["left"][place[known]]])
        if len(self.shared_keys):
            place = np.minimum(np.searchsorted(self.shared_keys, parents), len(self.shared_keys) - 1)
            hit = self.shared_keys[place] == parents
            out[hit] = self.shared_values[place[hit]]
        return out


@dataclass
class Model:
    """What scoring needs; small, whatever the size of the corpus, but for a line per file."""

    tokens: int
    distinct: int
    discounts: list[float]
    words: Files
    pairs: Files
    triples: Files


def _write_words(counted: DataFrame, folder: str, distinct: int, least: int) -> Files:
    files = max(1, -(-distinct // FILE_KEYS))
    # Hashes are spread evenly, so equal ranges are equal shares.
    bucket = F.floor((F.shiftright("w", 40) + F.lit(1 << 23)) * files / F.lit(1 << 24)).cast("int")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        made = []
        if parts:
            at, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            for k in np.unique(at).tolist():
                words, counts = w[at == k], c[at == k]
                often = counts >= least
                path = f"{folder}/words-{k:06d}"
                write_arrays(path, {}, {"words": words[often], "counts": counts[often], "once": words[~often]})
                made.append((k, path, int(often.sum()), int(words[0])))
        columns = list(zip(*made, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], ["k", "path", "n", "first"])

    dealt = counted.select(bucket.alias("b"), "w", "c").repartitionById(files, F.col("b")).sortWithinPartitions("b", "w")
    rows = sorted(tuple(r) for r in dealt.mapInArrow(write, "k int, path string, n long, first long").collect())  # one per file
    sizes = [r[2] for r in rows]
    return Files([r[1] for r in rows], np.cumsum([0, *sizes[:-1]]).tolist() if rows else [], [r[3] for r in rows], {})


def _write_level(kept: DataFrame, folder: str, name: str, total: int, discount: float, parent_counts: Callable[[], Callable]) -> Files:
    """Files of a level from (key, c), keys being parent << BITS | child."""
    files = max(1, -(-total // FILE_KEYS))
    shares = [k / files for k in range(1, files)]
    bounds = sorted({int(b) for b in kept.approxQuantile("key", shares, 0.2 / files)}) if shares else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(bounds, np.int64)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(cuts, b.column(0).to_numpy(), side="right"), pa.int32()), b.column(0), b.column(1)], ["b", "key", "c"]
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(k).to_numpy() for k in range(3)) for b in batches]
        made, count_of = [], parent_counts()
        if parts:
            at, keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            for k in np.unique(at).tolist():
                key, c = keys[at == k], counts[at == k].astype(np.float64)
                parent, child = key >> BITS, key & ((1 << BITS) - 1)
                first, last = int(parent[0]), int(parent[-1])
                pointers = np.searchsorted(parent, np.arange(first, last + 2))
                heads = np.flatnonzero(np.diff(parent, prepend=-1))
                ends = np.append(heads[1:], len(parent)) - 1
                base = np.concatenate([[0], np.cumsum(child[ends] + 1)[:-1]])
                sequence = child + np.repeat(base, ends - heads + 1)
                owners = parent[heads]
                share = (c - discount) / np.repeat(count_of(owners), ends - heads + 1)
                taken = np.add.reduceat(share, heads)
                left = np.ones(last - first + 1)
                left[owners - first] = np.maximum(1 - taken, 1e-9)
                prob, book = _codes(share)
                rest, rest_book = _codes(left)
                meta, arrays = encode(pointers, "pointers")
                more, lists = encode(sequence, "children")
                path = f"{folder}/{name}-{k:06d}"
                write_arrays(
                    path,
                    {"parent": first, **meta, **more},
                    {**arrays, **lists, "prob": prob, "prob.book": book, "left": rest, "left.book": rest_book, **_counts(c, name)},
                )
                made.append((k, path, len(key), int(key[0]), first, float(taken[0]), last, float(taken[-1])))
        columns = list(zip(*made, strict=True)) or [[]] * 8
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
        names = ["k", "path", "n", "first", "a", "ta", "z", "tz"]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], names)

    dealt = kept.select("key", "c").mapInArrow(deal, "b int, key long, c long")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("b")).sortWithinPartitions("b", "key")
    schema = "k int, path string, n long, first long, a long, ta double, z long, tz double"
    rows = sorted(tuple(r) for r in dealt.mapInArrow(write, schema).collect())  # one per file
    # A list that files share is at the end of one and the start of the next.
    sums: dict[int, list[float]] = {}
    for r in rows:
        for parent, taken in {r[4]: r[5], r[6]: r[7]}.items():
            sums.setdefault(parent, []).append(taken)
    shared = {p: max(1 - sum(t), 1e-9) for p, t in sums.items() if len(t) > 1}
    sizes = [r[2] for r in rows]
    return Files([r[1] for r in rows], np.cumsum([0, *sizes[:-1]]).tolist() if rows else [], [r[3] for r in rows], shared)


EMPTY = Files([], [], [], {})


def _starts(n: int, bounds: np.ndarray) -> np.ndarray:
    first = np.zeros(n, bool)
    first[bounds[:-1]] = True
    return first


def word_numbers(words: Words, tokens: np.ndarray) -> np.ndarray:
    """Numbers of the tokens; each distinct token is looked up once."""
    distinct, back = np.unique(tokens, return_inverse=True)
    return words.ids(distinct)[back]


def pair_places(level: Level, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token, the place of the pair it ends, -1 where there is none."""
    out = np.full(len(ids), -1, np.int64)
    at = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0) & ~first[1:]) + 1
    if len(at):
        keys, back = np.unique((ids[at - 1] << BITS) | ids[at], return_inverse=True)
        out[at] = level.find(keys >> BITS, keys & ((1 << BITS) - 1))[back]
    return out


def _fits(entries: int, bits: int, name: str) -> None:
    if entries >= 1 << bits:
        raise ValueError(f"{entries} {name} are too many for keys of {bits} bits")


def train(docs: DataFrame, folder: str, least: int = LEAST) -> Model:
    """Build the pruned trie of ``docs(text)`` below ``folder``; three counting passes over the texts.

    Pairs and triples seen fewer than ``least`` times are not kept.
    """
    if least != LEAST:
        raise ValueError("a pruned model keeps what is seen twice")
    spark = docs.sparkSession

    def words_of() -> Callable:
        return lambda tokens, bounds: tokens

    _counted(docs, "w", words_of).write.parquet(f"{folder}/counted-words")
    counted = spark.read.parquet(f"{folder}/counted-words")
    size = counted.agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), *(F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2))
    ).first()
    if not size["v"]:
        return Model(0, 0, [0.5] * 3, EMPTY, EMPTY, EMPTY)
    discounts = [_discount(size["n1"], size["n2"])]
    _fits(size["v"], BITS, "words")
    words = _write_words(counted, folder, size["v"], least)

    def level(name: str, keys: Callable[[], Callable], parent_counts: Callable[[], Callable]) -> Files:
        seen = Observation(name)
        found = _counted(docs, "key", keys).observe(
            seen, *(F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2)), F.count(F.when(F.col("c") >= least, 1)).alias("kept")
        )
        found.filter(F.col("c") >= least).write.option("compression", "zstd").parquet(f"{folder}/counted-{name}")
        stats = seen.get
        discounts.append(_discount(stats["n1"], stats["n2"]))
        if not stats["kept"]:
            return EMPTY
        if name == "pairs":
            _fits(stats["kept"], 63 - BITS, name)
        kept = spark.read.parquet(f"{folder}/counted-{name}")
        return _write_level(kept, folder, name, stats["kept"], discounts[-1], parent_counts)

    def pairs_of() -> Callable:
        known = Words(words)

        def keys(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            ids, first = word_numbers(known, tokens), _starts(len(tokens), bounds)
            at = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0) & ~first[1:]) + 1
            return (ids[at - 1] << BITS) | ids[at]

        return keys

    pairs = level("pairs", pairs_of, lambda: Words(words).counts)

    def triples_of() -> Callable:
        known, twos = Words(words), Level(pairs)

        def keys(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            ids, first = word_numbers(known, tokens), _starts(len(tokens), bounds)
            places = pair_places(twos, ids, first)
            at = np.flatnonzero((places[1:] >= 0) & (places[:-1] >= 0)) + 1
            return (places[at - 1] << BITS) | (places[at] - twos.start(ids[at - 1]))

        return keys

    def counts_of_pairs() -> Callable:
        twos = Level(pairs)
        return lambda places: twos.values(places, "counts")

    triples = level("triples", triples_of, counts_of_pairs) if pairs.paths else EMPTY
    return Model(size["n"], size["v"], discounts, words, pairs, triples)


@dataclass
class Ranges(Files):
    """The files of a level of the whole model; ``shared`` has the lengths of lists at the ends of files."""

    parents: list[int]  # of the first list of each file
    counts: dict[int, int]  # of entries at the ends of files, by place


class Counted(Level):
    """A level of the whole model: counts, not probabilities."""

    def __init__(self, files: Ranges) -> None:
        super().__init__(files)
        for (meta, *_), parent in zip(self.parts, files.parents, strict=True):
            meta["parent"] = parent
        self.count_at = np.array(sorted(files.counts), np.int64)
        self.count_is = np.array([files.counts[k] for k in sorted(files.counts)], np.float64)

    def sizes(self, parents: np.ndarray) -> np.ndarray:
        """Lengths of the parents' lists."""
        out = np.zeros(len(parents))
        for k, at in self._files(parents << BITS):
            start, end = self._list(k, parents[at])
            out[at] = end - start
        # Those at the ends of a file are all among the shared ones.
        return _replaced(out, parents, self.shared_keys, self.shared_values)

    def counts(self, places: np.ndarray) -> np.ndarray:
        return _replaced(self.values(places, "counts"), places, self.count_at, self.count_is)


def _replaced(out: np.ndarray, keys: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``out`` with the values of the keys that ``at`` has."""
    if len(at):
        place = np.minimum(np.searchsorted(at, keys), len(at) - 1)
        hit = at[place] == keys
        out[hit] = values[place[hit]]
    return out


def _pack(pair: np.ndarray, third: np.ndarray, count: np.ndarray) -> bytes:
    """Triples in order as a block of bytes: differences of pairs, third words and counts by byte planes."""
    kinds = ((np.diff(pair, prepend=0), "<u8"), (third, "<u4"), (count, "<u4"))
    planes = [np.ascontiguousarray(x.astype(t)).view(np.uint8).reshape(len(pair), -1).T.tobytes() for x, t in kinds]
    return struct.pack("<I", len(pair)) + pa.Codec("zstd", compression_level=1).compress(b"".join(planes), asbytes=True)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", block)
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(block)[4:], 16 * n, asbytes=True), np.uint8).reshape(16, n)
    pair, third, count = (np.ascontiguousarray(planes[a:b].T).view(t).ravel() for a, b, t in ((0, 8, "<u8"), (8, 12, "<u4"), (12, 16, "<u4")))
    return np.cumsum(pair.astype(np.int64)), third, count


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, whether each ends its text) of about ``most`` tokens, whole texts."""
    tokens, last, held = [], [], 0
    for batch in slices(batches):
        for found, bounds in token_groups(texts_of(batch.column(0))):
            tokens.append(found)
            last.append(np.zeros(len(found), bool))
            last[-1][bounds[1:] - 1] = True
            held += len(found)
            if held >= most:
                yield np.concatenate(tokens), np.concatenate(last)
                tokens, last, held = [], [], 0
    if held:
        yield np.concatenate(tokens), np.concatenate(last)


def _ranges(docs: DataFrame, tokens: int, files: int) -> np.ndarray:
    """First triple (three hashes) of each range but the first, from a sample; results do not depend on them."""

    def sample(share: float) -> np.ndarray:
        step = max(1, int(tokens * share) // SAMPLE_KEYS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = 0
            for found, last in _joined(batches, GROUP_TOKENS):
                first = np.flatnonzero(~last)
                first, at = first[(-at) % step :: step], at + len(first)
                follows = np.append(found, [NONE, NONE])[first + 2]
                parts = (found[first], found[first + 1], np.where(last[first + 1], NONE, follows))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["u", "v", "w"])

        part = docs.select("text") if share >= 1 else docs.select("text").sample(share, seed=7)
        found = part.mapInArrow(run, "u long, v long, w long").toArrow()
        return np.stack([found.column(k).to_numpy() for k in range(3)], axis=1)

    if files == 1:
        return np.empty((0, 3), np.int64)
    share = min(1.0, SAMPLE_TOKENS / tokens)
    keys = sample(share)
    if share < 1 and len(keys) < SAMPLE_KEYS // 4:  # few and long texts
        keys = sample(1.0)
    keys = keys[np.lexsort(keys.T[::-1])]
    return np.unique(keys[np.arange(1, files) * len(keys) // files], axis=0) if len(keys) else keys


def _local_bounds(bounds: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The first key, by places in ``distinct``, that is not before each bound."""
    place = np.searchsorted(distinct, bounds)
    there = distinct[np.minimum(place, len(distinct) - 1)] == bounds
    second = np.where(there[:, 0], place[:, 1], 0)
    third = np.where(there[:, 0] & there[:, 1] & (bounds[:, 2] != NONE), place[:, 2] + 1, 0)
    return (place[:, 0] << 2 * RANK) | (second << RANK) | third


def _write_range(path: str, parent: np.ndarray, child: np.ndarray, count: np.ndarray) -> None:
    """Lists of children with their counts, sorted by parent and child."""
    first, last = int(parent[0]), int(parent[-1])
    heads = np.flatnonzero(np.diff(parent, prepend=-1))
    ends = np.append(heads[1:], len(parent)) - 1
    base = np.concatenate([[0], np.cumsum(child[ends] + 1)[:-1]])
    meta, arrays = encode(np.searchsorted(parent, np.arange(first, last + 2)), "pointers")
    more, lists = encode(child + np.repeat(base, ends - heads + 1), "children")
    write_arrays(path, {"parent": first, **meta, **more}, {**arrays, **lists, **_counts(count, "counted")})


RANGE = (
    "k int, pairs long, triples long, first long, last long, child long, first_count long, last_count long, first_size long, "
    "last_size long, first_word long, last_word long, pairs1 long, pairs2 long, triples1 long, triples2 long"
)


def train_whole(docs: DataFrame, folder: str, file_keys: int) -> Model:
    """The trie of all pairs and triples of ``docs(text)`` below ``folder``; two passes over the texts and one over a sample."""
    spark = docs.sparkSession
    _counted(docs, "w", lambda: lambda tokens, bounds: tokens).write.parquet(f"{folder}/counted-words")
    counted = spark.read.parquet(f"{folder}/counted-words")
    size = counted.agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), *(F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2))
    ).first()
    if not size["v"]:
        return Model(0, 0, [0.5] * 3, EMPTY, EMPTY, EMPTY)
    _fits(size["v"] + 1, BITS, "words")
    words = _write_words(counted, folder, size["v"], 1)
    bounds = _ranges(docs, size["n"], -(-size["n"] // file_keys))
    one = (1 << RANK) - 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(words)
        for tokens, last in _joined(batches, BLOCK_TOKENS):
            # A text may be longer than a block; the two tokens behind a block belong to its triples.
            for a in range(0, len(tokens), BLOCK_TOKENS):
                distinct, rank = np.unique(tokens[a : a + BLOCK_TOKENS + 2], return_inverse=True)
                ends = last[a : a + BLOCK_TOKENS + 2]
                at = np.flatnonzero(~ends[:BLOCK_TOKENS])
                follows = np.append(rank, 0)[np.minimum(at + 2, len(rank))] + 1
                keys = (rank[at] << 2 * RANK) | (rank[at + 1] << RANK) | np.where(ends[at + 1], 0, follows)
                keys.sort()
                heads = np.flatnonzero(np.diff(keys, prepend=-1))
                count, keys = np.diff(heads, append=len(keys)), keys[heads]
                numbers = known.ids(distinct)
                pair = (numbers[keys >> 2 * RANK] << BITS) | numbers[(keys >> RANK) & one]
                third = np.concatenate([[0], numbers + 1])[keys & one]
                cuts = np.concatenate([[0], np.searchsorted(keys, _local_bounds(bounds, distinct)), [len(keys)]])
                made = [(k, _pack(pair[s:e], third[s:e], count[s:e])) for k, (s, e) in enumerate(pairwise(cuts.tolist())) if s < e]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], ["b", "block"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made = defaultdict(list), []
        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k].append(block)
        for k in sorted(held):
            pair, third, count = (np.concatenate(x) for x in zip(*map(_unpack, held.pop(k)), strict=True))
            order = np.lexsort((third, pair))
            pair, third, count = pair[order], third[order].astype(np.int64), count[order].astype(np.int64)
            heads = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(third, prepend=-1) != 0))
            pair, third, count = pair[heads], third[heads], np.add.reduceat(count, heads)
            heads = np.flatnonzero(np.diff(pair, prepend=-1))
            sizes = np.diff(heads, append=len(pair))
            pair, total = pair[heads], np.add.reduceat(count, heads)
            word = pair >> BITS
            _write_range(f"{folder}/pairs-{k:06d}", word, pair & ((1 << BITS) - 1), total)
            _write_range(f"{folder}/triples-{k:06d}", np.repeat(np.arange(len(pair)), sizes), third, count)
            inner, whole = total[1:-1], count[third > 0]
            edges = (int((word == word[0]).sum()), int((word == word[-1]).sum()))
            seen = [int((x == c).sum()) for x in (inner, whole) for c in (1, 2)]
            made.append((k, len(pair), len(third), pair[0], pair[-1], third[0], total[0], total[-1], sizes[0], sizes[-1], *edges, *seen))
        columns = list(zip(*made, strict=True)) or [[]] * 16
        kinds = [pa.int32()] + [pa.int64()] * 15
        names = [x.split()[0] for x in RANGE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in x], t) for x, t in zip(columns, kinds, strict=True)], names)

    dealt = docs.select("text").mapInArrow(blocks, "b int, block binary").repartitionById(len(bounds) + 1, F.col("b"))
    rows = sorted(dealt.mapInArrow(write, RANGE).collect(), key=lambda r: r["k"])  # one per file
    pairs, triples = Ranges([], [], [], {}, [], {}), Ranges([], [], [], {}, [], {})
    places = entries = 0
    last = -1
    for r in rows:
        # A pair whose triples files share is in all of them and has one place.
        again = r["first"] == last
        at, last = places - again, r["last"]
        places, entries = at + r["pairs"], entries + r["triples"]
        pairs.paths.append(f"{folder}/pairs-{r['k']:06d}")
        pairs.before.append(at)
        pairs.first.append(r["first"])
        pairs.parents.append(r["first"] >> BITS)
        triples.paths.append(f"{folder}/triples-{r['k']:06d}")
        triples.before.append(entries - r["triples"])
        triples.first.append((at << BITS) | r["child"])
        triples.parents.append(at)
        ends = {at: (r["first_count"], r["first_size"]), places - 1: (r["last_count"], r["last_size"])}
        for place, (count, length) in ends.items():
            pairs.counts[place] = pairs.counts.get(place, 0) + count
            triples.shared[place] = triples.shared.get(place, 0) + length
        for word, length in {r["first"] >> BITS: r["first_word"], last >> BITS: r["last_word"]}.items():
            pairs.shared[word] = pairs.shared.get(word, 0) + length - (again and word == r["first"] >> BITS)
    _fits(places, 63 - BITS, "pairs")
    ends = list(pairs.counts.values())
    discounts = [
        _discount(size["n1"], size["n2"]),
        _discount(*(sum(r[f"pairs{c}"] for r in rows) + ends.count(c) for c in (1, 2))),
        _discount(*(sum(r[f"triples{c}"] for r in rows) for c in (1, 2))),
    ]
    return Model(size["n"], size["v"], discounts, words, pairs, triples)


class Scorer:
    """Scores token groups by the trie of a pruned model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.words = Words(model.words) if model.words.paths else None
        self.pairs, self.triples = Level(model.pairs), Level(model.triples)

    def __call__(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: known tokens, base score and score."""
        m = self.model
        if not self.words:
            zero = np.zeros(len(bounds) - 1)
            return zero.astype(np.int64), zero, zero
        distinct, back = np.unique(tokens, return_inverse=True)
        numbers = self.words.ids(distinct)
        count = np.zeros(len(distinct), np.int64)
        count[numbers >= 0] = self.words.counts(numbers[numbers >= 0])
        rare = np.flatnonzero(numbers < 0)
        count[rare] = self.words.once(distinct[rare])
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.distinct + 1)))
        single = np.where(count > 0, (count - m.discounts[0]) / m.tokens, m.discounts[0] * m.distinct / m.tokens)
        ids, p = numbers[back], single[back]
        first = _starts(len(tokens), bounds)
        if self.pairs.parts:
            after = np.flatnonzero((ids[:-1] >= 0) & ~first[1:]) + 1
            contexts, again = np.unique(ids[after - 1], return_inverse=True)
            p[after] *= self.pairs.weights(contexts)[again]
            places = pair_places(self.pairs, ids, first)
            seen = np.flatnonzero(places >= 0)
            p[seen] += self.pairs.values(places[seen])
            if self.triples.parts:
                after = np.flatnonzero((places[:-1] >= 0) & ~first[1:]) + 1
                contexts, again = np.unique(places[after - 1], return_inverse=True)
                p[after] *= self.triples.weights(contexts)[again]
                both = after[places[after] >= 0]
                relative = places[both] - self.pairs.start(ids[both - 1])
                third = self.triples.find(places[both - 1], relative)
                hit = third >= 0
                p[both[hit]] += self.triples.values(third[hit])
        starts = bounds[:-1]
        known = np.add.reduceat((count > 0)[back].astype(np.int64), starts)
        return known, np.add.reduceat(base[back], starts), np.add.reduceat(np.log10(p), starts)


class WholeScorer:
    """Scores token groups by the trie of all n-grams."""

    def __init__(self, model: Model) -> None:
        self.model, self.words = model, Words(model.words)
        self.pairs, self.triples = (Counted(x) if x.paths else None for x in (model.pairs, model.triples))

    def __call__(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: known tokens, base score and score."""
        m = self.model
        distinct, rank = np.unique(tokens, return_inverse=True)
        numbers = self.words.ids(distinct)
        count = np.zeros(len(distinct), np.int64)
        count[numbers >= 0] = self.words.counts(numbers[numbers >= 0])
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.distinct + 1)))
        p = np.where(count > 0, (count - m.discounts[0]) / m.tokens, m.discounts[0] * m.distinct / m.tokens)[rank]
        first, known = _starts(len(tokens), bounds), count > 0
        if self.pairs:
            after = np.flatnonzero(known[rank[:-1]] & ~first[1:]) + 1
            heads = np.unique(rank[after - 1])
            rest = np.ones(len(distinct))
            rest[heads] = m.discounts[1] * self.pairs.sizes(numbers[heads]) / count[heads]
            p[after] *= rest[rank[after - 1]]
            # Distinct pairs in order, and for each token the one that it ends.
            after = after[known[rank[after]]]
            keys, back = np.unique((rank[after - 1] << 32) | rank[after], return_inverse=True)
            head = keys >> 32
            places = self.pairs.find(numbers[head], numbers[keys & 0xFFFFFFFF])
            there = np.flatnonzero(places >= 0)
            seen = np.zeros(len(keys))
            seen[there] = self.pairs.counts(places[there])
            share = np.where(seen > 0, seen - m.discounts[1], 0) / count[head]
            p[after] += share[back]
            pair = np.full(len(tokens), -1, np.int64)
            pair[after] = np.where(places >= 0, np.arange(len(keys)), -1)[back]
            after = np.flatnonzero((pair[:-1] >= 0) & ~first[1:]) + 1
            heads = np.unique(pair[after - 1])
            rest = np.ones(len(keys))
            rest[heads] = m.discounts[2] * self.triples.sizes(places[heads]) / seen[heads]
            p[after] *= rest[pair[after - 1]]
            after = after[pair[after] >= 0]
            keys, back = np.unique((pair[after - 1] << 32) | rank[after], return_inverse=True)
            head = keys >> 32
            found = self.triples.find(places[head], numbers[keys & 0xFFFFFFFF] + 1)
            there = np.flatnonzero(found >= 0)
            share = np.zeros(len(keys))
            share[there] = (self.triples.counts(found[there]) - m.discounts[2]) / seen[head[there]]
            p[after] += share[back]
        starts = bounds[:-1]
        return np.add.reduceat(known[rank].astype(np.int64), starts), np.add.reduceat(base[rank], starts), np.add.reduceat(np.log10(p), starts)


def score_texts(
    docs: DataFrame, folder: str, parts: int = 5, part: int = 1, doc_id: str = "doc_id", text: str = "text", least: int = LEAST
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Learns from rows whose crc32 remainder is not ``part``; a null id is held out.
    Tokens are the words, A-Z lower-cased, and one end; a null or empty text is its end
    alone.  Scores are log10 probabilities of whole texts; without training rows every
    token has probability 1.  Repeated rows come out once each, and count as often as
    they come; other columns are not read.  The model keeps pairs and triples seen
    ``least`` times or more: 1 for all of them, as the query does, or 2 for a smaller trie.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.withColumn("held_out", held_out(F.col("doc_id"), parts, part))
    known = source.filter(~F.col("held_out"))
    model = train_whole(known, folder, FILE_KEYS) if least == 1 else train(known, folder, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WholeScorer(model) if least == 1 and model.tokens else Scorer(model)
        rows, tokens, sizes, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            size = np.concatenate(sizes)
            known, base, score = scorer(np.concatenate(tokens), np.concatenate([[0], np.cumsum(size)]))
            total = np.full(len(size), model.tokens, np.int64)
            ids = pa.concat_batches(rows)
            return pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), *(pa.array(x) for x in (size, known, total, base, score))], OUT)

        for batch in slices(batches):
            rows.append(batch.select([0, 1]).take(pa.array(np.arange(batch.num_rows))))  # a copy, without the texts
            for found, bounds in token_groups(texts_of(batch.column(2))):
                tokens.append(found)
                sizes.append(np.diff(bounds))
                held += len(found)
            if held >= SCORED_TOKENS:
                yield out()
                rows, tokens, sizes, held = [], [], [], 0
        if held:
            yield out()

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return source.select("doc_id", "held_out", "text").mapInArrow(run, kinds)


OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@query("op8_lm_score")
def op8(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"), new_folder(spark, "trie"), least=1)

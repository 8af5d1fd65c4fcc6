"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded texts.

Folding lower-cases, drops accents and invisible characters, and replaces look-alike
letters of other scripts and digits or symbols that stand for letters.  One automaton
holds the terms and the exception phrases, in which a term is harmless.  The weights of
the hits are added and divided by the length of the text; the share of toxic rows among
labelled texts of that density, made rising by pool-adjacent-violators, is the score.

The weights come from labelled rows: a bounded sample of them tells in how many toxic
and clean texts each word, and each beginning of longer words, stands.  A word needs many
different contexts, so a passage copied from text to text does not make its words toxic.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.fourier_quality import held_out, isotonic
from quire.llm.registry import query, table
from quire.llm.shared import cut
from quire.llm.words import slices

LEARNED_ROWS = 4_000  # labelled rows of each label that weights are learned from
LEAST_CONTEXTS = 8  # in toxic texts, for a word that no one listed
LEAST_Z = 6.0  # deviations by which such a word is commoner in toxic texts
LEAST_WEIGHT = 0.5  # natural log odds, of any term
LEAST_LEARNED = 2.0  # of one that no one listed
PRIOR = 5.0  # contexts that a listed weight counts for
LENGTH = 20.0  # words added to each text's length, so that one hit in few words is not everything
BINS = 400
CUT = 0.5  # predicted toxic from here

# Listed terms and their weights before anything is learned.
TERMS = {
    4.0: "asshole bastard bitch bullshit cunt dickhead douchebag fucker fucking fuck motherfucker prick retard scumbag shithead slut twat wanker whore",
    3.0: "arsehole clown disgusting dumbass dumb fool freak idiot imbecile jackass jerk loser lunatic moron pathetic pervert pig scum stupid trash ugly vermin worthless",
    2.5: "abschaum arschloch connard conne salope pute enculé merde idiota imbécil estúpido estúpida cabrón gilipollas pendejo puta mierda dummkopf hurensohn schlampe wichser trottel",
    2.0: "garbage filth filthy sicko weirdo",
}
PHRASES = {3.0: ("shut up", "piece of trash", "piece of garbage", "go to hell", "drop dead", "waste of space", "kill yourself")}
# Where a listed word is harmless.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "guinea pig", "pig iron", "pig farm",
    "fool proof", "april fool", "garbage collection", "garbage collector", "garbage truck",
    "ugly duckling", "dumb waiter", "dumb terminal", "stupid question", "bastard file",
)

# Letters of other scripts that look like a Latin one.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
# Digits and symbols that stand for a letter; 1 stands for i or l.
DIGITS = {"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"@": "a", "$": "s", "€": "e", "+": "t", "!": "1", "|": "1"}
_INSIDE = re.compile(r"(?<=[^\W_])[@$€+!|]+(?=[^\W_])")


def _folding() -> dict[int, str | None]:
    """What each character becomes; compatibility forms and accents by Unicode's own decomposition."""
    out: dict[int, str | None] = {}
    for first, last in ((0xAA, 0x24F), (0x1E00, 0x1EFF), (0x2100, 0x214F), (0x2460, 0x24FF), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF)):
        for code in range(first, last + 1):
            bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
            if len(bare) == 1 and bare.isascii() and bare.isalnum():
                out[code] = DIGITS.get(bare, bare)
    for first, last in ((0x300, 0x36F), (0x200B, 0x200F), (0x2060, 0x2064), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xAD, 0xAD)):
        out.update(dict.fromkeys(range(first, last + 1)))
    out.update({ord(k): v for k, v in (LOOK_ALIKE | DIGITS).items()})
    return out


_FOLDING = _folding()


def fold(text: str) -> list[str]:
    """The folded words of ``text``; symbols stand for letters only between letters or digits."""
    text = text.lower().translate(_FOLDING)
    if _INSIDE.search(text):
        text = _INSIDE.sub(lambda m: "".join(SYMBOLS[c] for c in m[0]), text)
    return text.split()


def _spellings(term: str) -> set[str]:
    """The ways to meet ``term`` in a folded text: i and l as 1, an outer s or a as a symbol."""
    words = fold(term)
    if not words:
        return set()
    out = {""}
    for c in " ".join(words):
        # Beyond a few such letters a mixed spelling no longer counts, only all or none.
        out = {a + b for a in out for b in ((c, "1") if c in "il" and len(out) < 64 else (c,))}
    for a in list(out):
        if a[0] in "sa":
            out.add({"s": "$", "a": "@"}[a[0]] + a[1:])
        if a[-1] == "s":
            out.add(a[:-1] + "$")
    return out


@dataclass(frozen=True)
class Lexicon:
    """Terms with their weights, and phrases in which none counts.

    A term is one word or more; with a star behind it, words that go on after it.
    """

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    plurals: bool = field(default=True)  # whether a hit may be followed by s or es

    @staticmethod
    def listed() -> Lexicon:
        terms = {t: w for w, line in TERMS.items() for t in line.split()}
        return Lexicon(terms | {t: w for w, group in PHRASES.items() for t in group}, EXCEPTIONS)

    def automaton(self) -> ahocorasick.Automaton | None:
        found: dict[str, dict[bool, float | None]] = {}
        for term, weight in [*self.weights.items(), *dict.fromkeys(self.exceptions).items()]:
            for spelling in _spellings(term.rstrip("*")):
                found.setdefault(spelling, {})[term.endswith("*")] = weight
        if not found:
            return None
        machine = ahocorasick.Automaton()
        for spelling, kinds in found.items():
            machine.add_word(spelling, (len(spelling), tuple(kinds.items())))
        machine.make_automaton()
        return machine


def hits(text: str, machine: ahocorasick.Automaton | None, plurals: bool = True) -> tuple[int, list[float]]:
    """Words of ``text`` and the weights of the terms in it.

    A hit is a whole word (or words).  Of hits that overlap the longest counts, then the
    first; hits that overlap an exception phrase do not count.
    """
    words = fold(text)
    if machine is None or not words:
        return len(words), []
    line = " " + " ".join(words) + "  "
    spans, apart = [], []
    for end, (size, kinds) in machine.iter(line):
        start = end - size + 1
        if line[start - 1].isalnum():
            continue
        for goes_on, weight in kinds:
            after = end + 1
            if plurals and not goes_on and line[after].isalnum():
                after += 2 if line.startswith("es", after) else line[after] == "s"
            if line[after].isalnum() == goes_on:
                (apart if weight is None else spans).append((start, end, weight))
    taken: list[tuple[int, int]] = [(a, b) for a, b, _ in apart]
    weights = []
    if len(spans) > 1 or taken:
        # Longest first; a span stays if nothing taken overlaps it.
        at = np.zeros(len(line), bool) if len(spans) > 50 else None
        if at is not None:
            for a, b in taken:
                at[a : b + 1] = True
        for a, b, w in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            if at[a : b + 1].any() if at is not None else any(a <= d and c <= b for c, d in taken):
                continue
            weights.append(w)
            if at is not None:
                at[a : b + 1] = True
            else:
                taken.append((a, b))
    else:
        weights = [w for _, _, w in spans]
    return len(words), weights


def match_lexicon(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hits, weight`` for each row of ``docs``; no shuffle.

    A null text counts as empty; nulls and repeats of ids come out as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in slices(batches):
            found = [hits(t or "", machine, lexicon.plurals) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([len(w) for _, w in found], pa.int64()),
                    pa.array([math.fsum(w) for _, w in found], pa.float64()),
                ],
                ["doc_id", "n_words", "n_hits", "weight"],
            )

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_hits long, weight double")


_MARKS = ".,;:!?\"'()[]{}*#%&<>-_/\\|"
_STEMS = range(4, 11)


def _terms(text: str) -> dict[str, int]:
    """The words of a text and their beginnings (with a star), each with a number for a word before it."""
    out: dict[str, int] = {}
    before = 0
    for word in fold(text):
        word = word.strip(_MARKS)
        for term in [word, *(word[:k] + "*" for k in _STEMS if k < len(word))] if len(word) > 2 else []:
            out[term] = min(before, out.get(term, before))
        before = zlib.crc32(word.encode())
    return out


def _terms_of_toxic(listed: Lexicon):
    """Terms of texts without a listed term, one row each; listed words of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = listed.automaton()
        singles = {" ".join(fold(t)) for t in listed.weights}
        for batch in slices(batches):
            terms, before, open_ = [], [], []
            for text in batch.column(0).to_pylist():
                explained = bool(hits(text or "", machine, listed.plurals)[1])
                found = {t: b for t, b in _terms(text or "").items() if not explained or t in singles}
                found["" if explained else "*"] = 0  # counts the texts
                terms += found
                before += found.values()
                open_ += [not explained] * len(found)
            columns = [pa.array(terms, pa.string()), pa.array(before, pa.int64()), pa.array(open_, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "before", "unexplained"])

    return run


def _counts_in_clean(wanted: frozenset[str]):
    """In how many texts each of ``wanted`` stands, added up for each slice; at ``*`` all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(wanted.intersection(_terms(text or "")))
                counts["*"] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return run


def learn_lexicon(
    docs: DataFrame, marks: DataFrame, listed: Lexicon, rows: int = LEARNED_ROWS, doc_id: str = "doc_id", text: str = "text"
) -> Lexicon:
    """``listed`` with weights learned from ``marks(doc_id, toxic)`` and with the terms found there.

    At most ``rows`` ids of each label are read, the same in every run.  Terms that are
    not listed, words or beginnings of longer words, are looked for in toxic texts
    without a listed term.  They need LEAST_CONTEXTS different words before them, at
    most one for each text, and LEAST_Z deviations from the clean texts.  A listed word
    keeps part of its weight, as if it were seen in PRIOR texts.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def sample(label: int) -> DataFrame:
        own = marks.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")
        return source.join(F.broadcast(cut(own)), "doc_id", "left_semi").select("text")  # at most ``rows`` ids

    words = sample(1).mapInArrow(_terms_of_toxic(listed), "term string, before long, unexplained boolean")
    found = words.groupBy("term").agg(F.count("*").alias("t"), F.sum(F.col("unexplained").cast("int")).alias("u"), F.count_distinct("before").alias("contexts"))
    singles = {" ".join(fold(t)): t for t in listed.weights}
    # Bounded by the sample: a term needs LEAST_CONTEXTS texts.
    found = found.filter((F.col("contexts") >= LEAST_CONTEXTS) | F.col("term").isin([*singles, "", "*"])).collect()
    found = {r["term"]: (r["t"], r["u"], r["contexts"]) for r in found}
    unexplained = found.pop("*", (0, 0, 0))[0]
    toxic = unexplained + found.pop("", (0, 0, 0))[0]
    wanted = frozenset(found) | frozenset(singles)
    clean_counts = sample(0).mapInArrow(_counts_in_clean(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    in_clean = {r["term"]: r["n"] for r in clean_counts}
    clean = in_clean.pop("*", 0)
    if not clean or not toxic:
        return listed
    weights, new = dict(listed.weights), []
    for term in wanted:
        t, u, contexts = found.get(term, (0, 0, 0))
        is_listed, c = term in singles, in_clean.get(term, 0)
        t, whole = (t, toxic) if is_listed else (u, unexplained)
        weight = math.log((t + 0.5) / (whole - t + 0.5)) - math.log((c + 0.5) / (clean - c + 0.5))
        seen = t + c
        if is_listed:
            weights[singles[term]] = (weights[singles[term]] * PRIOR + weight * seen) / (PRIOR + seen)
        elif contexts >= LEAST_CONTEXTS and weight >= LEAST_LEARNED:
            share = whole / (whole + clean)
            z = (t - seen * share) / math.sqrt(seen * share * (1 - share))
            if z >= LEAST_Z:
                new.append((z, len(term), term, weight))
    # The strongest of a family of beginnings; of equal ones the longest.
    taken: list[str] = []
    for _, _, term, weight in sorted(new, reverse=True):
        stem = term.rstrip("*")
        if not any(stem.startswith(other) or other.startswith(stem) for other in taken):
            taken.append(stem)
            weights[term] = weight
    return Lexicon({t: w for t, w in weights.items() if w >= LEAST_WEIGHT}, listed.exceptions, listed.plurals)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    listed: Lexicon | None = None,
    parts: int = 5,
    part: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_words, n_hits, density`` for each row of ``docs``.

    Learns from the rows of ``labels(doc_id, toxic)`` whose crc32 remainder is not
    ``part`` and that have a document; a null label or id teaches nothing, an id with
    labels of both kinds counts as toxic.  A null text counts as empty and is scored.
    Equal texts get equal scores; repeated rows come out once each.  Without labels of
    both kinds the score is density / (1 + density) of the listed lexicon.  Other columns
    of either table are not read.
    """
    lexicon = listed or Lexicon.listed()
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = cut(marks.filter(~held_out(F.col("doc_id"), parts, part)))
    lexicon = learn_lexicon(docs, marks, lexicon, doc_id=doc_id, text=text)
    # Weight per hundred words, of a text that is LENGTH words longer.
    density = 100 * F.col("weight") / (F.col("n_words") + LENGTH)
    seen = cut(match_lexicon(docs, lexicon, doc_id, text).withColumn("density", density))
    place = F.floor(F.least(F.log1p("density") * 50, F.lit(BINS - 1))).cast("int")
    place = F.when(F.col("n_hits") == 0, F.lit(-1)).otherwise(place)
    bins = seen.join(marks, "doc_id").groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum("toxic").alias("g")).collect()
    bins = sorted((r["bin"], float(r["n"]), float(r["g"])) for r in bins)  # BINS + 1 rows at most
    if 0 < sum(g for *_, g in bins) < sum(n for _, n, _ in bins):
        xs, ys = isotonic(bins)
        score = _steps(place, xs, ys)
    else:
        score = F.col("density") / (1 + F.col("density"))
    return seen.select(
        "doc_id",
        held_out(F.col("doc_id"), parts, part).alias("held_out"),
        score.alias("score"),
        (score >= CUT).cast("int").alias("predicted"),
        "n_words",
        "n_hits",
        "density",
    )


def _steps(place, xs: list[float], ys: list[float]):
    """The calibrated value of each bin, on straight lines between the pools."""
    values = np.interp(np.arange(-1, BINS), xs, ys).tolist()
    return F.element_at(F.array(*(F.lit(v) for v in values)), place + 2)


@query("op11_toxicity")
def op11(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

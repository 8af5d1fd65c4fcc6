"""Spelling variants: words one edit apart, by asymmetric chunks.

Of two words one edit apart the shorter is cut into two halves, its chunks.  One edit
leaves one of them whole, at the same place in the other word or moved by one.  So the
one word is indexed by its chunks, the other by its grams of the same lengths at the
places that are within one of a chunk's, and the join on (length, chunk, text) followed
by the edit distance finds every pair.

A half is a weak key for short words.  The edit lies in the other half, so a quarter of
the word beside the half is whole, too; a key is a half with a quarter of the rest.
Everything is DataFrame work: a frequent half makes no large group, and a group that is
still large is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import cut, stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 5, 3
TYPO = 97  # one occurrence in so many loses a letter


def word_counts(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int | None = TYPO,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``word, n`` of the runs of letters of ``docs``, A-Z lower-cased.

    Where ``typo`` divides crc32 of ``<doc_id>:<run>``, the run loses the letter at that
    number modulo its length (``typo=None``: none does).  A null text has no words, a
    null id counts as empty text.  Counts combine in each task before the shuffle.
    """
    source = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))).alias("run"),
    )
    runs = source.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word: Column = F.col("run")
    if typo is not None:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % typo == 0, less).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _pieces(length: Column) -> list[Column]:
    """Ends of the four quarters of a word of ``length``; the second is the end of the first half."""
    half = F.ceil(length / 2).cast("int")
    return [F.ceil(half / 2).cast("int"), half, half + F.ceil((length - half) / 2).cast("int"), length]


def _without(word: Column, start: Column, end: Column) -> Column:
    """A number for ``word`` without the code points from ``start`` to before ``end``."""
    rest = F.concat_ws("\n", F.substring(word, F.lit(1), start), F.substring(word, end + 1, F.length(word)))
    return F.xxhash64(rest)


def _keys(word: Column, length: Column, longer: int) -> Column:
    """One key for each quarter that the edit may lie in: all else of the word is whole.

    For a chunk side ``length`` is the word's own and ``longer`` 0.  For a gram side the
    word has ``longer`` code points more than the chunk side's ``length``: pieces before
    the edit stand where they do there, pieces behind it ``longer`` further.
    """
    ends = _pieces(length)
    starts = [F.lit(0), *ends[:-1]]
    keys = [
        F.struct(length.alias("length"), F.lit(k).alias("piece"), _without(word, a, b + longer).alias("rest"))
        for k, (a, b) in enumerate(zip(starts, ends, strict=True))
    ]
    return F.array(*keys)


def near_words(words: DataFrame, word: str = "word") -> DataFrame:
    """``a, b``: each pair of distinct words that are exactly one edit apart, once.

    Null words match nothing, repeated words count once.
    """
    words = words.select(F.col(word).alias("w")).filter("w IS NOT NULL").distinct()
    length = F.length("w").cast("int")
    chunks = words.select(F.col("w").alias("a"), F.explode(_keys(F.col("w"), length, 0)).alias("key"))
    grams = [words.select(F.col("w").alias("b"), F.explode(_keys(F.col("w"), length - k, k)).alias("key")) for k in (0, 1)]
    met = chunks.select("a", "key.*").join(grams[0].unionByName(grams[1]).select("b", "key.*"), ["length", "piece", "rest"])
    # Of two words of one length each is chunk side once; the smaller one's turn counts.
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    return met.filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each chain of ``forms(word, form)``.

    Forms occur at least twice as often, so chains end.  Each round doubles what a word
    sees of its chain.
    """
    reached = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("at"), F.col("root").alias("next"))
        found = reached.join(ahead, F.col("root") == F.col("at"), "left")
        new = cut(found.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select("word", "root")
        reached = new.select("word", "root")


def group_variants(counts: DataFrame, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``counts(word, n)``.

    A word's form is its near word of largest n (ties: the smallest in code-point order)
    if that is at least ``times`` its own n, at least 2 times for chains to end; root is
    the last word when forms are followed.  Words must be distinct; a null word is left out.
    """
    counts = counts.filter("word IS NOT NULL")
    n = counts.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = near_words(counts)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    near = sides.join(n, "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = counts.select("word", "n").join(near, "word", "left").withColumn("top", -F.col("best.less"))
    is_form = F.col("top") >= times * F.col("n")
    found = stored(
        found.select(
            "word",
            F.when(is_form, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("top")).alias("form_n"),
        )
    )
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Spelling variants among the words of ``docs``; see ``word_counts`` and ``group_variants``.

    Empty tables give no rows; other columns are not read.
    """
    return group_variants(stored(word_counts(docs, doc_id=doc_id, text=text, **limits)))


@query("op13_spelling")
def op13(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))

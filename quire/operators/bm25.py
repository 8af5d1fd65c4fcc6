"""Okapi BM25 over chunks, for many queries at once.

The index is three frames: occurrences of terms in chunks, the vocabulary with
inverse document frequencies, and the corpus totals.  They can be used straight
from the chunks or written once as tables and read back.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import ANALYZERS
from quire.session import hold_if_small, is_small, spread

# Scores are summed in whole billionths, so equal chunks get equal scores in
# whatever order their terms are added.
SCORE_UNIT = 1e9
# Decimals on which other scores are ranked.
RANK_DECIMALS = 9


@dataclass(frozen=True)
class Bm25Index:
    occurrences: DataFrame  # chunk_id, length, term, tf (tf may be split over rows)
    vocabulary: DataFrame  # term, df, idf
    totals: DataFrame  # one row: chunks, avg_length
    analyzer: str = "letters"
    k1: float = 1.5
    b: float = 0.75
    size: DataFrame | None = None  # one row: chunks, counted without analyzing them


def build_index(
    chunks: DataFrame,
    analyzer: str = "letters",
    k1: float = 1.5,
    b: float = 0.75,
    epsilon: float = 0.25,
    id_column: str = "chunk_id",
    text_column: str = "chunk_text",
) -> Bm25Index:
    """Index frames of ``chunks``.

    The vocabulary pass shuffles one row per term and task: the terms of a chunk
    are made distinct inside the row, and the counts combine before the shuffle,
    so a term that occurs in every chunk costs no more than any other.
    """
    texts = spread(chunks.select(F.col(id_column).alias("chunk_id"), F.coalesce(text_column, F.lit("")).alias("text")))
    analyzed = texts.select("chunk_id", ANALYZERS[analyzer](F.col("text")).alias("terms"))
    # The outer form: for the plain one Spark would add a filter on the size of the
    # array below, and so analyze every text twice.
    occurrences = analyzed.select(
        "chunk_id", F.size("terms").alias("length"), F.explode_outer("terms").alias("term")
    ).withColumn("tf", F.lit(1).cast("long"))

    # The first row of every chunk also carries the chunk and its length, which
    # yields the corpus totals without a second pass.  A chunk without terms
    # gives a row with an empty term.
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    counts = (
        analyzed.select(F.size("terms").alias("length"), F.posexplode_outer(F.array_distinct("terms")).alias("pos", "term"))
        .groupBy(F.coalesce("term", F.lit("")).alias("term"))
        .agg(
            F.count("*").alias("df"),
            F.count_if(first).alias("chunks"),
            F.sum(F.when(first, F.col("length")).otherwise(0)).alias("length"),
        )
    )
    # Totals, mean and vocabulary read the same shuffle.  These conditions keep it
    # the same: they use every column and cannot move below the grouping.
    counts = counts.filter((F.col("df") > 0) & (F.col("chunks") >= 0) & (F.col("length") >= 0))
    is_term = F.when(F.col("term") != "", F.col("df")).otherwise(0) > 0

    totals = counts.agg(
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.try_divide(F.sum("length"), F.sum("chunks")).alias("avg_length"),
    )
    n = totals.select("chunks").scalar()
    plain_idf = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = counts.filter(is_term).select("term", "df", plain_idf.alias("plain_idf"))
    # Terms in more than half of the chunks get a share of the mean instead of a
    # negative weight.
    floor = F.lit(epsilon) * terms.select(F.avg("plain_idf")).scalar()
    idf = F.when(F.col("plain_idf") < 0, floor).otherwise(F.col("plain_idf"))
    size = chunks.select(F.count("*").alias("chunks"))
    return Bm25Index(occurrences, terms.select("term", "df", idf.alias("idf")), totals, analyzer, k1, b, size)


# Folders that the postings of a written index are dealt into, by term.
INDEX_BUCKETS = 64
# A search with more different terms reads the folders of its terms, and no less.
MAX_PUSHED_TERMS = 2_000


def term_bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(INDEX_BUCKETS)).cast("int")


# Rows that a task of a search holds at a time; it took 433 MB for them (200 queries).
TASK_ROWS = 2_000_000
MAX_PARTITIONS = 50_000


def dealt(df: DataFrame, rows: int, *keys: str, least: int = 1) -> DataFrame:
    """``df`` hashed by ``keys``, into partitions of about TASK_ROWS of the reckoned ``rows`` at most."""
    parts = min(-(-rows // TASK_ROWS), MAX_PARTITIONS)
    if parts <= df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(*keys)
    return df.repartition(max(parts, least), *keys)


def write_index(index: Bm25Index, path: str, version: str = "") -> None:
    """Write the index as parquet tables, postings in folders by a hash of the term.

    Inside a folder rows are in order of term, so a search reads the folders of its
    terms, and in them the row groups that can hold the terms.  The cluster key also
    takes the chunk: a term in every chunk is spread over the files of its folder.
    ``version`` names the chunks that the index is of.
    """
    settings = index.totals.withColumns(
        {"analyzer": F.lit(index.analyzer), "k1": F.lit(index.k1), "b": F.lit(index.b), "version": F.lit(version)}
    )
    totals = settings.first()
    # Rows move before they are counted: a table of counts for all texts of a reading task would not fit its memory.
    # Each task writes a file in each folder, so there are no more of them than rows ask for.
    hits = index.occurrences.filter("term IS NOT NULL")
    hits = dealt(hits, round(totals["chunks"] * (totals["avg_length"] or 0)), "term", "chunk_id")
    postings = hits.groupBy("term", "chunk_id", "length").agg(F.sum("tf").alias("tf"))
    postings = postings.withColumn("bucket", term_bucket(F.col("term")))
    postings.sortWithinPartitions("bucket", "term", "chunk_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    # Last, as it names the version.
    settings.sparkSession.createDataFrame([totals], settings.schema).write.mode("overwrite").parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str, version: str | None = None) -> Bm25Index:
    """A written index; one of another ``version`` of the chunks is refused."""
    totals = spark.read.parquet(f"{path}/totals")
    row = totals.first()
    if version is not None and row["version"] != version:
        raise ValueError(f"the index is of chunks {row['version']!r}, not of {version!r}; build it again")
    return Bm25Index(
        spark.read.parquet(f"{path}/postings"),
        spark.read.parquet(f"{path}/vocabulary"),
        totals.select("chunks", "avg_length"),
        row["analyzer"],
        row["k1"],
        row["b"],
        totals.select("chunks"),
    )


def pruned(occurrences: DataFrame, wanted: DataFrame) -> DataFrame:
    """Postings of a written index cut down in the scan to the folders and row groups of the terms."""
    if "bucket" not in occurrences.columns:
        return occurrences
    terms = [row["term"] for row in wanted.select("term").limit(MAX_PUSHED_TERMS + 1).collect()]
    if len(terms) <= MAX_PUSHED_TERMS:
        buckets = sorted({zlib.crc32(t.encode()) % INDEX_BUCKETS for t in terms})
        return occurrences.filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)) if terms else occurrences.limit(0)
    buckets = [row[0] for row in wanted.select(term_bucket(F.col("term"))).distinct().collect()]
    return occurrences.filter(F.col("bucket").isin(*buckets))


def query_terms(queries: DataFrame, analyzer: str) -> DataFrame:
    """(query_id, term, qtf) of (query_id, query_text)."""
    terms = queries.select("query_id", F.explode(ANALYZERS[analyzer](F.col("query_text"))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


# Different terms of the queries that a chunk is taken to hold when its rows are reckoned.
CHUNK_TERMS = 256


def by_chunk(index: Bm25Index, terms: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` hashed by chunk, into partitions whose tasks hold about TASK_ROWS rows at most.

    A chunk becomes a row for each of its terms and one for each query.  The bytes that
    move tell nothing of this, so adaptive execution would make as many tasks as there are
    cores, whatever the number of chunks.
    """
    size = index.totals if index.size is None else index.size
    chunks = size.select("chunks").first()["chunks"]
    asked = terms.agg(F.count_distinct("query_id").alias("queries"), F.count_distinct("term").alias("terms")).first()
    least = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt(hits, chunks * (asked["queries"] + min(asked["terms"], CHUNK_TERMS)), "chunk_id", least=least)


def score(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk with a positive score.

    Occurrences are cut down to the terms of the queries before they move, then
    hashed by chunk once.  With the query weights broadcast, the term counts, the
    scores and the first cut of the top-k all run inside those partitions.
    """
    queries = hold_if_small(queries.select("query_id", "query_text"))
    # There are at most as many terms as bytes of query text.
    small = is_small(queries)
    terms = query_terms(queries, index.analyzer)
    wanted = terms.select("term").distinct()
    if small:
        # A numeric key for the few terms makes the shuffle and the joins cheaper.
        wanted = wanted.withColumn("key", F.row_number().over(Window.orderBy("term")))
        keyed = pruned(index.occurrences, wanted).join(F.broadcast(wanted), "term")
    else:
        keyed = index.occurrences.join(wanted, "term", "left_semi").withColumn("key", F.col("term"))
    hits = keyed.select("chunk_id", "length", "key", "tf")
    # With many queries their pairs with chunks are hashed again, and aggregated before.
    hits = by_chunk(index, terms, hits) if small else hits.repartition("chunk_id")
    hits = hits.groupBy("chunk_id", "length", "key").agg(F.sum("tf").alias("tf"))
    avg_length = index.totals.select("avg_length").scalar()
    norm = F.lit(1 - index.b) + F.lit(index.b) * F.col("length") / avg_length
    hits = hits.select(
        "chunk_id", "key", (F.col("tf") * F.lit(index.k1 + 1) / (F.col("tf") + F.lit(index.k1) * norm)).alias("weight")
    )

    weights = terms.join(index.vocabulary.select("term", "idf"), "term")
    weights = weights.join(F.broadcast(wanted), "term") if small else weights.withColumn("key", F.col("term"))
    weights = weights.select("query_id", "key", (F.col("qtf") * F.col("idf")).alias("query_weight"))
    if small:
        weights = F.broadcast(weights)
    units = F.floor(F.col("query_weight") * F.col("weight") * F.lit(SCORE_UNIT) + 0.5)
    return (
        hits.join(weights, "key")
        .groupBy("query_id", "chunk_id")
        .agg((F.sum(units) / F.lit(SCORE_UNIT)).alias("score"))
        .filter(F.col("score") > 0)
    )


def top_k(scored: DataFrame, k: int, by: str = "score", decimals: int | None = RANK_DECIMALS) -> DataFrame:
    """Best ``k`` rows of each query with their rank; ties go to the smaller id.

    Spark cuts each partition to ``k`` rows per query before it shuffles.
    """
    key = F.round(by, decimals) if decimals is not None else F.col(by)
    order = Window.partitionBy("query_id").orderBy(key.desc(), F.col("chunk_id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Bm25Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best ``k`` chunks of each query."""
    return top_k(score(index, queries), k, decimals=None)

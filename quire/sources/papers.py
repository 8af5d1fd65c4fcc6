"""Paper sources: raw records in, rows of the corpus out."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import ids
from quire.functions.text import has_text, strip
from quire.operators.selection import Key, in_order

SAMPLE_SEED = 42

PAPER_COLUMNS = [
    "id",
    "source_id",
    "source",
    "title",
    "abstract",
    "authors",
    "year",
    "venue",
    "volume",
    "full_text",
    "url",
    "metadata",
]


class PaperSource(Protocol):
    """A place papers come from."""

    source_name: str

    def validate_source(self, spark: SparkSession) -> bool: ...

    def load(
        self,
        spark: SparkSession,
        year_from: int | None = None,
        year_to: int | None = None,
        venues: list[str] | None = None,
        max_papers: int | None = None,
    ) -> DataFrame: ...


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever file system it names."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def in_years(df: DataFrame, year_from: int | None, year_to: int | None) -> DataFrame:
    """Inclusive bounds on the stored year, which reach the scan."""
    if year_from is not None:
        df = df.filter(F.col("year") >= year_from)
    if year_to is not None:
        df = df.filter(F.col("year") <= year_to)
    return df


def in_venues(df: DataFrame, venues: list[str] | None) -> DataFrame:
    """Requested venues, lower-cased; rows without a venue drop out."""
    return df.filter(F.col("venue").isin([name.lower() for name in venues])) if venues else df


def with_text(df: DataFrame) -> DataFrame:
    """Rows with a title and an abstract that is not blank."""
    return df.dropna(subset=["title", "abstract"]).filter(has_text(F.col("abstract")))


def sample(df: DataFrame, n: int | None, key: str, seed: int = SAMPLE_SEED) -> DataFrame:
    """A random but repeatable choice of ``n`` rows, by the hash of their key."""
    if n is None:
        return df
    return in_order(df, [Key(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))), Key(F.col(key))], n)


def first(df: DataFrame, n: int | None, key: str) -> DataFrame:
    return in_order(df, [Key(F.col(key))], n) if n is not None else df


def _authors(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.array().cast("array<string>")
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return ids.authors_from_text(F.col(name))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return ids.authors_from_structs(F.col(name))
    return ids.authors_from_list(F.col(name))


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _metadata(df: DataFrame, names: list[str]) -> Column:
    present = [x for n in names if n in df.columns for x in (F.lit(n), F.col(n).cast("string"))]
    return F.create_map(*present) if present else F.create_map().cast("map<string,string>")


def normalize_publications(raw: DataFrame, source_name: str) -> DataFrame:
    """Publication records (acl_id, title, abstract, author, year, booktitle, ...) as papers."""
    full_text = _optional(raw, "full_text")
    source_id = F.coalesce(_optional(raw, "acl_id"), F.lit(""))
    return raw.select(
        ids.paper_id(F.lit(source_name), source_id).alias("id"),
        source_id.alias("source_id"),
        F.lit(source_name).alias("source"),
        strip(F.col("title")).alias("title"),
        strip(F.col("abstract")).alias("abstract"),
        _authors(raw, "author").alias("authors"),
        F.col("year").cast("int").alias("year"),
        ids.venue_from_id(_optional(raw, "acl_id"), _optional(raw, "booktitle")).alias("venue"),
        ids.volume_from_id(_optional(raw, "acl_id")).alias("volume"),
        F.when(has_text(full_text), full_text).alias("full_text"),
        _optional(raw, "url").alias("url"),
        _metadata(raw, ["corpus_paper_id", "pdf_hash", "booktitle", "numcitedby"]).alias("metadata"),
    )


class PublicationParquet:
    """Parquet file of publications with full texts."""

    def __init__(self, path: str, source_name: str = "hf_acl_ocl"):
        self.path, self.source_name = path, source_name

    def validate_source(self, spark: SparkSession) -> bool:
        return path_exists(spark, self.path)

    def load(self, spark, year_from=None, year_to=None, venues=None, max_papers=None) -> DataFrame:
        if not self.validate_source(spark):
            raise FileNotFoundError(self.path)
        raw = with_text(in_years(spark.read.parquet(self.path), year_from, year_to))
        papers = in_venues(normalize_publications(raw, self.source_name), venues)
        return sample(papers, max_papers, "id")


ANTHOLOGY_SCHEMA = (
    "full_id string, title string, abstract string, year string, venue_ids array<string>, "
    "authors array<struct<first:string,last:string>>, pdf_url string, web_url string, bibkey string, doi string"
)


def normalize_anthology(raw: DataFrame, source_name: str) -> DataFrame:
    """Exported anthology records as papers; a year that is no number drops the record."""
    return raw.select(
        ids.paper_id(F.lit(source_name), F.col("full_id")).alias("id"),
        F.col("full_id").alias("source_id"),
        F.lit(source_name).alias("source"),
        strip(F.col("title")).alias("title"),
        strip(F.col("abstract")).alias("abstract"),
        ids.authors_from_structs(F.col("authors")).alias("authors"),
        strip(F.col("year")).try_cast("int").alias("year"),
        ids.venue_from_ids(F.col("venue_ids")).alias("venue"),
        ids.volume_from_id(F.col("full_id")).alias("volume"),
        F.lit(None).cast("string").alias("full_text"),
        F.coalesce(F.nullif("pdf_url", F.lit("")), "web_url").alias("url"),
        F.create_map(
            F.lit("bibkey"), "bibkey", F.lit("doi"), "doi", F.lit("venue_ids"), F.array_join("venue_ids", ",")
        ).alias("metadata"),
    ).filter(F.col("year").isNotNull() & has_text(F.col("abstract")))


class AnthologyExport:
    """JSON lines exported from an anthology package."""

    def __init__(self, path: str, source_name: str = "acl_anthology"):
        self.path, self.source_name = path, source_name

    def validate_source(self, spark: SparkSession) -> bool:
        return path_exists(spark, self.path)

    def load(self, spark, year_from=None, year_to=None, venues=None, max_papers=None) -> DataFrame:
        if not self.validate_source(spark):
            raise FileNotFoundError(self.path)
        raw = spark.read.schema(ANTHOLOGY_SCHEMA).json(self.path)
        papers = in_years(normalize_anthology(raw, self.source_name), year_from, year_to)
        return first(in_venues(papers, venues), max_papers, "source_id")

"""Full texts: what to fetch, fetching, and turning files into text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.ids import safe_file_name
from quire.functions.text import clean_lines, has_text, strip

MIN_PAGE_TEXT = 500
MIN_TEI_TEXT = 200
MIN_FILE_BYTES = 1000


def missing_full_text(papers: DataFrame) -> DataFrame:
    """Papers with a PDF address and no full text."""
    no_text = F.col("full_text").isNull() | (F.col("full_text") == "")
    return papers.filter(F.lower("url").endswith(".pdf") & no_text)


def work_list(todo: DataFrame, done: DataFrame, failed: DataFrame, retry_failed: bool = True) -> DataFrame:
    """Papers of ``todo`` (id, ...) that are not done; failed ones again or not."""
    skip = done.select("id") if retry_failed else done.select("id").unionByName(failed.select("id"))
    return todo.dropDuplicates(["id"]).join(skip, "id", "left_anti")


def fetch(papers: DataFrame, transport: Callable[[str], bytes]) -> DataFrame:
    """(id, file_name, content, error) of papers with ``url``.

    ``transport`` gets an address and returns its bytes; errors and files below
    the minimal size become rows with an error, so a failed address never fails
    the job.
    """

    @F.pandas_udf("content binary, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch:
                try:
                    content = transport(url)
                    small = len(content) < MIN_FILE_BYTES
                    rows.append((None, f"only {len(content)} bytes") if small else (content, None))
                except Exception as error:
                    rows.append((None, str(error)))
            yield pd.DataFrame(rows, columns=["content", "error"])

    got = papers.select("id", safe_file_name(F.col("id")).alias("file_name"), run(F.col("url")).alias("r"))
    return got.select("id", "file_name", "r.content", "r.error")


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(file_name, content) of files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("file_name"), "content")


def page_texts(content: str, reader: Callable[[bytes], list[str]]) -> Column:
    """Pages of a file as an array of texts; unreadable files give null.

    ``reader`` turns the bytes of one file into its page texts.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def pages(data: bytes) -> list[str] | None:
            try:
                return list(reader(bytes(data)))
            except Exception:
                return None

        for batch in batches:
            yield batch.map(pages, na_action="ignore")

    return run(F.col(content))


def text_of_pages(pages: Column) -> Column:
    """Pages that are not blank, joined and cleaned; short results give null."""
    text = clean_lines(F.array_join(F.filter(pages, has_text), "\n\n"))
    return F.when(F.length(text) >= MIN_PAGE_TEXT, text)


# Characters that no document holds (Unicode keeps them free); they mark the texts of
# blocks, which the path expression returns piece by piece.
ABSTRACT_MARK, HEAD_MARK, BLOCK_END = "\ufdd0", "\ufdd1", "\ufdd2"
TEI_BLOCKS = (
    "//profileDesc/abstract//text() | //text/body//div/head/text() | //text/body//div/head/*[1]/preceding-sibling::text()"
    " | //text/body//div/p//text()"
)


def text_of_tei(document: Column) -> Column:
    """Abstract, headings and paragraphs of a TEI document as plain text.

    One path expression returns their texts in document order.  Marks put into the
    document before it is parsed tell where blocks begin and end, so texts of nested
    tags stay in their block, joined by a space.  A heading counts up to its first
    nested tag and stands between line ends.  Documents that are no well-formed XML and
    results of MIN_TEI_TEXT characters or less give null.
    """
    marks = f"[{ABSTRACT_MARK}{HEAD_MARK}{BLOCK_END}]"
    plain = F.regexp_replace(document, marks, "")
    parsed = F.from_xml(plain, "struct<_corrupt_record:string>", {"mode": "PERMISSIVE"})
    whole = parsed.isNotNull() & parsed["_corrupt_record"].isNull() & F.regexp_like(plain, F.lit(r"(?s)\A\s*<.*>\s*\z"))
    marked = F.regexp_replace(plain, r"(<(?:p|abstract)(?:\s[^<>]*[^<>/])?>)", f"$1{ABSTRACT_MARK}")
    marked = F.regexp_replace(marked, r"(<head(?:\s[^<>]*[^<>/])?>)", f"$1{HEAD_MARK}")
    marked = F.regexp_replace(marked, r"(</(?:p|abstract|head)>)", f"{BLOCK_END}$1")
    nodes = F.xpath(marked, F.lit(TEI_BLOCKS))
    parts = F.split(F.array_join(nodes, " "), f"(?={ABSTRACT_MARK}|{HEAD_MARK})")

    def block(part: Column) -> Column:
        text = strip(F.regexp_replace(part, marks, ""))
        return F.when(part.startswith(HEAD_MARK) & (text != ""), F.concat(F.lit("\n"), text, F.lit("\n"))).otherwise(text)

    text = F.array_join(F.filter(F.transform(parts, block), lambda t: t != ""), "\n\n")
    return F.when(whole, F.when(F.length(text) > MIN_TEI_TEXT, text))


def update_full_text(papers: DataFrame, updates: DataFrame) -> DataFrame:
    """Papers with the full texts of ``updates`` (id, full_text) put in."""
    new = updates.select("id", F.col("full_text").alias("new_text"))
    return (
        papers.join(new, "id", "left")
        .withColumn("full_text", F.coalesce("new_text", "full_text"))
        .select(*papers.columns)
    )

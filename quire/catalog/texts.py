"""Chunking, token statistics, identifiers and text shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import views as v
from quire.catalog.registry import query
from quire.functions import ids, text
from quire.operators import counts
from quire.operators.chunking import chunk_papers
from quire.session import spread

# Whitespace as the operators see it; the texts hold no exotic spaces.
WORDS_SQL = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"


def words_sql(column: str) -> str:
    return WORDS_SQL.format(column)


CHUNKS_SQL = f"""WITH w AS (SELECT id, {words_sql('full_text')} AS ws FROM docs),
    s AS (SELECT id, ws, unnest(range(0, greatest(1, len(ws) - 38), 355)) AS start FROM w WHERE len(ws) > 0),
    c AS (SELECT id AS paper_id, CAST(start / 355 AS INTEGER) AS chunk_index, ws[start + 1 : start + 393] AS cw FROM s)
"""


@query(
    "chunk_abstract",
    f"""SELECT id AS paper_id, 0 AS chunk_index, regexp_replace(abstract, '^\\s+|\\s+$', '', 'g') AS chunk_text,
        'abstract' AS chunk_type, CAST(floor(len({words_sql('abstract')}) * 1.3::DOUBLE) AS INTEGER) AS token_count
        FROM docs WHERE regexp_matches(abstract, '\\S')""",
    ("docs",),
)
def chunk_abstract(spark, d):
    return chunk_papers(v.docs(spark, d), "abstract")


@query(
    "chunk_fixed",
    CHUNKS_SQL
    + """SELECT paper_id, chunk_index, array_to_string(cw, ' ') AS chunk_text, 'full_text' AS chunk_type,
         CAST(floor(len(cw) * 1.3::DOUBLE) AS INTEGER) AS token_count FROM c""",
    ("docs",),
)
def chunk_fixed(spark, d):
    return chunk_papers(v.docs(spark, d), "fixed")


@query(
    "chunk_count",
    CHUNKS_SQL + "SELECT count(*) AS n FROM c",
    ("docs",),
)
def chunk_count(spark, d):
    return counts.count_rows(chunk_papers(v.docs(spark, d), "fixed"))


@query(
    "chunk_stats",
    CHUNKS_SQL
    + """SELECT count(*) AS chunks, count(DISTINCT paper_id) AS papers,
         round(count(*) / count(DISTINCT paper_id)::DOUBLE, 6) AS chunks_per_paper,
         round(sum(floor(len(cw) * 1.3::DOUBLE)) / count(*), 6) AS tokens_per_chunk FROM c""",
    ("docs",),
)
def chunk_stats(spark, d):
    return counts.chunk_stats(chunk_papers(v.docs(spark, d), "fixed")).withColumns(
        {c: F.round(c, 6) for c in ("chunks_per_paper", "tokens_per_chunk")}
    )


def sectioned(docs):
    """Documents as papers with headings: the first and the second half of the
    lines of every text become two sections, its language chooses the headings."""
    lines = F.split("full_text", "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    first = F.array_join(F.slice(lines, 1, half), "\n")
    second = F.array_join(F.slice(lines, half + 1, F.size(lines)), "\n")
    heading = F.when(F.col("lang") == "en", "\n1. Introduction\n").when(F.col("lang") == "fr", "\nRELATED  WORK \n\n")
    text_ = F.concat(first, F.coalesce(heading, F.lit("\n")), second, F.lit("\n2 Results and Discussion\n"), first)
    return docs.withColumn("full_text", F.when(F.col("lang") != "de", text_).otherwise(F.col("full_text")))


@query(
    "chunk_section",
    f"""WITH l AS (SELECT id, lang, abstract, string_split(full_text, chr(10)) AS ls FROM docs),
    h AS (SELECT id, lang, abstract, array_to_string(ls[1:len(ls) // 2], chr(10)) AS a,
          array_to_string(ls[len(ls) // 2 + 1:], chr(10)) AS b FROM l),
    p AS (
      SELECT id, 1 AS ord, CASE WHEN lang IN ('en', 'fr') THEN a ELSE a || chr(10) || b END AS body,
             'preamble' AS chunk_type FROM h WHERE lang <> 'de'
      UNION ALL
      SELECT id, 2, CASE lang WHEN 'en' THEN '1. Introduction' || chr(10) || b
                    ELSE 'RELATED  WORK ' || chr(10) || chr(10) || b END,
             CASE lang WHEN 'en' THEN 'introduction' ELSE 'section' END FROM h WHERE lang IN ('en', 'fr')
      UNION ALL
      SELECT id, 3, '2 Results and Discussion' || chr(10) || a, 'result' FROM h WHERE lang <> 'de'),
    k AS (SELECT id, ord, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS body, chunk_type,
          len({words_sql('body')}) AS n FROM p),
    kept AS (SELECT * FROM k WHERE n >= 50),
    fixed AS (
      SELECT id, unnest(range(0, greatest(1, len(ws) - 38), 355)) AS start, ws
      FROM (SELECT id, {words_sql('full_text')} AS ws FROM docs WHERE lang = 'de')),
    all_chunks AS (
      SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS INTEGER) AS i, body, chunk_type, n
      FROM kept
      UNION ALL
      SELECT id, 0, regexp_replace(abstract, '^\\s+|\\s+$', '', 'g'), 'abstract', len({words_sql('abstract')})
      FROM docs WHERE lang <> 'de' AND id NOT IN (SELECT id FROM kept)
      UNION ALL
      SELECT id, CAST(start / 355 AS INTEGER), array_to_string(ws[start + 1 : start + 393], ' '), 'full_text',
             len(ws[start + 1 : start + 393]) FROM fixed)
    SELECT id AS paper_id, i AS chunk_index, body AS chunk_text, chunk_type,
           CAST(floor(n * 1.3::DOUBLE) AS INTEGER) AS token_count FROM all_chunks""",
    ("docs",),
)
def chunk_section(spark, d):
    return chunk_papers(sectioned(v.docs(spark, d)), "section")


@query(
    "token_stats",
    f"""SELECT source, count(*) AS papers, CAST(sum(floor(len({words_sql('full_text')}) * 1.3::DOUBLE)) AS BIGINT) AS tokens,
        round(avg(length(full_text)), 6) AS avg_chars FROM docs GROUP BY source""",
    ("docs",),
)
def token_stats(spark, d):
    n = text.estimate_tokens(text.word_count(F.col("full_text")))
    return (
        v.docs(spark, d)
        .groupBy("source")
        .agg(
            F.count("*").alias("papers"),
            F.sum(n).alias("tokens"),
            F.round(F.avg(F.length("full_text")), 6).alias("avg_chars"),
        )
    )


@query(
    "full_text_stats",
    """SELECT count(*) AS papers, count(*) FILTER (full_text <> '') AS with_full_text,
       round(avg(length(full_text)) FILTER (full_text <> ''), 6) AS avg_chars
       FROM (SELECT CASE WHEN lang <> 'es' THEN full_text WHEN source < 'src2' THEN '' END AS full_text FROM docs)""",
    ("docs",),
)
def full_text_stats(spark, d):
    known = F.when(F.col("lang") != "es", F.col("full_text")).when(F.col("source") < "src2", F.lit(""))
    return counts.full_text_stats(v.docs(spark, d).withColumn("full_text", known)).withColumn(
        "avg_chars", F.round("avg_chars", 6)
    )


@query(
    "term_counts",
    r"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents)
        GROUP BY term""",
)
def term_counts(spark, d):
    terms = spread(v.table(spark, d, "documents").select("text")).select(F.explode(text.letter_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


@query(
    "clean_lines",
    r"""WITH t AS (SELECT doc_id, array_to_string(list_transform(
            string_split(replace(text, '. ', '.' || chr(10) || ' ' || chr(10) || ' ' || chr(10) || '  '), chr(10)),
            lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)) AS x FROM documents)
        SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'),
               '^\n+', ''), '\n\n$', chr(10))) AS digest FROM t""",
)
def clean_lines(spark, d):
    loose = F.replace("text", F.lit(". "), F.lit(".\n \n \n  "))
    return v.table(spark, d, "documents").select("doc_id", F.md5(text.clean_lines(loose)).alias("digest"))


@query(
    "snippets",
    r"""SELECT conv_id, turn,
        CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS plain,
        CASE WHEN length(text) > 80 THEN regexp_replace(substr(text, 1, 80), '\s+$', '') || '…' ELSE text END AS trimmed
        FROM conversations""",
)
def snippets(spark, d):
    body = F.col("text")
    return v.table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        text.truncate(body, 80).alias("plain"),
        text.truncate(body, 80, "…", trim_end=True).alias("trimmed"),
    )


@query(
    "venue_from_id",
    """WITH i AS (
         SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN substr(p_type, 1, 1) || '18-' || p_partkey
                ELSE '2022.' || replace(p_name, ' ', '-') || '.' || p_partkey END AS acl_id FROM part)
       SELECT p_partkey, acl_id,
         CASE substr(acl_id, 1, 1) WHEN 'P' THEN 'acl' WHEN 'E' THEN 'eacl' WHEN 'S' THEN 'semeval'
           ELSE CASE WHEN contains(acl_id, '.') THEN split_part(split_part(acl_id, '.', 2), '-', 1) END END AS venue,
         CASE WHEN contains(acl_id, '.') THEN split_part(split_part(acl_id, '.', 2), '-', 2) END AS volume
       FROM i""",
)
def venue_from_id(spark, d):
    key = F.col("p_partkey").cast("string")
    legacy = F.concat(F.substring("p_type", 1, 1), F.lit("18-"), key)
    dotted = F.concat(F.lit("2022."), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("."), key)
    acl_id = F.when(F.col("p_size") % 2 == 0, legacy).otherwise(dotted)
    return (
        v.table(spark, d, "part")
        .select("p_partkey", acl_id.alias("acl_id"))
        .select(
            "p_partkey",
            "acl_id",
            ids.venue_from_id(F.col("acl_id")).alias("venue"),
            ids.volume_from_id(F.col("acl_id")).alias("volume"),
        )
    )


@query(
    "venue_from_booktitle",
    """WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Proceedings of NAACL ' || o_orderpriority
         WHEN 'O' THEN 'Empirical Methods in Natural Language Processing'
         ELSE 'Journal of Computational Linguistics ' END AS title FROM orders)
       SELECT o_orderkey, CASE WHEN title ILIKE '%acl%' THEN 'acl' WHEN title ILIKE '%empirical%' THEN 'emnlp'
         WHEN title ILIKE '%computational linguistics%' THEN 'cl' END AS venue,
         CASE WHEN title ILIKE '%naacl%' THEN 'naacl' WHEN title ILIKE '%empirical%' THEN 'emnlp'
         WHEN title ILIKE '%computational linguistics%' THEN 'cl' END AS exact_venue FROM t""",
)
def venue_from_booktitle(spark, d):
    status = F.col("o_orderstatus")
    title = (
        F.when(status == "F", F.concat(F.lit("Proceedings of NAACL "), F.col("o_orderpriority")))
        .when(status == "O", "Empirical Methods in Natural Language Processing")
        .otherwise("Journal of Computational Linguistics ")
    )
    return v.table(spark, d, "orders").select(
        "o_orderkey",
        ids.venue_from_booktitle(title).alias("venue"),
        ids.venue_from_booktitle(title, whole_words=True).alias("exact_venue"),
    )


@query(
    "parse_authors",
    """WITH f AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', ' and ')
         WHEN p_size % 3 = 1 THEN p_name || ', ' || p_type || ' , ,' || p_brand END AS field, p_name, p_size FROM part)
       SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN replace(field, ' and ', '; ')
         WHEN p_size % 3 = 1 THEN replace(replace(field, ' , ,', '; '), ', ', '; ') END, '') AS authors,
         CASE WHEN p_size % 2 = 0 THEN p_name || '; ' || split_part(p_name, ' ', 1)
              ELSE p_name END AS named FROM f""",
)
def parse_authors(spark, d):
    kind = F.col("p_size") % 3
    field = F.when(kind == 0, F.replace("p_name", F.lit(" "), F.lit(" and "))).when(
        kind == 1, F.concat("p_name", F.lit(", "), "p_type", F.lit(" , ,"), "p_brand")
    )
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    no_last = F.struct(first.alias("first"), F.when(F.col("p_size") % 2 == 0, F.lit("")).alias("last"))
    full = F.struct(first.alias("first"), last.alias("last"))
    empty = F.struct(F.lit("").alias("first"), F.lit("").alias("last"))
    structs = F.array(full, F.when(F.col("p_size") % 2 == 0, no_last).otherwise(empty))
    return v.table(spark, d, "part").select(
        "p_partkey",
        F.array_join(ids.authors_from_text(field), "; ").alias("authors"),
        F.array_join(ids.authors_from_structs(structs), "; ").alias("named"),
    )


@query(
    "venue_from_ids",
    """SELECT l_orderkey, l_linenumber, l_quantity,
         CASE WHEN l_returnflag = 'A' THEN 'acl' WHEN l_linestatus = 'O' THEN 'emnlp'
              ELSE lower(l_returnflag) END AS venue
       FROM lineitem""",
)
def venue_from_ids(spark, d):
    flag = F.when(F.col("l_returnflag") == "A", F.lit("ACL")).otherwise(F.col("l_returnflag"))
    status = F.when(F.col("l_linestatus") == "O", F.lit("Emnlp")).otherwise(F.lit("zz"))
    return v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", ids.venue_from_ids(F.array(flag, status)).alias("venue")
    )

"""Loading papers, full texts, appending without duplicates, rate limiting."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import views as v
from quire.catalog.registry import query
from quire.catalog.texts import CHUNKS_SQL
from quire.operators import browse, ratelimit
from quire.operators.chunking import chunk_papers, stable_chunk_ids
from quire.plans.ingest import pair_vectors
from quire.session import broadcast_if_small, scratch_folder
from quire.sources import fulltext, papers, store
from quire.streaming.ratelimit import admit_stream


def raw_publications(spark, d):
    doc_id = F.col("doc_id").cast("string")
    return v.table(spark, d, "documents").select(
        F.concat(F.lit("2022."), "lang", F.lit("-long."), doc_id).alias("acl_id"),
        F.when(F.col("source") != "src3", F.concat(F.lit(" Paper "), doc_id)).alias("title"),
        F.concat(F.lit(" \t"), "text", F.lit("\n")).alias("abstract"),
        F.concat("lang", F.lit(" and "), "source").alias("author"),
        (F.lit(2000) + F.length("text") % 20).cast("bigint").alias("year"),
        F.when(F.col("lang") != "de", F.col("text")).otherwise(" ").alias("full_text"),
        F.lit("Proceedings").alias("booktitle"),
    )


@query(
    "load_publications",
    r"""SELECT 'hf_acl_ocl::2022.' || lang || '-long.' || doc_id AS id, 'Paper ' || doc_id AS title,
          md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS abstract_digest, lang || '; ' || source AS authors,
          CAST(2000 + length(text) % 20 AS INTEGER) AS year, lang AS venue, 'long' AS volume,
          lang <> 'de' AS has_full_text, 'Proceedings' AS booktitle
        FROM documents
        WHERE 2000 + length(text) % 20 BETWEEN 2005 AND 2015 AND source <> 'src3' AND lang IN ('en', 'de')""",
)
def load_publications(spark, d):
    raw = papers.with_text(papers.in_years(raw_publications(spark, d), 2005, 2015))
    loaded = papers.in_venues(papers.normalize_publications(raw, "hf_acl_ocl"), ["EN", "de"])
    return loaded.select(
        "id",
        "title",
        F.md5("abstract").alias("abstract_digest"),
        F.array_join("authors", "; ").alias("authors"),
        "year",
        "venue",
        "volume",
        F.col("full_text").isNotNull().alias("has_full_text"),
        F.col("metadata")["booktitle"].alias("booktitle"),
    )


@query(
    "load_anthology",
    """SELECT 'acl_anthology::' || 'x.' || p_name || '-' || p_brand AS id, CAST(1990 + p_size AS INTEGER) AS year,
         split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS authors, lower(p_type) AS venue,
         p_brand AS volume, CASE WHEN p_retailprice > 1500 THEN 'https://x/' || p_partkey ELSE p_type END AS url
       FROM part WHERE p_brand <> 'Brand#7'""",
)
def load_anthology(spark, d):
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    key = F.col("p_partkey").cast("string")
    raw = v.table(spark, d, "part").select(
        F.concat(F.lit("x."), "p_name", F.lit("-"), "p_brand").alias("full_id"),
        F.concat("p_name", key).alias("title"),
        F.lit("some text").alias("abstract"),
        F.when(F.col("p_brand") == "Brand#7", "n.d.")
        .otherwise(F.concat(F.lit(" "), (F.col("p_size") + 1990).cast("string")))
        .alias("year"),
        F.array("p_type").alias("venue_ids"),
        F.array(F.struct(first.alias("first"), last.alias("last"))).alias("authors"),
        F.when(F.col("p_retailprice") > 1500, F.concat(F.lit("https://x/"), key)).otherwise("").alias("pdf_url"),
        F.col("p_type").alias("web_url"),
        key.alias("bibkey"),
        F.lit(None).cast("string").alias("doi"),
    )
    loaded = papers.normalize_anthology(raw, "acl_anthology")
    return loaded.select("id", "year", F.array_join("authors", "; ").alias("authors"), "venue", "volume", "url")


@query(
    "sample_papers",
    "SELECT id, title, year, venue FROM papers ORDER BY md5('42|' || id), id LIMIT 100",
    ("papers",),
)
def sample_papers(spark, d):
    return papers.sample(v.papers(spark, d), 100, "id").select("id", "title", "year", "venue")


@query(
    "first_papers",
    "SELECT id, title, year, venue FROM papers ORDER BY id LIMIT 100",
    ("papers",),
)
def first_papers(spark, d):
    return papers.first(v.papers(spark, d), 100, "id").select("id", "title", "year", "venue")


@query(
    "sample_most_papers",
    "SELECT id, title, year, venue FROM papers ORDER BY md5('42|' || id), id LIMIT 12000",
    ("papers",),
)
def sample_most_papers(spark, d):
    """A sample beyond what one task orders."""
    return papers.sample(v.papers(spark, d), 12_000, "id").select("id", "title", "year", "venue")


@query(
    "snapshot_papers",
    "SELECT id, title, year, venue, 'papers/v1/' AS folder FROM papers",
    ("papers",),
)
def snapshot_papers(spark, d):
    """Papers stored, copied to another place and read there, each from a file that the listing names."""
    rows = v.papers(spark, d).select("id", "title", "year", "venue")
    tables = store.TableStore(spark, scratch_folder(spark, "store"), {"papers": rows.schema})
    tables.create()
    tables.overwrite("papers", rows)
    there = store.TableStore(spark, scratch_folder(spark, "snapshot"), tables.schemas)
    tables.copy_to(there.root)
    listed = there.files("papers/").select(F.substring_index("path", "/", -1).alias("file"), F.regexp_extract("path", "^.*/", 0).alias("folder"))
    found = there.read("papers").withColumn("file", F.substring_index(F.input_file_name(), "/", -1))
    return found.join(broadcast_if_small(listed), "file").select("id", "title", "year", "venue", "folder")


@query(
    "dedup_append",
    """SELECT id, title || ' (first)' AS title, year, venue FROM papers
       WHERE id NOT IN (SELECT 'orders::' || o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    ("papers",),
)
def dedup_append(spark, d):
    known = (
        v.table(spark, d, "orders")
        .filter("o_orderstatus = 'F'")
        .select(F.concat(F.lit("orders::"), F.col("o_orderkey").cast("string")).alias("id"))
    )
    rows = v.papers(spark, d).select("id", "title", "year", "venue")
    again = rows.select("id", F.concat("title", F.lit(" (second)")).alias("title"), "year", "venue", F.lit(2).alias("seq"))
    once = rows.select("id", F.concat("title", F.lit(" (first)")).alias("title"), "year", "venue", F.lit(1).alias("seq"))
    return store.new_papers(known, again.unionByName(once), "seq").drop("seq")


FIRST_SQL = """WITH r AS (SELECT lang AS id, doc_id, source,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS n FROM documents)"""


def loaded_twice(spark, d):
    """A source that has each id many times, with other titles and authors, and its order."""
    return v.table(spark, d, "documents").select(
        F.col("lang").alias("id"),
        F.concat(F.lit("Paper "), F.col("doc_id").cast("string")).alias("title"),
        F.array("source", F.col("doc_id").cast("string")).alias("authors"),
        (-F.col("doc_id")).alias("load_order"),
    )


@query(
    "first_duplicate_papers",
    FIRST_SQL + " SELECT id, 'Paper ' || doc_id AS title FROM r WHERE n = 1",
)
def first_duplicate_papers(spark, d):
    rows = loaded_twice(spark, d)
    return store.new_papers(rows.select("id").limit(0), rows, "load_order").select("id", "title")


@query(
    "first_duplicate_authors",
    FIRST_SQL + """ SELECT id AS paper_id, source AS name, 0 AS position FROM r WHERE n = 1
                    UNION ALL SELECT id, CAST(doc_id AS VARCHAR), 1 FROM r WHERE n = 1""",
)
def first_duplicate_authors(spark, d):
    rows = loaded_twice(spark, d)
    fresh = store.author_rows(store.new_papers(rows.select("id").limit(0), rows, "load_order"))
    return store.new_author_rows(fresh.limit(0), fresh)


def part_of_docs(spark, d, everything):
    docs = v.docs(spark, d)
    return docs if everything else docs.filter("doc_id % 2 = 0")


def vectors_of(chunks):
    """Stands for an encoder: a vector made from the chunk's own text."""
    text = F.col("chunk_text")
    return chunks.select(F.col("id").alias("chunk_id"), F.array(F.length(text).cast("double"), F.crc32(text.cast("binary")).cast("double")).alias("embedding"))


@query(
    "rebuild_pairing",
    CHUNKS_SQL
    + """SELECT paper_id, chunk_index, CAST(('0x' || substr(md5(paper_id || chr(1) || chunk_index || chr(1) || array_to_string(cw, ' ')), 1, 15)) AS BIGINT) AS id,
           CAST(length(array_to_string(cw, ' ')) AS DOUBLE) AS size FROM c""",
    ("docs",),
)
def rebuild_pairing(spark, d):
    """Half of the papers, chunked and embedded; then all: every chunk has its own vector."""
    old = stable_chunk_ids(chunk_papers(part_of_docs(spark, d, False), "fixed"))
    existing = vectors_of(old).unionByName(vectors_of(old.withColumn("id", -F.col("id"))))  # and some of chunks that are gone
    chunks = stable_chunk_ids(chunk_papers(part_of_docs(spark, d, True), "fixed"))
    kept, missing = pair_vectors(chunks, existing)
    paired = chunks.join(kept.unionByName(vectors_of(missing)).withColumnRenamed("chunk_id", "id"), "id")
    return paired.select("paper_id", "chunk_index", "id", F.get("embedding", F.lit(0)).alias("size"))


@query("author_rows", "SELECT paper_id, name, position FROM authors", ("authors",))
def author_rows(spark, d):
    lists = browse.author_lists(v.authors(spark, d)).withColumnRenamed("paper_id", "id")
    return store.author_rows(lists)


@query(
    "new_author_rows",
    """SELECT paper_id, name, position FROM authors WHERE position > 0
       OR paper_id IN (SELECT 'orders::' || o_orderkey FROM orders WHERE o_orderstatus <> 'F')""",
    ("authors",),
)
def new_author_rows(spark, d):
    rows = v.authors(spark, d)
    known = (
        v.table(spark, d, "orders")
        .filter("o_orderstatus = 'F'")
        .select(
            F.concat(F.lit("orders::"), F.col("o_orderkey").cast("string")).alias("paper_id"), F.lit(0).alias("position")
        )
    )
    return store.new_author_rows(known, rows.unionByName(rows))


@query(
    "update_full_text",
    """SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN 'new ' || d.doc_id ELSE d.text END AS full_text
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def update_full_text(spark, d):
    current = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("full_text"))
    text = F.when(F.col("quality") == 1, F.concat(F.lit("new "), F.col("doc_id").cast("string")))
    updates = v.table(spark, d, "labels").select(F.col("doc_id").alias("id"), text.alias("full_text"))
    return fulltext.update_full_text(current, updates)


@query(
    "missing_full_text",
    """SELECT page_id AS id, regexp_replace(url, '[.]html$', '.PDF') AS url FROM pages
       WHERE url LIKE '%.html' AND url NOT LIKE '%/en/%'""",
)
def missing_full_text(spark, d):
    url = F.regexp_replace("url", "[.]html$", ".PDF")
    text = F.when(F.col("url").contains("/en/"), "known").when(F.col("url").contains("/fr/"), "")
    rows = v.table(spark, d, "pages").select(F.col("page_id").alias("id"), url.alias("url"), text.alias("full_text"))
    return fulltext.missing_full_text(rows).select("id", "url")


WORK_SQL = """SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE {})"""


@query("work_list_retry", WORK_SQL.format("quality = 1"))
def work_list_retry(spark, d):
    return _work_list(spark, d, True)


@query("work_list_new", WORK_SQL.format("TRUE"))
def work_list_new(spark, d):
    return _work_list(spark, d, False)


def _work_list(spark, d, retry):
    todo = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    labels = v.table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    return fulltext.work_list(
        todo.unionByName(todo), labels.filter("quality = 1"), labels.filter("quality <> 1"), retry
    )


@query(
    "pages_full_text",
    r"""WITH t AS (SELECT page_id, array_to_string(list_transform(string_split(array_to_string(
            list_filter(string_split(html, '</p>'), lambda p: regexp_matches(p, '\S')), chr(10) || chr(10)), chr(10)),
            lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)) AS x FROM pages),
          c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'),
               '^\n+', ''), '\n\n$', chr(10)) AS y FROM t)
        SELECT page_id, CASE WHEN length(y) >= 500 THEN md5(y) END AS digest FROM c""",
)
def pages_full_text(spark, d):
    text = fulltext.text_of_pages(F.split("html", "</p>"))
    return v.table(spark, d, "pages").select("page_id", F.md5(text).alias("digest"))


XML_TEXT = r"[^\x09\x0A\x20-퟿-�]"


@query(
    "tei_full_text",
    r"""WITH t AS (SELECT doc_id, lang || chr(10) || chr(10) || chr(10) || source || chr(10) || chr(10) || chr(10) ||
            array_to_string(list_filter(list_transform(
            string_split(regexp_replace(text, '[^\x09\x0A\x20-\x{D7FF}\x{E000}-\x{FFFD}]', '', 'g'), chr(10)),
            lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10) || chr(10)) AS x
          FROM documents)
        SELECT doc_id, CASE WHEN length(x) > 200 THEN md5(x) END AS digest FROM t""",
)
def tei_full_text(spark, d):
    clean = F.regexp_replace("text", XML_TEXT, "")
    escaped = F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tei = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><profileDesc><abstract><p>'),
        "lang",
        F.lit("</p></abstract></profileDesc></teiHeader><text><body><div><head>"),
        "source",
        F.lit("</head><p>"),
        F.replace(escaped, F.lit("\n"), F.lit("</p><p>")),
        F.lit("</p></div></body></text></TEI>"),
    )
    return v.table(spark, d, "documents").select("doc_id", F.md5(fulltext.text_of_tei(tei)).alias("digest"))


@query(
    "chunks_with_papers",
    CHUNKS_SQL
    + """SELECT paper_id, chunk_index, 'Doc ' || doc_id AS title, lang AS venue
         FROM c JOIN docs ON docs.id = c.paper_id""",
    ("docs",),
)
def chunks_with_papers(spark, d):
    docs = v.docs(spark, d)
    meta = docs.select(
        "id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("venue"), F.lit(2000).alias("year")
    )
    joined = browse.chunks_with_papers(chunk_papers(docs, "fixed"), meta)
    return joined.select("paper_id", "chunk_index", "title", "venue")


def rate_sql(limit: int, seconds: int) -> str:
    """Requests of a client one after the other, carrying the admitted times."""
    w = seconds * 1_000_000
    return f"""WITH RECURSIVE
      e AS (SELECT user_id AS client, event_id AS request_id, epoch_us(ts) AS us,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      run AS (
        SELECT client, request_id, n, TRUE AS admitted, [us] AS log, NULL::BIGINT AS retry_after FROM e WHERE n = 1
        UNION ALL
        SELECT e.client, e.request_id, e.n, len(list_filter(log, lambda t: t > us - {w})) < {limit},
          CASE WHEN len(list_filter(log, lambda t: t > us - {w})) < {limit}
               THEN list_append(list_filter(log, lambda t: t > us - {w}), us)
               ELSE list_filter(log, lambda t: t > us - {w}) END,
          CASE WHEN len(list_filter(log, lambda t: t > us - {w})) >= {limit}
               THEN ({w} - (us - list_min(list_filter(log, lambda t: t > us - {w})))) // 1000000 + 1 END
        FROM run JOIN e ON e.client = run.client AND e.n = run.n + 1)
      SELECT client, request_id, admitted, retry_after FROM run"""


def requests(spark, d):
    return v.table(spark, d, "events").select(
        F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), "ts"
    )


@query("rate_limit_weekly", rate_sql(10, 7 * 86400))
def rate_limit_weekly(spark, d):
    return ratelimit.admissions(requests(spark, d), 10, 7 * 86400)


@query("rate_limit_hourly", rate_sql(1, 3600))
def rate_limit_hourly(spark, d):
    return ratelimit.admissions(requests(spark, d), 1, 3600)


@query("rate_limit_stream", rate_sql(1, 3600))
def rate_limit_stream(spark, d):
    """The same decisions from a stream over the table, with expiring state per client."""
    schema = v.table(spark, d, "events").schema
    # A pattern, because a stream takes a plain path for a folder.
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    asked = stream.select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), "ts")
    out, state = scratch_folder(spark, "admitted"), scratch_folder(spark, "admission-state")
    writer = admit_stream(asked, 1, 3600).writeStream.format("parquet").option("checkpointLocation", state)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)

"""BM25, vector search, fusion, hybrid search, answer context.

Benchmark passages are the queries; documents are the chunks.  The embedding with
the id of a passage or document stands for its vector.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import views as v
from quire.catalog.registry import query
from quire.operators import bm25, fusion, postings, vector_index, vectors
from quire.plans import answers
from quire.plans.search import SearchConfig, hybrid_search as fused_search, search
from quire.session import scratch_folder, spread


def chunks(spark, d):
    return v.table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("chunk_text"),
        F.col("source").alias("paper_id"),
        F.concat(F.lit("Collection "), "source").alias("title"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("venue"),
        (F.lit(2000) + F.col("doc_id") % 20).cast("int").alias("year"),
    )


def embeddings(spark, d):
    return v.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def questions(spark, d):
    vec = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return (
        v.table(spark, d, "benchmark")
        # A passage without a vector still has words.
        .join(vec, "item_id", "left")
        .select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "embedding")
    )


def index(spark, d):
    return bm25.build_index(chunks(spark, d))


BM25_CTES = r"""
  tok AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '\p{L}+') AS t FROM documents),
  tot AS (SELECT count(*) AS n, sum(len(t)) / count(*)::DOUBLE AS avgdl FROM tok),
  post AS (SELECT chunk_id, dl, term, count(*) AS tf
           FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
  voc AS (SELECT term, df, ln((SELECT n FROM tot) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw
          FROM (SELECT term, count(*) AS df FROM post GROUP BY term)),
  idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM voc) ELSE raw END AS idf FROM voc),
  qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (
           SELECT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM benchmark) GROUP BY ALL),
  bm AS (SELECT query_id, chunk_id, sum(CAST(floor(qtf * idf * (tf * 2.5::DOUBLE
              / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM tot)))) * 1e9 + 0.5) AS BIGINT))
              / 1e9 AS score
         FROM qt JOIN idf USING (term) JOIN post USING (term) GROUP BY ALL),
  bmr AS (SELECT query_id, chunk_id, score, row_number() OVER (
            PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE score > 0)"""

VEC_CTES = """
  vq AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
  vs AS (SELECT query_id, vec_id AS chunk_id, list_dot_product(q, e)
           / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(e, e))) AS score
         FROM vq, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
  vr AS (SELECT query_id, chunk_id, score, row_number() OVER (
            PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs)"""


def fused_ctes(name: str, bm25_weight: int, vector_weight: int, fetch: int, k: int) -> str:
    lists = []
    if bm25_weight:
        lists.append(f"SELECT query_id, chunk_id, rank, 0 AS l, {bm25_weight} AS w FROM bmr WHERE rank <= {fetch}")
    if vector_weight:
        lists.append(f"SELECT query_id, chunk_id, rank, 1 AS l, {vector_weight} AS w FROM vr WHERE rank <= {fetch}")
    return f"""
  {name}_f AS (SELECT query_id, chunk_id, sum(w / (60.0::DOUBLE + rank)) AS rrf_score, min(l * 1000000 + rank) AS seen
         FROM ({' UNION ALL '.join(lists)}) GROUP BY ALL),
  {name} AS (SELECT * FROM (SELECT query_id, chunk_id, rrf_score, row_number() OVER (
            PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, seen, chunk_id) AS rank FROM {name}_f) WHERE rank <= {k})"""


HYBRID_CTES = "WITH " + BM25_CTES + "," + VEC_CTES + "," + fused_ctes("hy", 1, 1, 150, 50)

RESULTS_CTES = (
    HYBRID_CTES
    + """,
  res AS (SELECT * FROM (SELECT query_id, chunk_id, rrf_score, row_number() OVER (
            PARTITION BY query_id ORDER BY rank) AS rank, source AS paper_id, text AS chunk_text,
            CASE WHEN lang <> 'es' THEN lang END AS venue, CAST(2000 + doc_id % 20 AS INTEGER) AS year,
            'Collection ' || source AS title
          FROM hy JOIN documents ON doc_id = chunk_id) WHERE rank <= 20)"""
)


# Each term counts once per document, so no term frequencies are needed here.
VOCABULARY_SQL = r"""
  WITH tok AS MATERIALIZED (SELECT list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS t FROM documents),
  voc AS MATERIALIZED (
    SELECT term, df, ln((SELECT count(*) FROM tok) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw
    FROM (SELECT term, count(*) AS df FROM (SELECT unnest(t) AS term FROM tok) GROUP BY term)),
  mean AS MATERIALIZED (SELECT avg(raw) AS raw FROM voc)
  SELECT term, df, round(CASE WHEN voc.raw < 0 THEN 0.25::DOUBLE * mean.raw ELSE voc.raw END, 6) AS idf FROM voc, mean"""


@query("bm25_vocabulary", VOCABULARY_SQL)
def bm25_vocabulary(spark, d):
    return index(spark, d).vocabulary.withColumn("idf", F.round("idf", 6))


@query(
    "bm25_totals", "WITH " + BM25_CTES + " SELECT n AS chunks, round(avgdl, 6) AS avg_length FROM tot"
)
def bm25_totals(spark, d):
    return index(spark, d).totals.withColumn("avg_length", F.round("avg_length", 6))


@query(
    "bm25_search",
    "WITH " + BM25_CTES + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 50",
)
def bm25_search(spark, d):
    queries = questions(spark, d).select("query_id", "query_text")
    return bm25.search(index(spark, d), queries, 50).withColumns(
        {"score": F.round("score", 6), "rank": F.col("rank").cast("long")}
    )


@query(
    "bm25_written_search",
    "WITH " + BM25_CTES + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 20",
)
def bm25_written_search(spark, d):
    """Write the index, read it back and search it; the scan is cut to the terms of the queries."""
    path = scratch_folder(spark, "bm25")
    bm25.write_index(index(spark, d), path, version=d)
    found = bm25.search(bm25.read_index(spark, path, version=d), questions(spark, d).select("query_id", "query_text"), 20)
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


def written_blocks(spark, d):
    path = scratch_folder(spark, "blocks")
    postings.write_blocks(chunks(spark, d), path, columns=("venue", "year"), version=d)
    return postings.read_blocks(spark, path, version=d)


@query(
    "bm25_block_search",
    "WITH " + BM25_CTES + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 20",
)
def bm25_block_search(spark, d):
    """Write the index in blocks, read it back and search it with early stop."""
    found = postings.search(written_blocks(spark, d), questions(spark, d).select("query_id", "query_text"), 20)
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(
    "bm25_block_filtered",
    "WITH "
    + BM25_CTES.replace(
        "FROM bm WHERE score > 0", "FROM bm JOIN documents ON doc_id = chunk_id WHERE score > 0 AND lang = 'en' AND 2000 + doc_id % 20 >= 2005"
    )
    + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10",
)
def bm25_block_filtered(spark, d):
    where = vectors.search_filter("en", 2005)
    found = postings.search(written_blocks(spark, d), questions(spark, d).select("query_id", "query_text"), 10, where)
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query("bm25_block_vocabulary", VOCABULARY_SQL)
def bm25_block_vocabulary(spark, d):
    return written_blocks(spark, d).vocabulary.withColumn("idf", F.round("idf", 6))


@query(
    "vector_search",
    "WITH " + VEC_CTES + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vr WHERE rank <= 50",
)
def vector_search(spark, d):
    found = vectors.search(embeddings(spark, d), questions(spark, d), 50)
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(
    "vector_search_filtered",
    "WITH "
    + VEC_CTES.replace("FROM embeddings))", "FROM embeddings WHERE label >= 2 AND label <= 6 AND label <> 4))")
    + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vr WHERE rank <= 20",
)
def vector_search_filtered(spark, d):
    where = {"$and": [{"label": {"$gte": 2}}, {"label": {"$lte": 6}}, {"label": {"$ne": 4}}]}
    found = vectors.search(embeddings(spark, d), questions(spark, d), 20, where)
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


def written_vector_index(spark, d):
    path = scratch_folder(spark, "vectors")
    vector_index.write_index(embeddings(spark, d), path, columns=("label",), version=d)
    return vector_index.read_index(spark, path, version=d)


@query(
    "vector_index_all_cells",
    "WITH " + VEC_CTES + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vr WHERE rank <= 50",
)
def vector_index_all_cells(spark, d):
    """Codes of all cells, then the exact cosines of what the bounds leave: the rows of the exact search."""
    index = written_vector_index(spark, d)
    found = vector_index.search(index, embeddings(spark, d), questions(spark, d), 50, probes=index.cells)
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(
    "vector_index_filtered",
    "WITH "
    + VEC_CTES.replace("FROM embeddings))", "FROM embeddings WHERE label >= 2 AND label <= 6 AND label <> 4))")
    + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vr WHERE rank <= 20",
)
def vector_index_filtered(spark, d):
    index = written_vector_index(spark, d)
    where = {"$and": [{"label": {"$gte": 2}}, {"label": {"$lte": 6}}, {"label": {"$ne": 4}}]}
    found = vector_index.search(index, embeddings(spark, d), questions(spark, d), 20, probes=index.cells, where=where)
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(
    "vector_index_recall",
    "WITH " + VEC_CTES + " SELECT count(DISTINCT query_id) AS queries, TRUE AS recall_at_10_is_090 FROM vr",
)
def vector_index_recall(spark, d):
    """The probed cells against the exact search over the whole table."""
    asked = questions(spark, d)
    found = vector_index.search(written_vector_index(spark, d), embeddings(spark, d), asked, 10)
    each = vector_index.recall(found, vectors.search(embeddings(spark, d), asked, 10), 10)
    return each.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("recall_at_10_is_090"))


def _fused(frame):
    return frame.select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), F.col("rank").cast("long"))


@query(
    "rrf_fusion", HYBRID_CTES + " SELECT query_id, chunk_id, round(rrf_score, 6) AS rrf_score, rank FROM hy"
)
def rrf_fusion(spark, d):
    return _fused(fused_search(index(spark, d), embeddings(spark, d), questions(spark, d)))


@query(
    "weighted_rrf",
    "WITH " + BM25_CTES + "," + VEC_CTES + "," + fused_ctes("hy", 3, 1, 60, 20)
    + " SELECT query_id, chunk_id, round(rrf_score, 6) AS rrf_score, rank FROM hy",
)
def weighted_rrf(spark, d):
    config = SearchConfig(bm25_weight=3, hybrid_top_k=20)
    return _fused(fused_search(index(spark, d), embeddings(spark, d), questions(spark, d), config))


@query(
    "vector_only_rrf",
    "WITH " + VEC_CTES + "," + fused_ctes("hy", 0, 1, 150, 50)
    + " SELECT query_id, chunk_id, round(rrf_score, 6) AS rrf_score, rank FROM hy",
)
def vector_only_rrf(spark, d):
    config = SearchConfig(bm25_weight=0)
    return _fused(fused_search(index(spark, d), embeddings(spark, d), questions(spark, d), config))


def results(spark, d, scorer=None):
    return search(index(spark, d), embeddings(spark, d), chunks(spark, d), questions(spark, d), scorer=scorer)


@query(
    "hybrid_search",
    RESULTS_CTES
    + """ SELECT query_id, chunk_id, paper_id, title, venue, year, round(rrf_score, 6) AS rrf_score, rank,
          length(chunk_text) AS chars FROM res""",
)
def hybrid_search(spark, d):
    return results(spark, d).select(
        "query_id",
        "chunk_id",
        "paper_id",
        "title",
        "venue",
        "year",
        F.round("rrf_score", 6).alias("rrf_score"),
        F.col("rank").cast("long"),
        F.length("chunk_text").cast("long").alias("chars"),
    )


RERANK_CTES = (
    HYBRID_CTES
    + r""",
  cand AS (SELECT hy.*, source AS paper_id, d.text AS chunk_text,
             list_distinct(regexp_extract_all(lower(b.text), '\p{L}+')) AS q,
             regexp_extract_all(lower(d.text), '\p{L}+') AS t
           FROM hy JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id),
  rr AS (SELECT * FROM (SELECT query_id, chunk_id, paper_id, ce_score, row_number() OVER (
           PARTITION BY query_id ORDER BY ce_score DESC, rank) AS rank
         FROM (SELECT *, len(list_intersect(q, t)) / len(q)::DOUBLE AS ce_score FROM cand)) WHERE rank <= 20)"""
)


@query(
    "reranked_search",
    RERANK_CTES + " SELECT query_id, chunk_id, paper_id, round(ce_score, 6) AS ce_score, rank FROM rr",
)
def reranked_search(spark, d):
    return results(spark, d, fusion.term_overlap).select(
        "query_id", "chunk_id", "paper_id", F.round("ce_score", 6).alias("ce_score"), F.col("rank").cast("long")
    )


@query(
    "rag_sources",
    RESULTS_CTES
    + """ SELECT query_id, paper_id, title, CAST(rank AS BIGINT) AS rank, used AS used_in_answer FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS n,
                   bool_or(rank <= 5) OVER (PARTITION BY query_id, paper_id) AS used FROM res) WHERE n = 1""",
)
def rag_sources(spark, d):
    found = fusion.sources(results(spark, d))
    return found.select("query_id", "paper_id", "title", F.col("rank").cast("long"), "used_in_answer")


@query(
    "rag_sources_cited",
    RESULTS_CTES + " SELECT DISTINCT query_id, paper_id FROM res WHERE rank <= 5",
)
def rag_sources_cited(spark, d):
    return fusion.cited(fusion.sources(results(spark, d))).select("query_id", "paper_id")


@query(
    "rag_sources_also_relevant",
    RESULTS_CTES
    + """ SELECT DISTINCT query_id, paper_id FROM res r WHERE NOT EXISTS (
            SELECT 1 FROM res s WHERE s.query_id = r.query_id AND s.paper_id = r.paper_id AND s.rank <= 5)""",
)
def rag_sources_also_relevant(spark, d):
    return fusion.also_relevant(fusion.sources(results(spark, d))).select("query_id", "paper_id")


@query(
    "rag_prompt",
    RESULTS_CTES
    + """, ctx AS (SELECT query_id, string_agg('[' || rank || '] "' || title || '" (' || coalesce(venue, 'unknown venue')
             || ', ' || year || ')' || chr(10) || chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10)
             ORDER BY rank) AS c FROM res WHERE rank <= 5 GROUP BY query_id)
         SELECT item_id AS query_id, length(c) AS context_chars,
           md5('Below are excerpts from relevant research papers.' || chr(10) || chr(10)
           || coalesce(c, 'No relevant papers found.') || chr(10) || chr(10) || '---' || chr(10) || chr(10)
           || 'Based on the above excerpts, answer the following question. '
           || 'Cite papers by their number (e.g., [1], [2]) when referencing specific findings.'
           || chr(10) || chr(10) || 'Question: ' || text) AS prompt_digest
         FROM benchmark LEFT JOIN ctx ON query_id = item_id""",
)
def rag_prompt(spark, d):
    asked = answers.context_blocks(results(spark, d), questions(spark, d))
    return asked.select(
        "query_id",
        F.length("context").cast("long").alias("context_chars"),
        F.md5(answers.prompt(F.col("query_text"), F.col("context"))).alias("prompt_digest"),
    )


@query("vector_lookup", "SELECT vec_id AS chunk_id, label FROM embeddings WHERE label = 3")
def vector_lookup(spark, d):
    """The label stands for the paper of a vector."""
    table = embeddings(spark, d).withColumn("paper_id", F.col("label").cast("string"))
    return vectors.vectors_of_paper(table, "3").select("chunk_id", "label")


@query(
    "normalized_vectors",
    """SELECT vec_id AS chunk_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 4) AS total
       FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id + 1)) AS e FROM embeddings)""",
)
def normalized_vectors(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("chunk_id") + 1))
    total = F.aggregate(vectors.normalize(scaled), F.lit(0.0), lambda acc, x: acc + x)
    return embeddings(spark, d).select("chunk_id", F.round(total, 4).alias("total"))


@query(
    "chunk_id_forms",
    """SELECT doc_id, source || '::' || doc_id || '_chunk_0' AS made_up, CAST(doc_id AS VARCHAR) AS given,
         CASE WHEN lang <> 'fr' THEN doc_id END AS parsed FROM documents""",
)
def chunk_id_forms(spark, d):
    from quire.functions.ids import fallback_chunk_id, paper_id, parse_chunk_id

    doc_id = F.col("doc_id")
    pid, index_ = paper_id(F.col("source"), doc_id.cast("string")), F.lit(0)
    raw = F.when(F.col("lang") == "fr", F.concat(F.lit("x"), doc_id.cast("string"))).otherwise(doc_id.cast("string"))
    return v.table(spark, d, "documents").select(
        "doc_id",
        fallback_chunk_id(F.lit(None), pid, index_).alias("made_up"),
        fallback_chunk_id(doc_id, pid, index_).alias("given"),
        parse_chunk_id(raw).alias("parsed"),
    )


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts):
    """Encoder without a model: how often each letter occurs."""
    import numpy as np

    return np.array([[t.lower().count(c) for c in LETTERS] for t in texts], dtype="float64")


@query(
    "encoded_search",
    f"""WITH letters AS (SELECT string_split('{LETTERS}', '') AS ls),
      enc AS (SELECT doc_id, list_transform(ls, lambda c: (length(t) - length(replace(t, c, '')))::DOUBLE) AS e
              FROM (SELECT doc_id, lower(text) AS t, ls FROM documents, letters)),
      ask AS (SELECT item_id, list_transform(ls, lambda c: (length(t) - length(replace(t, c, '')))::DOUBLE) AS q
              FROM (SELECT item_id, lower(text) AS t, ls FROM benchmark, letters)),
      s AS (SELECT item_id AS query_id, round(list_cosine_similarity(q, e), 4) AS score FROM ask, enc
            WHERE list_sum(e) > 0)
      SELECT query_id, score, rank FROM (
        SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM s)
      WHERE rank <= 20""",
)
def encoded_search(spark, d):
    """Single-precision vectors decide near ties differently, so scores are compared by rank."""
    texts = spread(chunks(spark, d).select("chunk_id", "chunk_text"))
    corpus = vectors.encode(texts, "chunk_text", letter_counts)
    asked = v.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = vectors.search(corpus, vectors.encode(asked, "text", letter_counts), 20)
    return found.select("query_id", F.round("score", 4).alias("score"), F.col("rank").cast("long"))


class LengthBackend:
    """Stands for a language model: answers with the length of its prompt, fails on some."""

    name = "length"

    def is_available(self):
        return True

    def generate(self, prompt, system_prompt=None, max_tokens=1024, temperature=0.1):
        if len(prompt) % 7 == 0:
            raise RuntimeError("no answer")
        return answers.Generation(str(len(prompt)), self.name)


@query(
    "generated_answers",
    RESULTS_CTES
    + """, ctx AS (SELECT query_id, sum(length('[' || rank || '] "' || title || '" (' || coalesce(venue, 'unknown venue')
             || ', ' || year || ')' || chr(10) || chunk_text)) + (count(*) - 1) * 7 AS n FROM res WHERE rank <= 5 GROUP BY query_id),
           p AS (SELECT query_id, CAST(n AS BIGINT) + 51 + 7 + 140 + 12 + length(text) AS n FROM ctx JOIN benchmark ON item_id = query_id)
         SELECT query_id, CASE WHEN n % 7 = 0 THEN 'unavailable' ELSE CAST(n AS VARCHAR) END AS answer,
           CASE WHEN n % 7 = 0 THEN 'none (generation failed)' ELSE 'length' END AS model FROM p""",
)
def generated_answers(spark, d):
    replies, _ = answers.answer(results(spark, d), questions(spark, d), LengthBackend())
    answer = F.when(F.col("answer") == answers.UNAVAILABLE_ANSWER, "unavailable").otherwise(F.col("answer"))
    return replies.select("query_id", answer.alias("answer"), "model")


FILTERED = "(SELECT doc_id FROM documents WHERE lang = 'en' AND 2000 + doc_id % 20 BETWEEN 2003 AND 2012)"


def filtered_sql(filter_sparse: bool) -> str:
    """Fused lists whose vector list, and with ``filter_sparse`` also the other, obeys the filter."""
    lexical = BM25_CTES.replace("FROM bm WHERE score > 0", f"FROM bm WHERE score > 0 AND chunk_id IN {FILTERED}") if filter_sparse else BM25_CTES
    dense = VEC_CTES.replace("e FROM embeddings))", f"e FROM embeddings WHERE vec_id IN {FILTERED}))")
    return "WITH " + lexical + "," + dense + "," + fused_ctes("hy", 1, 1, 60, 20) + " SELECT query_id, chunk_id, round(rrf_score, 9) AS rrf_score, rank FROM hy"


def filtered(spark, d, filter_sparse):
    where = vectors.search_filter("en", 2003, 2012)
    meta = chunks(spark, d).select("chunk_id", "venue", "year")
    corpus = embeddings(spark, d).join(meta, "chunk_id")
    config = SearchConfig(hybrid_top_k=20, filter_sparse=filter_sparse)
    found = fused_search(index(spark, d), corpus, questions(spark, d), config, where, meta)
    return found.select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.col("rank").cast("long").alias("rank"))


@query("hybrid_search_filtered", filtered_sql(True))
def hybrid_search_filtered(spark, d):
    return filtered(spark, d, True)


@query("hybrid_search_filtered_dense", filtered_sql(False))
def hybrid_search_filtered_dense(spark, d):
    return filtered(spark, d, False)

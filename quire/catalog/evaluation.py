"""Metrics, pools, offline evaluation and ablation.

A document is relevant to a benchmark passage when it contains the passage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import views as v
from quire.catalog.registry import query
from quire.catalog.retrieval import (
    BM25_CTES,
    HYBRID_CTES,
    RESULTS_CTES,
    VEC_CTES,
    chunks,
    embeddings,
    fused_ctes,
    index,
    questions,
    results,
)
from quire.functions.text import words
from quire.operators import bm25, metrics, pooling, vectors
from quire.plans import evaluation
from quire.session import spread
from quire.plans.search import SearchConfig, hybrid_search as fused_search

K_VALUES = metrics.K_VALUES


SHORT_BYTES = 1 << 20  # of short passages that a task holds at a time


def _short_passages(documents, passages):
    """(item_id, doc_id) of passages of one or two words, in blocks of bounded bytes; only finds become rows."""
    short = passages.filter(F.size(words(F.col("passage"))) < 3)
    size = short.agg(F.coalesce(F.sum(F.octet_length("passage") + 32), F.lit(0))).first()[0]
    blocks = -(-size // SHORT_BYTES)
    out = documents.select(F.lit(None).cast(passages.schema["item_id"].dataType).alias("item_id"), "doc_id").limit(0)
    for k in range(blocks):
        own = short.filter(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == k)
        held = documents.select("doc_id", "text", own.agg(F.collect_list(F.struct("item_id", "passage"))).scalar().alias("held"))
        within = F.filter("held", lambda p: F.contains(F.col("text"), p["passage"]))
        out = out.unionByName(held.select(F.explode(within).alias("p"), "doc_id").select("p.item_id", "doc_id"))
    return out


def relevant(spark, d):
    """(query_id, item_id) of documents that contain a passage.

    The rarest inner word of a passage leads to its few candidates by an
    equi-join; only those are compared as texts.  Passages of one or two words have no
    inner word; they are looked for in every text, in one pass for each block of them.
    """
    documents = spread(v.table(spark, d, "documents").select("doc_id", "text"))
    passages = v.table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    tokens = words(F.col("passage"))
    inner = F.array_distinct(F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0))))
    wanted = passages.select("item_id", F.explode(inner).alias("word"))
    present = documents.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(
        wanted.select("word").distinct(), "word", "left_semi"
    )
    frequency = present.groupBy("word").agg(F.count("*").alias("df"))
    anchors = (
        wanted.join(frequency, "word")
        .groupBy("item_id")
        .agg(F.min(F.struct("df", "word")).alias("rarest"))
        .select("item_id", "rarest.word")
    )
    pairs = present.join(anchors, "word").select("doc_id", "item_id")
    compared = pairs.join(documents, "doc_id").join(passages, "item_id")
    found = compared.filter(F.contains("text", "passage")).select("item_id", "doc_id")
    return found.unionByName(_short_passages(documents, passages)).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("item_id"))



REL_CTE = """rel AS (SELECT b.item_id AS query_id, d.doc_id AS item_id FROM benchmark b, documents d
                      WHERE contains(d.text, b.text))"""


@query("relevant_documents", "WITH " + REL_CTE + " SELECT query_id, item_id FROM rel")
def relevant_documents(spark, d):
    return relevant(spark, d)


def metric_sql(asked: str, ranked: str, rel: str, keys: str, hit_rate: bool = False) -> str:
    """Metrics spelled out per query: ``asked`` (keys), ``ranked`` (keys, item_id, rank), ``rel``."""
    using = keys
    parts = []
    for k in K_VALUES:
        ideal = f"list_sum(list_transform(range(1, least({k}, n) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE)))"
        parts += [
            f'count(*) FILTER (hit AND rank <= {k}) / {k}.0::DOUBLE AS "precision@{k}"',
            f'coalesce(count(*) FILTER (hit AND rank <= {k}) / any_value(n)::DOUBLE, 0) AS "recall@{k}"',
            f"coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (hit AND rank <= {k}) / any_value({ideal}), 0) "
            f'AS "ndcg@{k}"',
        ]
        if hit_rate:
            parts.append(f'CASE WHEN count(*) FILTER (hit AND rank <= {k}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS "hit_rate@{k}"')
    return f"""SELECT {keys}, coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0) AS mrr, {', '.join(parts)}
      FROM (SELECT a.*, r.item_id, r.rank, n, x.item_id IS NOT NULL AS hit
            FROM {asked} a LEFT JOIN {ranked} r USING ({using})
            LEFT JOIN (SELECT query_id, count(DISTINCT item_id) AS n FROM {rel} GROUP BY query_id) t USING (query_id)
            LEFT JOIN (SELECT DISTINCT query_id, item_id FROM {rel}) x USING (query_id, item_id))
      GROUP BY {keys}"""


def rounded_sql(names: list[str]) -> str:
    return ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)


def average_sql(names: list[str]) -> str:
    return ", ".join(f'round(avg("{n}"), 6) AS "{n}"' for n in names)


def rounded(df, names):
    return df.withColumns({n: F.round(f"`{n}`", 6) for n in names})


NAMES = metrics.metric_names()
NAMES_HIT = metrics.metric_names(hit_rate=True)


def bm25_list(spark, d, k):
    return bm25.search(index(spark, d), questions(spark, d).select("query_id", "query_text"), k)


IR_CTES = (
    "WITH "
    + BM25_CTES
    + ", "
    + REL_CTE
    + """, asked AS (SELECT item_id AS query_id FROM benchmark),
         ranked AS (SELECT query_id, chunk_id AS item_id, rank FROM bmr WHERE rank <= 10)"""
)


def ir_scores(spark, d):
    ranked = bm25_list(spark, d, 10).withColumnRenamed("chunk_id", "item_id")
    return metrics.retrieval_metrics(questions(spark, d), ranked, relevant(spark, d), hit_rate=True)


@query(
    "ir_metrics",
    IR_CTES + f" SELECT query_id, {rounded_sql(NAMES_HIT)} FROM ({metric_sql('asked', 'ranked', 'rel', 'query_id', True)})",
)
def ir_metrics(spark, d):
    return rounded(ir_scores(spark, d), NAMES_HIT)


@query(
    "macro_average",
    IR_CTES + f" SELECT count(*) AS n, {average_sql(NAMES_HIT)} FROM ({metric_sql('asked', 'ranked', 'rel', 'query_id', True)})",
)
def macro_average(spark, d):
    return rounded(metrics.macro_average(ir_scores(spark, d), NAMES_HIT), NAMES_HIT)


def pools(spark, d):
    """Top 10 of each ranker; the hybrid list fuses 30 candidates of each."""
    asked = questions(spark, d)
    hybrid = fused_search(index(spark, d), embeddings(spark, d), asked, SearchConfig(hybrid_top_k=10))
    return [
        ("bm25", bm25_list(spark, d, 10)),
        ("vector", vectors.search(embeddings(spark, d), asked, 10)),
        ("hybrid", hybrid),
    ]


POOL_CTES = (
    "WITH "
    + BM25_CTES
    + ","
    + VEC_CTES
    + ","
    + fused_ctes("hy", 1, 1, 30, 10)
    + """, lists AS (
         SELECT query_id, chunk_id, rank, 0 AS l, 'bm25' AS method FROM bmr WHERE rank <= 10
         UNION ALL SELECT query_id, chunk_id, rank, 1, 'vector' FROM vr WHERE rank <= 10
         UNION ALL SELECT query_id, chunk_id, rank, 2, 'hybrid' FROM hy)"""
)


@query(
    "pooled_candidates",
    POOL_CTES
    + """ SELECT query_id, chunk_id, methods, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS position
          FROM (SELECT query_id, chunk_id, min(l * 100 + rank) AS seen, string_agg(method, ',' ORDER BY l) AS methods
                FROM lists GROUP BY query_id, chunk_id)""",
)
def pooled_candidates(spark, d):
    return pooling.pool(pools(spark, d)).withColumns(
        {"methods": F.array_join("methods", ","), "position": F.col("position").cast("long")}
    )


def eval_set(spark, d):
    """Evaluation set as the JSON source would give it."""
    judged = relevant(spark, d).groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("relevant_chunk_ids")
    )
    return (
        pooling.pooled_ids(pools(spark, d))
        .join(judged, "query_id", "left")
        .withColumnRenamed("query_id", "id")
        .withColumn("relevant_chunk_ids", F.coalesce("relevant_chunk_ids", F.array().cast("array<string>")))
    )


@query(
    "pool_evaluation",
    POOL_CTES
    + ", "
    + REL_CTE
    + f""", asked AS (SELECT DISTINCT query_id, method FROM rel, (VALUES ('bm25'), ('vector'), ('hybrid')) m(method)),
         ranked AS (SELECT query_id, method, chunk_id AS item_id, rank FROM lists)
         SELECT method, count(*) AS n, {average_sql(NAMES_HIT)}
         FROM ({metric_sql('asked', 'ranked', 'rel', 'query_id, method', True)}) GROUP BY method""",
)
def pool_evaluation(spark, d):
    return rounded(evaluation.evaluate_pools(eval_set(spark, d)), NAMES_HIT)


@query(
    "relevant_papers",
    "WITH "
    + REL_CTE
    + """ SELECT query_id, source AS paper_id, row_number() OVER (PARTITION BY query_id ORDER BY min(doc_id), source)
            AS position
          FROM rel JOIN documents ON doc_id = item_id GROUP BY query_id, source""",
)
def relevant_papers(spark, d):
    judged = relevant(spark, d).select("query_id", F.col("item_id").alias("chunk_id"), F.col("item_id").alias("position"))
    return pooling.relevant_papers(judged, chunks(spark, d)).withColumn("position", F.col("position").cast("long"))


def paper_relevance(spark, d):
    sources = v.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source")
    found = relevant(spark, d).join(sources, "item_id")
    return found.select("query_id", F.col("source").alias("item_id")).distinct()


PAPER_REL = "prel AS (SELECT DISTINCT query_id, source AS item_id FROM rel JOIN documents ON doc_id = rel.item_id)"


def ablation_sql() -> str:
    """All six configurations, written out one by one."""
    ctes, picks = [], []
    for a in evaluation.DEFAULT_ABLATIONS:
        c, name = a.config, a.name
        ctes.append(fused_ctes(name, c.bm25_weight, c.vector_weight, 150, 50))
        order = "ce_score DESC, rank" if c.use_reranker else "rank"
        picks.append(
            f"""SELECT '{name}' AS config, query_id, paper_id AS item_id, rank FROM (
                  SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank
                  FROM {name} JOIN ce USING (query_id, chunk_id)) WHERE rank <= 5"""
        )
    return (
        "WITH "
        + BM25_CTES
        + ","
        + VEC_CTES
        + ", "
        + REL_CTE
        + ", "
        + PAPER_REL
        + ","
        + ",".join(ctes)
        + r""",
      used AS (SELECT DISTINCT query_id, chunk_id FROM ("""
        + " UNION ALL ".join(f"SELECT query_id, chunk_id FROM {a.name}" for a in evaluation.DEFAULT_ABLATIONS)
        + r""")),
      ce AS (SELECT query_id, chunk_id, source AS paper_id, len(list_intersect(q, t)) / len(q)::DOUBLE AS ce_score FROM (
           SELECT u.query_id, u.chunk_id, d.source, list_distinct(regexp_extract_all(lower(b.text), '\p{L}+')) AS q,
                  regexp_extract_all(lower(d.text), '\p{L}+') AS t
           FROM used u JOIN documents d ON d.doc_id = u.chunk_id JOIN benchmark b ON b.item_id = u.query_id)),
      picked AS ("""
        + " UNION ALL ".join(picks)
        + """),
      ranked AS (SELECT config, query_id, item_id, row_number() OVER (PARTITION BY config, query_id ORDER BY min(rank)) AS rank
                 FROM picked GROUP BY config, query_id, item_id),
      asked AS (SELECT query_id, config FROM vq, (SELECT DISTINCT config FROM picked))
      """
        + f"""SELECT config, count(*) AS n, {average_sql(NAMES)}
              FROM ({metric_sql('asked', 'ranked', 'prel', 'config, query_id')}) GROUP BY config"""
    )


@query("ablation_summary", ablation_sql())
def ablation_summary(spark, d):
    asked = questions(spark, d)
    found = evaluation.ablation_results(index(spark, d), embeddings(spark, d), chunks(spark, d), asked)
    summary = evaluation.ablation_summary(found, asked, paper_relevance(spark, d))
    return rounded(summary.drop("description"), NAMES)


def turns(spark, d):
    """Assistant turns with the user turn before them."""
    table = v.table(spark, d, "conversations")
    asked = table.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    replies = table.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"))
    long_words = F.filter(words(F.col("reference")), lambda w: F.length(w) > 6)
    return replies.join(asked, ["conv_id", "turn"]).withColumn("keywords", F.array_distinct(long_words))


TURN_CTES = r"""
  pairs AS (SELECT a.conv_id, a.turn, a.text AS prediction, u.text AS reference,
              list_distinct(list_filter(string_split_regex(u.text, '\s+'), lambda w: length(w) > 6)) AS keywords
            FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
            WHERE a.role = 'assistant' AND u.role = 'user')"""

ROUGE_CTES = (
    TURN_CTES
    + r""",
  tok AS (SELECT conv_id, turn, keywords, prediction, regexp_extract_all(lower(prediction), '[\p{L}\p{N}_]+') AS a,
                 regexp_extract_all(lower(reference), '[\p{L}\p{N}_]+') AS b FROM pairs),
  aw AS (SELECT conv_id, turn, unnest(a) AS word, generate_subscripts(a, 1) AS j FROM tok WHERE len(b) > 0),
  dp AS (
    SELECT 0 AS i, conv_id, turn, j, 0 AS best FROM aw
    UNION ALL
    SELECT i + 1, conv_id, turn, j, max(c) OVER (PARTITION BY conv_id, turn ORDER BY j) FROM (
      SELECT i, conv_id, turn, j, CASE WHEN word = b[i + 1]
        THEN coalesce(lag(best) OVER (PARTITION BY conv_id, turn ORDER BY j), 0) + 1 ELSE best END AS c
      FROM dp JOIN aw USING (conv_id, turn, j) JOIN tok USING (conv_id, turn) WHERE i < len(b))),
  lcs AS (SELECT conv_id, turn, best FROM dp JOIN tok USING (conv_id, turn) WHERE i = len(b) AND j = len(a)),
  gen AS (SELECT conv_id, turn, CASE WHEN best > 0 THEN 2 * (best / len(a)::DOUBLE) * (best / len(b)::DOUBLE)
            / (best / len(a)::DOUBLE + best / len(b)::DOUBLE) ELSE 0 END AS rouge_l_f1,
          CASE WHEN len(keywords) > 0 THEN len(list_filter(keywords, lambda k: contains(lower(prediction), lower(k))))
               / len(keywords)::DOUBLE END AS answer_coverage
          FROM tok LEFT JOIN lcs USING (conv_id, turn))"""
)


@query(
    "rouge_l",
    "WITH RECURSIVE " + ROUGE_CTES + " SELECT conv_id, turn, round(rouge_l_f1 + 1e-9, 6) AS rouge_l_f1 FROM gen",
)
def rouge_l(spark, d):
    score = metrics.rouge_l_f1("prediction", "reference")
    return turns(spark, d).select("conv_id", "turn", F.round(score + 1e-9, 6).alias("rouge_l_f1"))


@query(
    "answer_coverage",
    "WITH "
    + TURN_CTES
    + """ SELECT conv_id, turn, round(coalesce(CASE WHEN len(keywords) > 0 THEN
            len(list_filter(keywords, lambda k: contains(lower(prediction), lower(k)))) / len(keywords)::DOUBLE END, 0), 6)
            AS answer_coverage FROM pairs""",
)
def answer_coverage(spark, d):
    covered = metrics.answer_coverage(F.col("prediction"), F.col("keywords"))
    return turns(spark, d).select("conv_id", "turn", F.round(covered, 6).alias("answer_coverage"))


@query(
    "generation_report",
    "WITH RECURSIVE "
    + ROUGE_CTES
    + """ SELECT count(*) AS n, round(avg(rouge_l_f1), 6) AS rouge_l_f1,
            round(avg(coalesce(answer_coverage, 0)), 6) AS answer_coverage FROM gen""",
)
def generation_report(spark, d):
    scores = metrics.generation_metrics(turns(spark, d))
    names = ["rouge_l_f1", "answer_coverage"]
    return rounded(metrics.macro_average(scores, names, missing="zero"), names)


@query(
    "evaluation_report",
    RESULTS_CTES
    + ", "
    + REL_CTE
    + ", "
    + PAPER_REL
    + f""", asked AS (SELECT query_id FROM vq),
        ranked AS (SELECT query_id, paper_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank
                   FROM res GROUP BY query_id, paper_id),
        top AS (SELECT query_id, chunk_text FROM res WHERE rank = 1),
        cov AS (SELECT item_id AS query_id, CASE WHEN len(kw) > 0 THEN
                  len(list_filter(kw, lambda k: contains(lower(coalesce(chunk_text, '')), lower(k)))) / len(kw)::DOUBLE
                  ELSE 0 END AS c
                FROM (SELECT item_id, list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 6)) AS kw
                      FROM benchmark) LEFT JOIN top ON query_id = item_id)
        SELECT count(*) AS n, {average_sql(NAMES)}, (SELECT round(avg(c), 6) FROM cov) AS answer_coverage
        FROM ({metric_sql('asked', 'ranked', 'prel', 'query_id')})""",
)
def evaluation_report(spark, d):
    """The best chunk stands for the generated answer."""
    found = results(spark, d)
    asked = questions(spark, d)
    judged = paper_relevance(spark, d).groupBy("query_id").agg(F.collect_set("item_id").alias("relevant_paper_ids"))
    examples = asked.join(judged, "query_id", "left").select(
        "query_id",
        F.coalesce("relevant_paper_ids", F.array().cast("array<string>")).alias("relevant_paper_ids"),
        F.col("query_text").alias("reference_answer"),
        F.array_distinct(F.filter(words(F.col("query_text")), lambda w: F.length(w) > 6)).alias("keywords"),
    )
    best = found.filter("rank = 1").select("query_id", F.col("chunk_text").alias("answer"))
    per_example = evaluation.evaluate(examples, found.select("query_id", "paper_id", "rank"), best)
    report = evaluation.report(per_example).drop("rouge_l_f1")
    return rounded(report, [*NAMES, "answer_coverage"])


@query(
    "generation_scores",
    """SELECT count(*) AS n, round(avg(CASE WHEN value > 20 THEN 1 ELSE 0 END), 6) AS faithfulness,
         round(avg(user_id % 5 + 1), 6) AS relevance,
         round(avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 6) AS citation_accuracy FROM events""",
)
def generation_scores(spark, d):
    scores = v.table(spark, d, "events").select(
        (F.col("value") > 20).alias("faithfulness"),
        (F.col("user_id") % 5 + 1).alias("relevance"),
        (F.col("event_type") == "click").alias("citation_accuracy"),
    )
    return rounded(metrics.score_summary(scores), ["faithfulness", "relevance", "citation_accuracy"])


@query(
    "eval_set_upsert",
    """SELECT doc_id AS id, quality, toxic FROM labels WHERE toxic = 0
       UNION ALL SELECT doc_id, 9, toxic FROM labels WHERE toxic = 1
       UNION ALL SELECT doc_id, 9, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def eval_set_upsert(spark, d):
    existing = v.table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    nine = F.lit(9).alias("quality")
    changed = existing.filter("toxic = 1").select("id", nine, "toxic")
    added = (
        v.table(spark, d, "documents")
        .select(F.col("doc_id").alias("id"))
        .join(existing, "id", "left_anti")
        .select("id", nine, F.lit(0).alias("toxic"))
    )
    return pooling.upsert(existing, changed.unionByName(added))


@query(
    "next_question_id",
    "SELECT printf('q%03d', max(item_id) + 1) AS next_id FROM benchmark",
)
def next_question_id(spark, d):
    item = F.col("item_id").cast("string")
    names = F.explode(F.array(F.concat(F.lit("q"), F.lpad(item, 3, "0")), F.concat(F.lit("qx9"), item), item))
    return pooling.next_question_id(v.table(spark, d, "benchmark").select(names.alias("id")))

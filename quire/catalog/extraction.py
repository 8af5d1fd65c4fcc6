"""Gazetteer extraction, model output, merging, incremental enrichment.

The texts hold invented words, so the lexicon is made of their own words: the
most frequent ones of at least five characters that occur in at most 6 % of the
documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import views as v
from quire.catalog.registry import query
from quire.functions.model_output import parse_extraction
from quire.functions.text import word_terms
from quire.operators import gazetteer
from quire.plans import enrichment
from quire.session import spread

KINDS = ["method", "dataset", "task", "topic"]

LEXICON_CTES = """
  terms AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS term
            FROM documents),
  freq AS (SELECT term, count(*) AS df FROM terms WHERE length(term) > 4 GROUP BY term),
  lex AS (SELECT term AS name, CAST(('0x' || substr(md5(term), 1, 7)) AS BIGINT) AS ord FROM freq
          WHERE df <= 0.06::DOUBLE * (SELECT count(*) FROM documents)),
  lexicon AS (SELECT CASE ord % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'dataset' WHEN 2 THEN 'task' ELSE 'topic' END
                     AS entity_type, name, CAST(ord AS INTEGER) AS ord FROM lex),
  found AS (SELECT doc_id, ord, entity_type, name FROM terms JOIN lexicon ON term = name)"""


def data_lexicon(spark, d):
    """(entity_type, name, ord) of all longer words that are in at most 6 % of the documents."""
    documents = spread(v.table(spark, d, "documents").select("text"))
    terms = documents.select(F.explode(F.array_distinct(word_terms(F.col("text")))).alias("name"))
    limit = documents.select(F.count("*") * F.lit(0.06)).scalar()
    names = terms.filter(F.length("name") > 4).groupBy("name").agg(F.count("*").alias("df")).filter(F.col("df") <= limit)
    ord_ = F.conv(F.substring(F.md5("name"), 1, 7), 16, 10).cast("int")
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("ord") % 4 + 1)
    return names.withColumn("ord", ord_).select(kind.alias("entity_type"), "name", "ord")


FOUND_SQL = (
    "WITH "
    + LEXICON_CTES
    + """ SELECT source || '::' || f.doc_id AS paper_id, ord, entity_type, name
          FROM found f JOIN documents d ON d.doc_id = f.doc_id"""
)


@query("extract_entities", FOUND_SQL)
def extract_entities(spark, d):
    return gazetteer.extract(v.docs(spark, d), F.col("full_text"), data_lexicon(spark, d))


@query("extract_entities_joined", FOUND_SQL)
def extract_entities_joined(spark, d):
    return gazetteer.join_lexicon(v.docs(spark, d), F.col("full_text"), data_lexicon(spark, d))


@query(
    "default_gazetteer",
    """SELECT p_partkey::VARCHAR AS paper_id, entity_type, name FROM part, (VALUES
         ('LARGE', 'method', 'BERT'), ('LARGE', 'method', 'GPT'), ('LARGE', 'method', 'GPT-4'),
         ('LARGE', 'dataset', 'SQuAD'), ('LARGE', 'task', 'machine translation'),
         ('LARGE', 'task', 'neural machine translation'), ('SMALL', 'method', 'Llama 3'),
         ('SMALL', 'method', 'LLaMA'), ('SMALL', 'method', 'Llama 3.1'), ('SMALL', 'topic', 'robustness'),
         ('SMALL', 'dataset', 'CNN/DailyMail'), ('SMALL', 'method', 'CNN')) AS t(kind, entity_type, name) WHERE p_type = kind""",
)
def default_gazetteer(spark, d):
    sentence = (
        F.when(F.col("p_type") == "LARGE", F.concat("p_name", F.lit(": bert and GPT-4 on squad, for Neural Machine Translation; GPT-40")))
        .when(F.col("p_type") == "SMALL", F.concat("p_name", F.lit(" LLaMA 3.1 robustness (cnn/dailymail), Llamas XGPT")))
        .otherwise(F.col("p_name"))
    )
    parts = v.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), sentence.alias("s"))
    return gazetteer.extract(parts, F.col("s")).drop("ord")


@query(
    "exclusive_topics",
    """WITH l AS (SELECT 'topic' AS entity_type, upper(p_name) AS name, p_partkey AS ord FROM part
         UNION ALL SELECT 'topic', p_type, p_partkey FROM part
         UNION ALL SELECT 'task', p_name, p_partkey FROM part WHERE p_size > 45
         UNION ALL SELECT 'dataset', lower(p_type), p_partkey FROM part WHERE p_type = 'ECONOMY')
       SELECT * FROM l WHERE entity_type <> 'topic'
         OR lower(name) NOT IN (SELECT lower(name) FROM l WHERE entity_type <> 'topic')""",
)
def exclusive_topics(spark, d):
    part = v.table(spark, d, "part")

    def names(kind, name, rows):
        return rows.select(F.lit(kind).alias("entity_type"), name.alias("name"), F.col("p_partkey").alias("ord"))

    lexicon = (
        names("topic", F.upper("p_name"), part)
        .unionByName(names("topic", F.col("p_type"), part))
        .unionByName(names("task", F.col("p_name"), part.filter("p_size > 45")))
        .unionByName(names("dataset", F.lower("p_type"), part.filter("p_type = 'ECONOMY'")))
    )
    return gazetteer.exclusive_topics(lexicon)


def raw_answers(spark, d):
    """Model-like answers built from the parts: fenced, chatty, broken, not an object."""
    body = F.concat(
        F.lit('{"methods": [{"method_name": " '),
        "p_brand",
        F.lit(' ", "method_type": "model"}, {"method_name": "X", "method_type": "gadget"}, {"name": "y"}, "z", '),
        F.lit('{"method_name": "  "}], "datasets": [{"dataset_name": "'),
        "p_type",
        F.lit('", "task_type": "QA"}], "tasks": ["'),
        "p_name",
        F.lit('", 7, null, ""], "topics": []}'),
    )
    kind = F.col("p_size") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Sure, here it is: "), body, F.lit(" Anything else?")))
        .when(kind == 2, F.concat(F.lit('["'), "p_name", F.lit('"]')))
        .otherwise(F.concat(F.lit('{"methods": ['), "p_name"))
    )
    return v.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("paper_id"), raw.alias("answer"))


@query(
    "parse_model_output",
    """SELECT p_partkey::VARCHAR AS paper_id, p_size % 4 < 2 AS usable,
         CASE WHEN p_size % 4 < 2 THEN p_brand || '/model; X/-' END AS methods,
         CASE WHEN p_size % 4 < 2 THEN p_type || '/QA' END AS datasets,
         CASE WHEN p_size % 4 < 2 THEN p_name END AS tasks,
         CASE WHEN p_size % 4 < 2 THEN '' END AS topics FROM part""",
)
def parse_model_output(spark, d):
    parsed = raw_answers(spark, d).select("paper_id", parse_extraction(F.col("answer")).alias("p"))

    def joined(column):
        shown = F.transform(column, lambda e: F.concat_ws("/", e["name"], F.coalesce(e["attr"], F.lit("-"))))
        return F.array_join(shown, "; ")

    return parsed.select(
        "paper_id",
        F.col("p").isNotNull().alias("usable"),
        joined("p.methods").alias("methods"),
        joined("p.datasets").alias("datasets"),
        F.array_join("p.tasks", "; ").alias("tasks"),
        F.array_join("p.topics", "; ").alias("topics"),
    )


@query(
    "model_entities",
    """SELECT paper_id, ord, entity_type, name, attr FROM (
         SELECT p_partkey::VARCHAR AS paper_id, unnest([0, 1, 2, 3]) AS ord,
                unnest(['method', 'method', 'dataset', 'task']) AS entity_type,
                unnest([p_brand, 'X', p_type, p_name]) AS name, unnest(['model', NULL, 'QA', NULL]) AS attr
         FROM part WHERE p_size % 4 < 2)""",
)
def model_entities(spark, d):
    return enrichment.model_entities(raw_answers(spark, d))


@query(
    "extraction_prompt",
    """SELECT p_partkey, length('List the entities this paper names, as one JSON object and nothing else.')
         + length(chr(10) || chr(10) || 'Title: ' || p_name || chr(10) || 'Text: ' || p_name || chr(10) || p_type) AS head
       FROM part""",
)
def extraction_prompt(spark, d):
    from quire.functions.model_output import extraction_prompt as prompt

    title, text = F.col("p_name"), enrichment.extraction_text(F.col("p_name"), F.col("p_type"))
    request = prompt(title, text)
    return v.table(spark, d, "part").select(
        "p_partkey", (F.instr(request, "\n\nKeys:") - 1).cast("long").alias("head")
    )


@query(
    "merge_entities",
    """WITH m AS (SELECT DISTINCT 'orders::' || l_orderkey AS paper_id, upper(p_brand) AS name
                  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 2 = 0),
            g AS (SELECT DISTINCT 'orders::' || l_orderkey AS paper_id, p_brand AS name
                  FROM lineitem JOIN part ON l_partkey = p_partkey)
       SELECT paper_id, 'method' AS entity_type, name, 'model' AS attr FROM m
       UNION ALL
       SELECT paper_id, 'method', name, NULL FROM g
       WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.paper_id = g.paper_id AND lower(m.name) = lower(g.name))""",
)
def merge_entities(spark, d):
    lines = v._with_parts(spark, d).select(
        F.concat(F.lit("orders::"), F.col("l_orderkey").cast("string")).alias("paper_id"), "p_brand", "p_size"
    )
    layout = [F.lit("method").alias("entity_type"), F.lit(0).alias("ord")]
    model = lines.filter("p_size % 2 = 0").select(
        "paper_id", *layout, F.upper("p_brand").alias("name"), F.lit("model").alias("attr")
    )
    found = lines.select("paper_id", *layout, F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("attr"))
    return enrichment.merge_entities(model, found).drop("priority", "ord")


@query(
    "unenriched_papers",
    """SELECT id, year FROM papers p WHERE NOT EXISTS (
         SELECT 1 FROM lineitem WHERE 'orders::' || l_orderkey = p.id)""",
    ("papers",),
)
def unenriched_papers(spark, d):
    return enrichment.unenriched(v.papers(spark, d), v.entities(spark, d)).select("id", "year")


def worklist(spark, d):
    """Documents that have no label count as not enriched yet."""
    docs = v.docs(spark, d).withColumn("title", F.lit(""))
    labelled = docs.join(v.table(spark, d, "labels").select("doc_id"), "doc_id")
    return enrichment.unenriched(docs, labelled.select(F.col("id").alias("paper_id")))


ENRICHED_SQL = (
    "WITH "
    + LEXICON_CTES
    + """, work AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
         enriched AS (SELECT source || '::' || f.doc_id AS paper_id, entity_type, name
                      FROM found f JOIN work w ON w.doc_id = f.doc_id) """
)


@query("incremental_enrichment", ENRICHED_SQL + "SELECT paper_id, entity_type, name FROM enriched")
def incremental_enrichment(spark, d):
    return enrichment.enrich(worklist(spark, d), data_lexicon(spark, d)).drop("attr")


@query(
    "enrichment_run_stats",
    ENRICHED_SQL
    + """SELECT (SELECT count(*) FROM work) AS processed, 0::BIGINT AS skipped, 0::BIGINT AS model_used,
           (SELECT count(*) FROM work) AS fallback_used,
           count(*) FILTER (entity_type = 'method') AS total_methods,
           count(*) FILTER (entity_type = 'dataset') AS total_datasets,
           count(*) FILTER (entity_type = 'task') AS total_tasks,
           count(*) FILTER (entity_type = 'topic') AS total_topics FROM enriched""",
)
def enrichment_run_stats(spark, d):
    work = worklist(spark, d)
    return enrichment.run_stats(work, enrichment.enrich(work, data_lexicon(spark, d)))


class TitleBackend:
    """Stands for a language model: names the title as a method, or gives no JSON."""

    name = "title"

    def is_available(self):
        return True

    def generate(self, prompt, system_prompt=None, max_tokens=512, temperature=0.0):
        from quire.plans.answers import Generation

        title = prompt.split("Title: ")[1].split("\n")[0]
        reply = f'{{"methods": [{{"method_name": "{title}", "method_type": "technique"}}]}}'
        return Generation(reply if "bolt" not in title else "I do not know.", self.name)


@query(
    "model_enrichment",
    """SELECT p_partkey::VARCHAR AS paper_id, 'method' AS entity_type, p_name AS name, 'technique' AS attr
       FROM part WHERE p_name NOT LIKE '%bolt%'
       UNION ALL SELECT p_partkey::VARCHAR, 'task', 'machine translation', NULL FROM part""",
)
def model_enrichment(spark, d):
    todo = v.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("title"),
        F.concat("p_type", F.lit(" machine translation")).alias("abstract"),
    )
    return enrichment.enrich(todo, model_answers=enrichment.ask_model(todo, TitleBackend()))

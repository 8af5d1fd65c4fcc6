"""Enriching papers with entities: gazetteer, optional model, merge, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.model_output import extraction_prompt, parse_extraction
from quire.functions.text import is_blank
from quire.operators import gazetteer
from quire.plans.answers import UNAVAILABLE_MODEL, Backend, generate

MODEL, GAZETTEER = 0, 1
EXTRACTION_SYSTEM_PROMPT = "You extract entities from papers. Reply with valid JSON only."


def extraction_text(title: Column, abstract: Column) -> Column:
    """Title and abstract on separate lines, without empty parts."""
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(abstract, F.lit("")))


def unenriched(papers: DataFrame, entities: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Papers without an entity of any type.

    ``processed`` may name papers (paper_id) that were looked at before without a
    find, which would otherwise be tried on every run.
    """
    done = entities.select(F.col("paper_id").alias("id"))
    if processed is not None:
        done = done.unionByName(processed.select(F.col("paper_id").alias("id")))
    return papers.join(done, "id", "left_anti")


def newest(papers: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest papers, by year, then by ``created_at`` if there is one; ties go to the smaller id.

    The n-th key is found by counts of years, so only papers of one year are ever ordered.
    """
    if n < 1:
        raise ValueError("a number of papers is at least 1")
    papers = papers.withColumn("_year", F.coalesce(F.col("year"), F.lit(-1)))
    taken, edge = 0, None
    for row in papers.groupBy("_year").count().orderBy(F.desc("_year")).collect():  # one row per year
        if taken + row["count"] > n:
            edge = row["_year"]
            break
        taken += row["count"]
    if edge is None:
        return papers.drop("_year")
    whole = papers.filter(F.col("_year") > edge)
    order = [F.desc_nulls_last("created_at")] if "created_at" in papers.columns else []
    part = papers.filter(F.col("_year") == edge).orderBy(*order, "id").limit(n - taken)
    return (whole.unionByName(part) if taken < n else whole).drop("_year")


def gazetteer_entities(papers: DataFrame, lexicon: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(paper_id, ord, entity_type, name, attr) found by the lexicon."""
    text = extraction_text(F.col("title"), F.col("abstract"))
    return gazetteer.extract(papers, text, lexicon).withColumn("attr", F.lit(None).cast("string"))


def model_entities(raw: DataFrame) -> DataFrame:
    """(paper_id, ord, entity_type, name, attr) of raw model answers (paper_id, answer)."""
    plain = "transform(parsed.{0}, x -> struct('{1}' AS entity_type, x AS name, CAST(NULL AS STRING) AS attr))"
    named = "transform(parsed.{0}, x -> struct('{1}' AS entity_type, x.name AS name, x.attr AS attr))"
    rows = F.expr(
        "concat("
        + ", ".join(
            [
                named.format("methods", "method"),
                named.format("datasets", "dataset"),
                plain.format("tasks", "task"),
                plain.format("topics", "topic"),
            ]
        )
        + ")"
    )
    parsed = raw.select("paper_id", parse_extraction(F.col("answer")).alias("parsed"))
    return parsed.select("paper_id", F.posexplode(rows).alias("ord", "e")).select("paper_id", "ord", "e.*")


def ask_model(papers: DataFrame, backend: Backend) -> DataFrame:
    """Raw answers (paper_id, answer, model_ok) for the extraction request."""
    text = extraction_text(F.col("title"), F.col("abstract"))
    asked = papers.select(F.col("id").alias("paper_id"), extraction_prompt(F.col("title"), text).alias("prompt"))
    answered = generate(asked, backend, system_prompt=EXTRACTION_SYSTEM_PROMPT, max_tokens=512, temperature=0.0)
    return answered.select("paper_id", "answer", (F.col("model") != UNAVAILABLE_MODEL).alias("model_ok"))


def merge_entities(model: DataFrame, found: DataFrame) -> DataFrame:
    """One row per paper, type and lower-cased name; the model's spelling wins.

    A grouping by the full key combines before it shuffles and has no hot group.
    """
    columns = ["paper_id", "entity_type", "ord", "name", "attr"]
    both = model.select(*columns, F.lit(MODEL).alias("priority")).unionByName(
        found.select(*columns, F.lit(GAZETTEER).alias("priority"))
    )
    best = both.groupBy("paper_id", "entity_type", F.lower("name").alias("key")).agg(
        F.min(F.struct("priority", "ord", "name", "attr")).alias("best")
    )
    return best.select("paper_id", "entity_type", "best.priority", "best.ord", "best.name", "best.attr")


def enrich(
    papers: DataFrame,
    lexicon: list[tuple[str, str]] | DataFrame | None = None,
    model_answers: DataFrame | None = None,
    use_gazetteer: bool = True,
) -> DataFrame:
    """Entities of ``papers`` in the layout of the entity table.

    ``model_answers`` (paper_id, answer) may miss papers or hold unusable text;
    the gazetteer fills in.
    """
    found = gazetteer_entities(papers, lexicon)
    if not use_gazetteer:
        found = found.filter(F.lit(False))
    rows = found if model_answers is None else merge_entities(model_entities(model_answers), found)
    return rows.select("paper_id", "entity_type", "name", "attr")


def run_stats(worklist: DataFrame, enriched: DataFrame, model_answers: DataFrame | None = None) -> DataFrame:
    """One row: papers processed and skipped, model hits and fallbacks, finds per type."""
    text = extraction_text(F.col("title"), F.col("abstract"))
    blank = is_blank(text)
    flagged = worklist.select(F.col("id").alias("paper_id"), blank.alias("blank"))
    if model_answers is not None:
        usable = model_answers.select("paper_id", parse_extraction(F.col("answer")).isNotNull().alias("usable"))
        flagged = flagged.join(usable, "paper_id", "left")
    else:
        flagged = flagged.withColumn("usable", F.lit(False))
    ok = F.coalesce("usable", F.lit(False))
    totals = enriched.agg(
        *[F.count_if(F.col("entity_type") == t).alias(f"total_{t}s") for t in ("method", "dataset", "task", "topic")]
    )
    work = flagged.agg(
        F.count_if(~F.col("blank")).alias("processed"),
        F.count_if("blank").alias("skipped"),
        F.count_if(~F.col("blank") & ok).alias("model_used"),
        F.count_if(~F.col("blank") & ~ok).alias("fallback_used"),
    )
    # Two single rows: scalars of ``totals`` would run the extraction once for each column.
    return work.crossJoin(totals)

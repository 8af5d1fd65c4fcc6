"""Counts, rankings, trends, co-occurrence, browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import views as v
from quire.catalog.registry import query
from quire.functions.ids import paper_source, paper_source_id
from quire.functions.labels import count_label, split_composite_venue, venue_label
from quire.operators import browse, counts, pairs, sketches

KINDS = ("methods", "datasets", "tasks", "topics")
NEEDLES = {"methods": "brand#1", "datasets": "ECON", "tasks": "ring", "topics": "NATION_1"}


@query("paper_count", "SELECT count(*) AS n FROM papers", ("papers",))
def paper_count(spark, d):
    return counts.count_rows(v.papers(spark, d))


@query("vector_count", "SELECT count(*) AS n FROM embeddings")
def vector_count(spark, d):
    return counts.count_rows(v.table(spark, d, "embeddings"))


@query(
    "papers_per_venue",
    "SELECT venue, count(*) AS paper_count FROM papers WHERE venue IS NOT NULL GROUP BY venue",
    ("papers",),
)
def papers_per_venue(spark, d):
    return counts.papers_per_venue(v.papers(spark, d))


@query(
    "top_venues",
    """SELECT venue, count(*) AS paper_count FROM papers WHERE venue IS NOT NULL GROUP BY venue
       ORDER BY paper_count DESC, venue LIMIT 8""",
    ("papers",),
)
def top_venues(spark, d):
    return counts.papers_per_venue(v.papers(spark, d)).limit(8)


@query(
    "papers_per_venue_year",
    "SELECT venue, year, count(*) AS paper_count FROM papers GROUP BY venue, year",
    ("papers",),
)
def papers_per_venue_year(spark, d):
    return counts.papers_per_venue_year(v.papers(spark, d))


@query(
    "year_over_year_growth",
    """WITH c AS (SELECT year, count(*) AS paper_count FROM papers GROUP BY year),
       p AS (SELECT year, paper_count, lag(paper_count) OVER (ORDER BY year NULLS FIRST) AS prev_count FROM c)
       SELECT year, paper_count, prev_count,
              CASE WHEN prev_count > 0
                   THEN round(100.0::DOUBLE * (paper_count - prev_count) / prev_count, 1) END AS growth_pct
       FROM p""",
    ("papers",),
)
def year_over_year_growth(spark, d):
    return counts.year_over_year_growth(v.papers(spark, d))


def _register_kind(kind: str) -> None:
    needle = NEEDLES[kind]
    singular = kind[:-1]

    @query(
        f"top_{kind}_by_year",
        f"""SELECT name, year, count, rank FROM (
              SELECT e.name, p.year, count(*) AS count,
                     CAST(rank() OVER (PARTITION BY p.year ORDER BY count(*) DESC) AS BIGINT) AS rank
              FROM {kind} e JOIN papers p ON e.paper_id = p.id GROUP BY e.name, p.year) t
            WHERE rank <= 10""",
        ("papers", kind),
    )
    def top_by_year(spark, d):
        return counts.top_entities_by_year(v.entities(spark, d, kind), v.papers(spark, d), kind)

    @query(
        f"{singular}_trend",
        f"""SELECT p.year, count(*) AS paper_count FROM {kind} e JOIN papers p ON e.paper_id = p.id
            WHERE e.name ILIKE '%{needle}%' GROUP BY p.year""",
        ("papers", kind),
    )
    def trend(spark, d):
        return counts.entity_trend(v.entities(spark, d, kind), v.papers(spark, d), kind, needle)

    @query(
        f"entity_list_{kind}",
        f"""SELECT name, count(*) AS count FROM {kind} GROUP BY name
            ORDER BY count DESC, name LIMIT 500""",
        (kind,),
    )
    def listing(spark, d):
        return counts.entity_list(v.entities(spark, d, kind), kind)


for _kind in KINDS:
    _register_kind(_kind)


@query(
    "top_methods_latest_year",
    """SELECT name, year, count, rank FROM (
         SELECT e.name, p.year, count(*) AS count,
                CAST(rank() OVER (PARTITION BY p.year ORDER BY count(*) DESC) AS BIGINT) AS rank
         FROM methods e JOIN papers p ON e.paper_id = p.id GROUP BY e.name, p.year) t
       WHERE rank <= 10 AND year = (SELECT max(year) FROM papers p JOIN methods m ON m.paper_id = p.id)""",
    ("papers", "methods"),
)
def top_methods_latest_year(spark, d):
    return counts.latest_year(counts.top_entities_by_year(v.entities(spark, d, "methods"), v.papers(spark, d), "methods"))


@query(
    "dashboard_top_methods",
    """WITH r AS (
         SELECT e.name, p.year, count(*) AS count, rank() OVER (PARTITION BY p.year ORDER BY count(*) DESC) AS rank
         FROM methods e JOIN papers p ON e.paper_id = p.id GROUP BY e.name, p.year)
       SELECT name, CAST(sum(count) AS BIGINT) AS count FROM r WHERE rank <= 10
       GROUP BY name ORDER BY count DESC, name LIMIT 10""",
    ("papers", "methods"),
)
def dashboard_top_methods(spark, d):
    return counts.sum_by_name(counts.top_entities_by_year(v.entities(spark, d, "methods"), v.papers(spark, d), "methods"))


@query(
    "trend_compare",
    """WITH e AS (
         SELECT p.year, 'brand' AS line FROM methods m JOIN papers p ON m.paper_id = p.id WHERE m.name ILIKE '%brand#1%'
         UNION ALL
         SELECT p.year, 'ring' FROM tasks t JOIN papers p ON t.paper_id = p.id WHERE t.name ILIKE '%ring%'
         UNION ALL
         SELECT p.year, 'nowhere' FROM tasks t JOIN papers p ON t.paper_id = p.id WHERE t.name ILIKE '%nowhere%')
       SELECT year, nullif(count(*) FILTER (line = 'brand'), 0) AS brand,
              nullif(count(*) FILTER (line = 'ring'), 0) AS ring,
              nullif(count(*) FILTER (line = 'nowhere'), 0) AS nowhere
       FROM e GROUP BY year""",
    ("papers", "methods", "tasks"),
)
def trend_compare(spark, d):
    lines = {"brand": ("methods", "brand#1"), "ring": ("tasks", "ring"), "nowhere": ("tasks", "nowhere")}
    return counts.compare_trends(v.entities(spark, d, "methods", "tasks"), v.papers(spark, d), lines)


@query(
    "venue_method_profile",
    """SELECT m.name, count(*) AS paper_count FROM methods m JOIN papers p ON m.paper_id = p.id
       WHERE p.venue = 'building' GROUP BY m.name ORDER BY paper_count DESC, m.name LIMIT 10""",
    ("papers", "methods"),
)
def venue_method_profile(spark, d):
    return counts.venue_method_profile(v.entities(spark, d, "methods"), v.papers(spark, d), "building")


@query(
    "enrichment_stats",
    """SELECT (SELECT count(*) FROM papers) AS total_papers,
              (SELECT count(DISTINCT name) FROM methods) AS total_methods,
              (SELECT count(DISTINCT name) FROM datasets) AS total_datasets,
              (SELECT count(DISTINCT name) FROM tasks) AS total_tasks,
              (SELECT count(DISTINCT name) FROM topics) AS total_topics,
              (SELECT count(DISTINCT paper_id) FROM methods) AS papers_with_methods""",
    ("papers", "methods", "datasets", "tasks", "topics"),
)
def enrichment_stats(spark, d):
    return counts.enrichment_stats(v.papers(spark, d), v.entities(spark, d))


@query(
    "entity_estimates",
    """WITH e AS (SELECT 'method' AS entity_type, * FROM methods UNION ALL SELECT 'dataset', * FROM datasets
         UNION ALL SELECT 'task', * FROM tasks UNION ALL SELECT 'topic', * FROM topics)
       SELECT entity_type, count(*) AS rows, TRUE AS names_within_2_percent, TRUE AS papers_within_2_percent
       FROM e GROUP BY entity_type""",
    ("methods", "datasets", "tasks", "topics"),
)
def entity_estimates(spark, d):
    """Sketches of two appended halves, united, against the exact distinct counts."""
    entities = v.entities(spark, d)
    late = F.pmod(F.xxhash64("paper_id"), F.lit(2)) == 1
    halves = [sketches.distinct_sketches(entities.filter(c)) for c in (~late, late)]
    found = sketches.estimates(sketches.united(*halves))
    exact = entities.groupBy("entity_type").agg(F.count_distinct("name").alias("n"), F.count_distinct("paper_id").alias("p"))
    return found.join(exact, "entity_type").select(
        "entity_type",
        "rows",
        (F.abs(F.col("names") - F.col("n")) <= 0.02 * F.col("n")).alias("names_within_2_percent"),
        (F.abs(F.col("papers") - F.col("p")) <= 0.02 * F.col("p")).alias("papers_within_2_percent"),
    )


@query(
    "method_dataset_cooccurrence",
    """SELECT m.name AS method_name, t.name AS dataset_name, count(*) AS co_count
       FROM methods m JOIN datasets t ON m.paper_id = t.paper_id
       GROUP BY ALL ORDER BY co_count DESC, method_name, dataset_name LIMIT 20""",
    ("methods", "datasets"),
)
def method_dataset_cooccurrence(spark, d):
    return pairs.entity_cooccurrence(v.entities(spark, d, "methods", "datasets"), "methods", "datasets")


@query(
    "method_task_cooccurrence",
    """SELECT m.name AS method_name, t.name AS task_name, count(*) AS co_count
       FROM methods m JOIN tasks t ON m.paper_id = t.paper_id
       GROUP BY ALL ORDER BY co_count DESC, method_name, task_name LIMIT 20""",
    ("methods", "tasks"),
)
def method_task_cooccurrence(spark, d):
    return pairs.entity_cooccurrence(v.entities(spark, d, "methods", "tasks"), "methods", "tasks")


@query(
    "top_authors",
    """SELECT name, count(DISTINCT paper_id) AS paper_count FROM authors
       GROUP BY name ORDER BY paper_count DESC, name LIMIT 20""",
    ("authors",),
)
def top_authors(spark, d):
    return counts.top_authors(v.authors(spark, d))


@query(
    "author_pairs",
    """SELECT a1.name AS author_a, a2.name AS author_b, count(DISTINCT a1.paper_id) AS shared_papers
       FROM authors a1 JOIN authors a2 ON a1.paper_id = a2.paper_id AND a1.name < a2.name
       GROUP BY a1.name, a2.name ORDER BY shared_papers DESC, author_a, author_b LIMIT 20""",
    ("authors",),
)
def author_pairs(spark, d):
    return pairs.author_pairs(v.authors(spark, d))


@query(
    "browse_papers",
    """SELECT id, title, year, venue FROM papers WHERE venue = 'building' AND volume = '1-URGENT'
       ORDER BY year DESC NULLS LAST, title, id LIMIT 20 OFFSET 20""",
    ("papers",),
)
def browse_papers(spark, d):
    found = browse.filter_papers(v.papers(spark, d), venue="building", volume="1-URGENT")
    return browse.browse_papers(found, 20, 20)


@query(
    "browse_deep_page",
    """SELECT id, title, year, venue FROM papers
       ORDER BY year DESC NULLS LAST, title NULLS FIRST, id LIMIT 50 OFFSET 11000""",
    ("papers",),
)
def browse_deep_page(spark, d):
    return browse.browse_papers(v.papers(spark, d), 50, 11_000)


@query(
    "browse_by_entities",
    """SELECT id, title, year, venue FROM papers
       WHERE year = 1998
         AND id IN (SELECT paper_id FROM methods WHERE name ILIKE '%brand#1%')
         AND id IN (SELECT paper_id FROM datasets WHERE name ILIKE '%econ%')
       ORDER BY year DESC NULLS LAST, title, id LIMIT 100""",
    ("papers", "methods", "datasets"),
)
def browse_by_entities(spark, d):
    found = browse.filter_papers(
        v.papers(spark, d), v.entities(spark, d, "methods", "datasets"), year=1998, method="brand#1", dataset="econ"
    )
    return browse.browse_papers(found, 100)


@query(
    "browse_with_authors",
    """WITH page AS (
         SELECT id, title, year, venue FROM papers
         WHERE id IN (SELECT paper_id FROM authors WHERE name ILIKE '%supplier#00000000%')
         ORDER BY year DESC NULLS LAST, title, id LIMIT 50)
       SELECT page.*, coalesce(a.authors, '') AS authors
       FROM page LEFT JOIN (SELECT paper_id, string_agg(name, '; ' ORDER BY position) AS authors
                            FROM authors GROUP BY paper_id) a ON a.paper_id = page.id""",
    ("papers", "authors"),
)
def browse_with_authors(spark, d):
    authors = v.authors(spark, d)
    page = browse.browse_papers(
        browse.filter_papers(v.papers(spark, d), authors=authors, author="supplier#00000000"), 50
    )
    return browse.attach_authors(page, authors, 50).withColumn("authors", F.array_join("authors", "; "))


@query(
    "count_papers",
    """SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM papers
       WHERE venue = 'machinery' AND id IN (SELECT paper_id FROM methods WHERE name ILIKE '%brand#2%')""",
    ("papers", "methods"),
)
def count_papers(spark, d):
    methods = v.entities(spark, d, "methods")
    found = browse.filter_papers(v.papers(spark, d), methods, venue="machinery", method="brand#2")
    return browse.count_papers(found)


@query(
    "paper_details",
    """WITH a AS (SELECT paper_id, string_agg(name, '; ' ORDER BY position) AS x FROM authors GROUP BY paper_id),
            m AS (SELECT paper_id, string_agg(name, '; ' ORDER BY name) AS x FROM methods GROUP BY paper_id),
            t AS (SELECT paper_id, string_agg(name, '; ' ORDER BY name) AS x FROM datasets GROUP BY paper_id)
       SELECT p.id, p.title, p.year, p.venue, p.volume, coalesce(a.x, '') AS authors,
              coalesce(m.x, '') AS methods, coalesce(t.x, '') AS datasets
       FROM papers p LEFT JOIN a ON a.paper_id = p.id LEFT JOIN m ON m.paper_id = p.id
       LEFT JOIN t ON t.paper_id = p.id""",
    ("papers", "authors", "methods", "datasets"),
)
def paper_details(spark, d):
    detail = browse.paper_details(
        v.papers(spark, d), v.authors(spark, d), v.entities(spark, d, "methods", "datasets")
    )
    names = {k: F.array_join(F.transform(k, lambda e: e["name"]), "; ") for k in ("methods", "datasets")}
    return detail.withColumns({"authors": F.array_join("authors", "; "), **names}).select(
        "id", "title", "year", "venue", "volume", "authors", "methods", "datasets"
    )


@query(
    "paper_lookup",
    """SELECT id, title, year, venue FROM papers WHERE id IN (
         SELECT paper_id FROM methods WHERE name = 'Brand#7')""",
    ("papers", "methods"),
)
def paper_lookup(spark, d):
    wanted = v.entity(spark, d, "methods").filter(F.col("name") == "Brand#7").select(F.col("paper_id").alias("id"))
    found = browse.papers_by_ids(v.papers(spark, d), wanted)
    return found.select("id", "title", "year", "venue")


@query(
    "paper_id_parts",
    """SELECT id, split_part(id, '::', 1) AS source, split_part(id, '::', -1) AS source_id,
              replace(replace(id, '::', '_'), '/', '_') AS file_name
       FROM papers""",
    ("papers",),
)
def paper_id_parts(spark, d):
    from quire.functions.ids import safe_file_name

    pid = F.col("id")
    return v.papers(spark, d).select(
        "id",
        paper_source(pid).alias("source"),
        paper_source_id(pid).alias("source_id"),
        safe_file_name(pid).alias("file_name"),
    )


@query(
    "venue_labels",
    """WITH c AS (
         SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'findings-acl' WHEN 'MACHINERY' THEN 'semeval'
                WHEN 'FURNITURE' THEN NULL ELSE lower(c_mktsegment) END AS venue, count(*) AS n
         FROM customer GROUP BY 1)
       SELECT venue, n,
              CASE venue WHEN 'findings-acl' THEN 'Findings of ACL' WHEN 'semeval' THEN 'SemEval'
                   ELSE coalesce(upper(venue), 'Unknown') END AS label,
              CASE WHEN venue LIKE 'findings-%' THEN 'findings' ELSE venue END AS base,
              CASE WHEN venue LIKE 'findings-%' THEN substr(venue, 10) END AS volume,
              CASE WHEN n * 1000 >= 1000000 THEN printf('%.1fM', n / 1000.0)
                   WHEN n * 1000 >= 1000 THEN printf('%.1fK', n::DOUBLE) ELSE CAST(n * 1000 AS VARCHAR) END AS size
       FROM c""",
)
def venue_labels(spark, d):
    segment = F.col("c_mktsegment")
    venue = (
        F.when(segment == "BUILDING", "findings-acl")
        .when(segment == "MACHINERY", "semeval")
        .when(segment != "FURNITURE", F.lower(segment))
    )
    sizes = v.table(spark, d, "customer").groupBy(venue.alias("venue")).agg(F.count("*").alias("n"))
    base, volume = split_composite_venue(F.col("venue"))
    return sizes.select(
        "venue",
        "n",
        venue_label(F.col("venue")).alias("label"),
        base.alias("base"),
        volume.alias("volume"),
        count_label(F.col("n") * 1000).alias("size"),
    )

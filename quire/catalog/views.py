"""The given tables seen as a corpus of papers.

An order is a paper: its year is the order year, its venue the customer's market
segment.  Suppliers of its lines are its authors; brands, types, part names and
supplier nations are its methods, datasets, tasks and topics.  ``documents`` are
papers with text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _order_id(column: str):
    return F.concat(F.lit("orders::"), F.col(column).cast("string"))


def papers(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        _order_id("o_orderkey").alias("id"),
        F.col("o_orderkey").cast("string").alias("source_id"),
        F.lit("orders").alias("source"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.lower("c_mktsegment").alias("venue"),
        F.col("o_orderpriority").alias("volume"),
    )


def _per_order(lines: DataFrame, name: str) -> DataFrame:
    return lines.select(_order_id("l_orderkey").alias("paper_id"), F.col(name).alias("name")).distinct()


def _with_parts(spark: SparkSession, folder: str) -> DataFrame:
    lines = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_partkey"))
    return lines.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))


def _with_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    lines = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey"))
    return lines.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))


def authors(spark: SparkSession, folder: str) -> DataFrame:
    once = _per_order(_with_suppliers(spark, folder), "s_name")
    position = F.row_number().over(Window.partitionBy("paper_id").orderBy("name")) - 1
    return once.withColumn("position", position.cast("int"))


def entity(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(paper_id, entity_type, name, attr) of one kind."""
    if kind == "topics":
        nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
        lines = _with_suppliers(spark, folder).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        rows = _per_order(lines, "n_name")
    else:
        column = {"methods": "p_brand", "datasets": "p_type", "tasks": "p_name"}[kind]
        rows = _per_order(_with_parts(spark, folder), column)
    return rows.select(
        "paper_id", F.lit(kind[:-1]).alias("entity_type"), "name", F.lit(None).cast("string").alias("attr")
    )


def entities(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    """The given kinds, by default all four.

    The literal type lets Catalyst drop the branches a query filters out.
    """
    frames = [entity(spark, folder, kind) for kind in kinds or ("methods", "datasets", "tasks", "topics")]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as papers; the whole text is both abstract and full text."""
    return table(spark, folder, "documents").select(
        F.concat("source", F.lit("::"), F.col("doc_id").cast("string")).alias("id"),
        "doc_id",
        "source",
        "lang",
        F.col("text").alias("abstract"),
        F.col("text").alias("full_text"),
    )


# View name -> (views it needs, SQL).
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "papers": (
        (),
        """SELECT concat('orders::', CAST(o.o_orderkey AS VARCHAR)) AS id,
        CAST(o.o_orderkey AS VARCHAR) AS source_id, 'orders' AS source,
        concat('Order ', CAST(o.o_orderkey AS VARCHAR)) AS title,
        CAST(year(o.o_orderdate) AS INTEGER) AS year,
        lower(c.c_mktsegment) AS venue, o.o_orderpriority AS volume
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    ),
    "authors": (
        (),
        """SELECT paper_id, name,
        CAST(row_number() OVER (PARTITION BY paper_id ORDER BY name) - 1 AS INTEGER) AS position
        FROM (SELECT DISTINCT concat('orders::', CAST(l.l_orderkey AS VARCHAR)) AS paper_id, s.s_name AS name
              FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey) t""",
    ),
    "methods": (
        (),
        """SELECT DISTINCT concat('orders::', CAST(l.l_orderkey AS VARCHAR)) AS paper_id, p.p_brand AS name
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    ),
    "datasets": (
        (),
        """SELECT DISTINCT concat('orders::', CAST(l.l_orderkey AS VARCHAR)) AS paper_id, p.p_type AS name
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    ),
    "tasks": (
        (),
        """SELECT DISTINCT concat('orders::', CAST(l.l_orderkey AS VARCHAR)) AS paper_id, p.p_name AS name
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    ),
    "topics": (
        (),
        """SELECT DISTINCT concat('orders::', CAST(l.l_orderkey AS VARCHAR)) AS paper_id, n.n_name AS name
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
        JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    ),
    "docs": (
        (),
        """SELECT concat(source, '::', CAST(doc_id AS VARCHAR)) AS id, doc_id, source, lang,
        text AS abstract, text AS full_text FROM documents""",
    ),
}

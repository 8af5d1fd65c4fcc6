"""Enriching a stream of new papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.enrichment import enrich


def enrich_stream(
    papers: DataFrame,
    output: str,
    checkpoint: str,
    lexicon: list[tuple[str, str]] | DataFrame | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Write the entities of arriving papers below ``output``.

    A micro-batch has a folder of its own and replaces it when it runs again, so
    a restart never doubles entities.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = enrich(batch.dropDuplicates(["id"]), lexicon)
        rows.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    writer = papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_entities(spark, output: str) -> DataFrame:
    """Entities written so far, one row per paper, type and name."""
    rows = spark.read.option("basePath", output).parquet(f"{output}/batch_id=*")
    return rows.drop("batch_id").groupBy("paper_id", "entity_type", "name").agg(F.min("attr").alias("attr"))

"""The corpus as parquet tables below one folder.

Every overwrite goes to a new version folder, so a table can be rebuilt from
itself and a failed job leaves the current version in place.  A version counts
once Spark has marked it complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.model import TABLES
from quire.sources.papers import path_exists

SUCCESS = "_SUCCESS"


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions."""
    if not path_exists(spark, folder):
        return []
    location = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(location)]
    numbers = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]
    return sorted(n for n in numbers if path_exists(spark, f"{folder}/v{n}/{SUCCESS}"))


class TableStore:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType] | None = None):
        self.spark, self.root = spark, root
        self.schemas = TABLES if schemas is None else schemas

    def create(self) -> None:
        """Empty tables for those that do not exist."""
        for name, schema in self.schemas.items():
            if not self.exists(name):
                self.overwrite(name, self.spark.createDataFrame([], schema))

    def exists(self, name: str) -> bool:
        return bool(_versions(self.spark, f"{self.root}/{name}"))

    def _current(self, name: str) -> str:
        versions = _versions(self.spark, f"{self.root}/{name}")
        if not versions:
            raise FileNotFoundError(f"no table {name} below {self.root}")
        return f"{self.root}/{name}/v{versions[-1]}"

    def read(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        return reader.parquet(self._current(name))

    def overwrite(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        versions = _versions(self.spark, f"{self.root}/{name}")
        number = versions[-1] + 1 if versions else 1
        df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{self.root}/{name}/v{number}")

    def append(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        df.write.mode("append").partitionBy(*(partition_by or [])).parquet(self._current(name))

    def copy_to(self, root: str) -> None:
        """Copy the current version of every table to another place, such as an object store."""
        target = TableStore(self.spark, root, self.schemas)
        for name in self.schemas:
            target.overwrite(name, self.read(name))

    def files(self, prefix: str = "") -> DataFrame:
        """``path, length`` of the stored files whose path below the root starts with ``prefix``.

        All versions are listed, contents are not read.
        """
        if not path_exists(self.spark, self.root):
            return self.spark.createDataFrame([], "path string, length long")
        location = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = location.getFileSystem(self.spark._jsc.hadoopConfiguration())
        root = system.makeQualified(location).toString().rstrip("/")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root)
        path = F.substr("path", F.lit(len(root) + 2))
        return found.select(path.alias("path"), "length").filter(F.col("path").startswith(prefix))

    def complete(self) -> bool:
        return all(self.exists(name) for name in self.schemas)


def new_papers(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Papers whose id is new; of several rows with one id the first by ``order``.

    Equal places in the order are told apart by digests of the rows, so the result does
    not depend on the partitioning.  The grouping combines before the shuffle and
    replaces a window over the ids.
    """
    columns = [c for c in incoming.columns if c != "id"]
    place = F.struct(F.col(order).alias("place"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("row"))
    first = incoming.groupBy("id").agg(F.min_by(F.struct(*columns), place).alias("row")).select("id", "row.*")
    return first.join(existing.select("id"), "id", "left_anti").select(*incoming.columns)


def author_rows(papers: DataFrame) -> DataFrame:
    """(paper_id, name, position) of papers with an author list."""
    return papers.select(F.col("id").alias("paper_id"), F.posexplode("authors").alias("position", "name")).select(
        "paper_id", "name", "position"
    )


def new_author_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Author rows whose (paper_id, position) is new, so loading twice changes nothing."""
    keys = ["paper_id", "position"]
    first = incoming.groupBy(*keys).agg(F.min("name").alias("name")).select(*incoming.columns)
    return first.join(existing.select(*keys), keys, "left_anti")

"""Folders that the driver and every executor see, and cutting of lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

LOCAL_BATCH_BYTES = 1 << 18  # what one vectorised step over texts holds


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of its own only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    own = getattr(spark.sparkContext, "_own_shared_folder", None)
    if own is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = spark.sparkContext._own_shared_folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back; compact for many rows."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give back what Arrow holds without need; a worker keeps its memory while it waits beside others."""
    pa.default_memory_pool().release_unused()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> None:
    """Write the byte strings ``parts`` to ``uri``.

    The file appears under its name only when it is whole, so a repeated or
    speculative attempt leaves the same file.
    """
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
    fs.move(attempt, path)

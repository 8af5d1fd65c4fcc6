"""Session defaults and the two guards every operator uses for small data."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What one broadcast or one driver-side copy may hold.  A frame beyond either
# limit takes the shuffled path instead.
MAX_SMALL_ROWS = 200_000
MAX_SMALL_BYTES = 64 * 1024 * 1024


def get_session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume.

    AQE does the partition sizing, the skew splitting and the switch to
    broadcast joins, so shuffle partitions are only an upper bound.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def is_small(df: DataFrame, max_rows: int = MAX_SMALL_ROWS, max_bytes: int = MAX_SMALL_BYTES) -> bool:
    """Whether ``df`` fits the limits, measured on its rows, not estimated.

    Reads at most ``max_rows + 1`` rows.
    """
    width = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(field.dataType, T.ArrayType):
            width = width + 8 * F.greatest(F.coalesce(F.size(field.name), F.lit(0)), F.lit(0)) + 16
        else:
            width = width + 8
    row = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def hold_if_small(df: DataFrame, **limits: int) -> DataFrame:
    """A copy of ``df`` that later plans share, when it is measured to fit, else ``df``.

    Serves request-sized input, such as the queries of a search, that a plan uses
    in several places.
    """
    if df._jdf.queryExecution().optimizedPlan().nodeName() == "LocalRelation" or not is_small(df, **limits):
        return df
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


def broadcast_if_small(df: DataFrame, **limits: int) -> DataFrame:
    """``df`` with a broadcast hint when it is measured to fit, else unchanged."""
    return F.broadcast(df) if is_small(df, **limits) else df


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares.

    Without a cluster it may be a folder of its own; on one, spark.checkpoint.dir must be set.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="quire-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Partitions for all cores before row-wise heavy work on a small input.

    Files below one split per core are read by few tasks; the planner's size of
    the input decides, without a job.  Large inputs have enough splits of their
    own and stay as they are.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")
    ))
    return df.repartition(cores) if size < cores * split else df

"""Sliding-log rate limiting of a table of requests.

A request is admitted when its client has fewer than N admitted requests in the
window before it.  Rejected requests do not count, so the decision depends on
earlier decisions.  Time is cut where it does not: with buckets as long as the
window, a bucket that together with the one before it has at most N requests
admits all of them whatever came before.  Such buckets start segments that are
independent of each other, so even one very busy client is spread over tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_REQUESTS = 10
WINDOW_SECONDS = 60


def client_of(forwarded_for: Column, address: Column) -> Column:
    """First address of a forwarding header, else the peer address."""
    first = F.trim(F.substring_index(forwarded_for, ",", 1))
    return F.coalesce(F.nullif(first, F.lit("")), address, F.lit("unknown"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970, for timestamps without a zone too."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, ts.cast("timestamp_ntz"))


def decide(times: np.ndarray, log: deque, max_requests: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Admitted flags and seconds to wait (0 if admitted) for ascending ``times``.

    ``log`` holds the admitted times of the window, at most ``max_requests``, and
    is carried on.  When it is full, everything up to the moment its oldest entry
    expires is rejected at once, so a flood costs steps per admission, not per
    request.
    """
    admitted = np.zeros(len(times), dtype=bool)
    retry_after = np.zeros(len(times), dtype=np.int64)
    i = 0
    while i < len(times):
        now = int(times[i])
        while log and log[0] <= now - window:
            log.popleft()
        if len(log) < max_requests:
            admitted[i] = True
            log.append(now)
            i += 1
            continue
        end = int(np.searchsorted(times, log[0] + window, side="left"))
        retry_after[i:end] = (window - (times[i:end] - log[0])) // 1_000_000 + 1
        i = end
    return admitted, retry_after


def decided(rows: pd.DataFrame, admitted: np.ndarray, retry_after: np.ndarray) -> pd.DataFrame:
    """Result rows of decided requests."""
    out = rows[["client", "request_id"]].copy()
    out["admitted"] = admitted
    out["retry_after"] = pd.arrays.IntegerArray(retry_after, admitted.copy())
    return out


def segments(requests: DataFrame, max_requests: int, window: int) -> DataFrame:
    """(client, bucket, segment, busy) of each client's buckets with requests.

    A client has at most one row per bucket here, however many requests it made.
    """
    per_bucket = requests.groupBy("client", "bucket").agg(F.count("*").alias("n"))
    by_client = Window.partitionBy("client").orderBy("bucket")
    adjacent = F.lag("bucket").over(by_client) == F.col("bucket") - 1
    before = F.when(adjacent, F.lag("n").over(by_client)).otherwise(0)
    starts = (F.coalesce(before, F.lit(0)) == 0) | (before + F.col("n") <= max_requests)
    marked = per_bucket.withColumn("start", F.when(starts, F.col("bucket")))
    segment = F.last("start", ignorenulls=True).over(by_client.rowsBetween(Window.unboundedPreceding, 0))
    cut = marked.withColumn("segment", segment)
    total = F.sum("n").over(Window.partitionBy("client", "segment"))
    return cut.select("client", "bucket", "segment", (total > max_requests).alias("busy"))


def admissions(
    requests: DataFrame, max_requests: int = MAX_REQUESTS, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """(client, request_id, admitted, retry_after) of requests (client, request_id, ts)."""
    window = window_seconds * 1_000_000
    timed = requests.select("client", "request_id", micros(F.col("ts")).alias("at"))
    timed = timed.withColumn("bucket", F.floor(F.col("at") / F.lit(window)).cast("long"))
    cut = timed.join(segments(timed, max_requests, window), ["client", "bucket"])

    # Segments with at most max_requests requests admit them all.
    calm = cut.filter(~F.col("busy")).select(
        "client", "request_id", F.lit(True).alias("admitted"), F.lit(None).cast("long").alias("retry_after")
    )
    busy = (
        cut.filter("busy")
        .repartition("client", "segment")
        .sortWithinPartitions("client", "segment", "at", "request_id")
        .select("client", "request_id", "segment", "at")
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, deque()
        for batch in batches:
            if batch.empty:
                continue
            clients, cuts, times = (batch[c].to_numpy() for c in ("client", "segment", "at"))
            starts = np.flatnonzero((clients[1:] != clients[:-1]) | (cuts[1:] != cuts[:-1])) + 1
            parts = []
            for rows in np.split(np.arange(len(batch)), starts):
                if (clients[rows[0]], cuts[rows[0]]) != key:
                    key, log = (clients[rows[0]], cuts[rows[0]]), deque()
                parts.append(decide(times[rows], log, max_requests, window))
            yield decided(batch, *(np.concatenate(column) for column in zip(*parts, strict=True)))

    types = {f.name: f.dataType.simpleString() for f in timed.schema.fields}
    schema = f"client {types['client']}, request_id {types['request_id']}, admitted boolean, retry_after bigint"
    return calm.unionByName(busy.mapInPandas(scan, schema))

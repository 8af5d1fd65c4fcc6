"""Rate limiting of a stream of requests, with the admitted times as state.

A client's state is the list of times that were admitted in the window.  A timer at the
end of the window of the last one drops the state of a client that rests, so the state
follows the clients of the last window and not all that ever came.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.ratelimit import MAX_REQUESTS, WINDOW_SECONDS, decide, decided, micros

LATENESS = "1 minute"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AdmissionLog(StatefulProcessor):
    """Decides the requests of one client."""

    def __init__(self, max_requests: int, window: int):
        self.max_requests, self.window = max_requests, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = deque(int(row[0]) for row in self.log.get())
        batch = pd.concat(list(rows)).sort_values(["at", "request_id"])
        admitted, retry_after = decide(batch["at"].to_numpy(), log, self.max_requests, self.window)
        if log:
            self.log.put([(int(t),) for t in log])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # The first millisecond at which the last admission is out of the window.
            self.handle.registerTimer((max(log) + self.window) // 1_000 + 1)
        yield decided(batch, admitted, retry_after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.log.clear()
        return iter(())

    def close(self) -> None:
        pass


def admit_stream(
    requests: DataFrame, max_requests: int = MAX_REQUESTS, window_seconds: int = WINDOW_SECONDS, lateness: str = LATENESS
) -> DataFrame:
    """(client, request_id, admitted, retry_after) of a stream (client, request_id, ts).

    Requests of one micro-batch are decided in time order; one that comes more than
    ``lateness`` behind the latest request of an earlier batch is no longer decided.
    The state of a client is at most ``max_requests`` times and goes when the client
    rests for a window.  Sets the state store that timers need in the session.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = requests.select("client", "request_id", micros(F.col("ts")).alias("at"))
    timed = timed.withColumn("seen", F.timestamp_micros("at")).withWatermark("seen", lateness)
    types = {f.name: f.dataType.simpleString() for f in timed.schema.fields}
    schema = f"client {types['client']}, request_id {types['request_id']}, admitted boolean, retry_after bigint"
    return timed.groupBy("client").transformWithStateInPandas(
        AdmissionLog(max_requests, window_seconds * 1_000_000), schema, "Append", "EventTime"
    )

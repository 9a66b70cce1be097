"""Attempts at a sequence of steps with a timeout: keyed state with timers on a stream, windows on a table.

Every event of the first kind opens an attempt of its user. It reaches 2 if an event of the second kind follows within
the timeout, and 3 if one of the third kind follows the first such event, still within the timeout of the opening.
Events of a user are ordered by time, then by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "user_id long, event_id long, started long, reached int"
_STATE = "at long, event_id long, kind string"
#: The store that keyed state with timers needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Attempts(StatefulProcessor):
    """Holds each user's events of the three kinds for `within` after their time, by the watermark, and no longer.

    An attempt is closed once the watermark has passed its timeout: no event that could change it is still admitted,
    in whatever order events came. So state is bounded by the events of one timeout and the lateness.
    """

    def __init__(self, steps: tuple[str, str, str], within: timedelta):
        self.steps, self.within = steps, within // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(i), k) for r in rows for t, i, k in r[["at", "event_id", "event_type"]].itertuples(index=False)]
        first = min((t for t, _, _ in self.held.get()), default=None)
        self.held.appendList(new)
        earliest = min(new)[0]
        if first is None or earliest < first:
            self._wake(earliest)
        return iter(())

    def _wake(self, first: int) -> None:
        """A timer for when the first event held runs out; timers are milliseconds, so the next full one."""
        self.handle.registerTimer((first + self.within) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held, now = sorted(self.held.get()), timerValues.getCurrentWatermarkInMs()
        done, closed = 0, []
        while done < len(held) and (held[done][0] + self.within) // 1000 < now:
            t, i, k = held[done]
            done += 1
            if k == self.steps[0]:
                reached, at = 1, done
                while reached < 3 and at < len(held) and held[at][0] <= t + self.within:
                    reached += held[at][2] == self.steps[reached]
                    at += 1
                closed.append((key[0], i, t, reached))
        if done == len(held):
            self.held.clear()
        elif done:
            self.held.put(held[done:])
            self._wake(held[done][0])
        if closed:
            frame = pd.DataFrame(closed, columns=["user_id", "event_id", "started", "reached"])
            yield frame.astype({"user_id": "int64", "event_id": "int64", "started": "int64", "reached": "int32"})

    def close(self) -> None:
        pass


def streamed(events: DataFrame, steps: tuple[str, str, str], within: timedelta, lateness: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, started, reached) of each attempt, once the watermark has passed its timeout.

    Rows without a user, a time or an id change nothing; late rows are dropped as the watermark tells. Start the stream with STORE.
    """
    own = events.where(F.col("event_type").isin(*steps)).dropna(subset=["user_id", "event_id", "ts"]).withWatermark("ts", lateness)
    own = own.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), "event_type")
    closed = own.groupBy("user_id").transformWithStateInPandas(Attempts(steps, within), SCHEMA, "append", "eventTime")
    return closed.withColumn("started", F.timestamp_micros("started"))


def tabled(events: DataFrame, steps: tuple[str, str, str], within: timedelta) -> DataFrame:
    """The same rows of a table, of all attempts, by two windows over one partitioning."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    own = events.where(F.col("event_type").isin(*steps)).dropna(subset=["user_id", "event_id", "ts"])
    third = own.withColumn("third", F.min(F.when(F.col("event_type") == steps[2], F.col("ts"))).over(order))
    second = F.min(F.when(F.col("event_type") == steps[1], F.struct("ts", "event_id", "third"))).over(order)
    limit = F.col("ts") + F.lit(within)
    reached = F.when(F.col("second.third") <= limit, 3).when(F.col("second.ts") <= limit, 2).otherwise(1)
    return third.withColumn("second", second).where(F.col("event_type") == steps[0]).select("user_id", "event_id", F.col("ts").alias("started"), reached.alias("reached"))

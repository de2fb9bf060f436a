"""Absence as an event: a machine that has fallen silent is reported when its time runs out, not when somebody asks.

A beat is answered if the machine's next one comes at most ``limit`` seconds later. If none does, the silence is reported as it becomes certain: when the
watermark has passed the end of that stretch, so that beats that come late, within the watermark's delay, still count. Machines are dealt over buckets by a hash, and a bucket is a
key of the state: it holds the moments whose stretch has not ended, and one timer, so that a micro-batch asks the state a few times for each bucket and not for each machine. Choose
``buckets`` so that what a bucket's machines say in a micro-batch and in ``limit`` fits a task. The session needs the RocksDB state store (``codes.use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COLUMNS = ("agent_id", "last_seen_at", "silent_since")


class Silence(StatefulProcessor):
    """The state of a bucket: its machines' beats, each once, by machine and moment in microseconds."""

    def __init__(self, limit_seconds: int):
        self.limit = limit_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beats = handle.getValueState("beats", "agent_id array<string>, at array<long>")

    def _held(self) -> pd.DataFrame:
        agents, moments = self.beats.get() if self.beats.exists() else ([], [])
        return pd.DataFrame({"agent_id": pd.Series(list(agents), dtype=object), "at": pd.Series(list(moments), dtype="int64")})

    def _keep(self, before: pd.DataFrame, beats: pd.DataFrame) -> None:
        # a timer in milliseconds, never before the stretch of the first beat has ended
        old, new = (-(-(int(x["at"].min()) + self.limit) // 1000) if len(x) else None for x in (before, beats))
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)
        if len(beats):
            self.beats.update((beats["agent_id"].tolist(), beats["at"].tolist()))
        elif len(before):
            self.beats.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat([frame[["agent_id", "at"]] for frame in rows]).dropna(subset=["at"])
        came["at"] = came["at"].astype("datetime64[us]").astype("int64")
        held = self._held()
        self._keep(held, pd.concat([held, came]).drop_duplicates().sort_values(["agent_id", "at"], kind="stable"))
        yield self._told(held.iloc[:0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        over = timerValues.getCurrentWatermarkInMs() * 1000
        agents, at = pd.factorize(held["agent_id"], use_na_sentinel=False)[0], held["at"].to_numpy()
        ended = at + self.limit <= over
        answered = np.zeros(len(held), dtype=bool)
        answered[:-1] = (agents[1:] == agents[:-1]) & (at[1:] <= at[:-1] + self.limit)
        # the timer has fired, and is no more: nothing is to be deleted
        left = held[~ended]
        if len(left):
            self.beats.update((left["agent_id"].tolist(), left["at"].tolist()))
            self.handle.registerTimer(-(-(int(left["at"].min()) + self.limit) // 1000))
        else:
            self.beats.clear()
        yield self._told(held[ended & ~answered])

    def _told(self, beats: pd.DataFrame) -> pd.DataFrame:
        at = pd.to_datetime(beats["at"], unit="us").astype("datetime64[ns]")
        return pd.DataFrame({"agent_id": beats["agent_id"], "last_seen_at": at, "silent_since": at + pd.Timedelta(microseconds=self.limit)})

    def close(self) -> None:
        pass


def silences(beats: DataFrame, limit_seconds: int, delay: str = "10 minutes", buckets: int = 256) -> DataFrame:
    """A stream ``agent_id``, ``at`` to ``agent_id``, ``last_seen_at``, ``silent_since``, a row whenever a machine has said nothing for ``limit_seconds``. Beats without a
    moment are ignored, and later ones than ``delay`` are dropped. A checkpoint holds for one number of ``buckets``."""
    timed = beats.select("agent_id", "at", F.pmod(F.xxhash64("agent_id"), F.lit(buckets)).alias("bucket")).withWatermark("at", delay)
    return timed.groupBy("bucket").transformWithStateInPandas(Silence(limit_seconds), outputStructType="agent_id string, last_seen_at timestamp, silent_since timestamp", outputMode="append", timeMode="eventTime")

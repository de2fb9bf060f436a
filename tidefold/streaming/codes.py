"""One-time codes: minted for a user, valid for a while, consumed once.

A stateful operator. The session needs the RocksDB state store. Commands are rows ``code``, ``kind`` (``mint`` or ``consume``; others are ignored), ``user_id`` (text, of a mint), ``seq``, ``at``. Within
a batch they take effect by ``seq``, so of two that consume one code exactly one wins. Minting creates state and consuming only clears it: a code that has
expired or is used cannot come back by a replayed consume. Codes that nobody consumes go by a timer once the watermark has passed their end, so that
the state holds what can still be consumed; commands later than the watermark's delay are dropped.

Codes are dealt over buckets by a hash, and a bucket is a key of the state with one timer, so that a micro-batch asks the state a few times for each bucket and not for each code. Choose ``buckets`` so
that a bucket's codes that can still be consumed, and its commands in a micro-batch, fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_SECONDS = 600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class CodeStore(StatefulProcessor):
    """The state of a bucket: of each code the user's id as text, and when it expires (by the commands' own clock, in microseconds)."""

    def __init__(self, ttl_seconds: int = TTL_SECONDS):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minted = handle.getValueState("codes", "code array<string>, user_id array<string>, expires array<long>")

    def _held(self) -> pd.DataFrame:
        codes, users, expires = self.minted.get() if self.minted.exists() else ([], [], [])
        return pd.DataFrame({"code": pd.Series(list(codes), dtype=object), "user_id": pd.Series(list(users), dtype=object), "expires": pd.Series(list(expires), dtype="int64")})

    def _keep(self, held: pd.DataFrame, old: int | None) -> None:
        """``old``: the timer that is registered."""
        new = -(-int(held["expires"].min()) // 1000) if len(held) else None
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)
        if len(held):
            self.minted.update(tuple(held[c].tolist() for c in ("code", "user_id", "expires")))
        else:
            self.minted.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        commands = pd.concat([frame[["code", "kind", "user_id", "seq", "at"]] for frame in rows])
        commands = commands[commands["kind"].isin(["mint", "consume"]) & commands["at"].notna()].sort_values("seq", kind="stable")
        held = self._held()
        mint = (commands["kind"] == "mint").to_numpy(dtype=bool)
        now = commands["at"].astype("datetime64[us]").astype("int64").to_numpy()
        n = len(held)
        # what is held stands before the commands of its code, as mints do
        code = pd.concat([held["code"], commands["code"]], ignore_index=True)
        user = pd.concat([held["user_id"], commands["user_id"].astype(object)], ignore_index=True)
        holds = np.concatenate([np.ones(n, dtype=bool), mint])
        ends = np.concatenate([held["expires"].to_numpy(), now + self.ttl])
        order = np.argsort(number := pd.factorize(code, use_na_sentinel=False)[0], kind="stable")
        same = np.zeros(len(order), dtype=bool)
        same[1:] = number[order[1:]] == number[order[:-1]]
        before = np.empty(len(order), dtype=np.int64)
        before[order] = np.where(same, np.concatenate([order[:1], order[:-1]]), -1)
        asks = n + np.flatnonzero(~mint)
        found = before[asks]
        wins = (found >= 0) & holds[found] & (ends[found] > now[asks - n])
        # a value that is no number is burnt and gives nobody
        users = user.take(found).where(wins).astype("string")
        users = users.where(users.str.fullmatch("-?[0-9]+").fillna(False).astype(bool))
        last = order[np.append(~same[1:], True)[: len(order)]]
        last = np.sort(last[holds[last]])
        old = -(-int(held["expires"].min()) // 1000) if n else None
        self._keep(pd.DataFrame({"code": code.to_numpy()[last], "user_id": user.to_numpy()[last], "expires": ends[last]}), old)
        yield pd.DataFrame({"code": code.to_numpy()[asks], "seq": commands["seq"].to_numpy()[asks - n], "user_id": pd.array(users.to_numpy(), dtype="Int64") if len(users) else pd.array([], dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        # the timer has fired, and is no more
        self._keep(held[held["expires"] > timerValues.getCurrentWatermarkInMs() * 1000], None)
        yield pd.DataFrame({c: pd.Series([], dtype=object) for c in ("code", "seq", "user_id")})

    def close(self) -> None:
        pass


def consumed(commands: DataFrame, ttl_seconds: int = TTL_SECONDS, delay: str = "1 day", buckets: int = 256) -> DataFrame:
    """One row for each consume: ``code``, ``seq``, ``user_id`` (null: no such code, used, or expired). A checkpoint holds for one number of ``buckets``."""
    dealt = commands.withColumn("bucket", F.pmod(F.xxhash64("code"), F.lit(buckets))).withWatermark("at", delay)
    return dealt.groupBy("bucket").transformWithStateInPandas(CodeStore(ttl_seconds), outputStructType="code string, seq long, user_id int", outputMode="append", timeMode="eventTime")

"""Known contents, kept by hash: a micro-batch asks which of its hashes are there without reading all that ever came.

Hashes are SHA-256, so their first bits deal them evenly over shards, and no shard is hot. A shard is a folder of small files, one for each batch that added to it,
and has a Bloom filter, kept as Parquet beside it. A batch reads the filters of the shards that its hashes fall in, and opens only shards whose filter
says that a hash may be there: for new contents next to none, for known ones at most as many as there are of them, each of at most about ``capacity``
rows. A batch with more than ``MANY`` hashes a shard opens the shards without asking the filters, of which some would say yes in every shard: it reads at most ``capacity / MANY`` rows for each hash. When shards are full on average, all are dealt anew over four times as many, which reads every row a bounded number of times in all.

One stream writes an index. What batch n wrote is invisible to batch n and to earlier ones, so a batch that runs again sees what it saw the first time and replaces what
it wrote: files by folders of their own for each batch, and filters in two slots, of which the one before stays. The driver sees shard numbers, at most one for
each hash of a batch, and the names of shards; never hashes.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FILTER = "shard int, slot int, batch long, n long, bits binary"
DATA = "sha256 string, shard int, batch long"
#: Hashes of a batch for each shard, beyond which filters are not asked.
MANY = 64


def _positions(hashes: pd.Series, bits: int) -> np.ndarray:
    """Seven places in a filter for each hash; the first 32 bits are left to the shards."""
    words = np.frombuffer(bytes.fromhex("".join(hashes)), dtype=">u4").reshape(-1, 8)[:, 1:]
    return words.astype(np.int64) % bits


class Known:
    """The index under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, capacity: int = 4096, level: int = 4, bits_per_row: int = 12):
        self.spark, self.root, self.capacity, self.level = spark, root.rstrip("/"), capacity, level
        self.bits = -(-capacity * bits_per_row // 64) * 64
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._asked: DataFrame | None = None
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- places ---------------------------------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _generation(self, number: int) -> tuple[str, int]:
        """The folder and level that batch ``number`` works in: the last that was finished for it or an earlier one."""
        made = [n.split("-") for n in self._names(self.root) if n.startswith("g") and n.count("-") == 1]
        fit = [(int(since), int(level[1:])) for level, since in made if int(since) <= number]
        since, level = max(fit, default=(0, self.level))
        return f"{self.root}/g{level:02d}-{since:012d}", level

    def _shard(self, level: int) -> Column:
        first = F.conv(F.substring("sha256", 1, 8), 16, 10).cast("long")
        return F.shiftright(first, 32 - level).cast("int").alias("shard")

    def _read(self, folder: str, kind: str, shards: list[int], number: int) -> DataFrame:
        there = {n for n in self._names(folder) if n.startswith("shard=")}
        paths = [f"{folder}/shard={s}" for s in shards if f"shard={s}" in there]
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", folder).parquet(*paths).filter(F.col("batch") < number)

    def _write(self, df: DataFrame, folder: str, *by: str) -> None:
        df.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)

    # --- what a batch asks ----------------------------------------------------------------------------------------------

    def of(self, hashes: DataFrame, number: int) -> tuple[DataFrame, DataFrame, dict]:
        """For the hashes of batch ``number`` (column ``sha256``; nulls are nobody's): those that earlier batches added, those that are new, each once, and figures. Both frames are
        cached: unpersist them when the batch is done."""
        asked_of, level = self._generation(number)
        asked = hashes.filter(F.col("sha256").isNotNull()).select("sha256", self._shard(level)).distinct().persist()
        self._asked = asked
        counts = {r[0]: r[1] for r in asked.groupBy("shard").count().collect()}
        touched, many = list(counts), sum(counts.values()) > MANY << level
        size = self.bits

        def maybe(key: tuple, mine: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(kept):
                return mine.iloc[:0]
            bits = np.unpackbits(np.frombuffer(kept["bits"].iloc[0], dtype=np.uint8))
            return mine[bits[_positions(mine["sha256"], size)].all(axis=1)]

        if many:
            there = set(self._names(f"{asked_of}/data"))
            hits, opened = asked, [s for s in touched if f"shard={s}" in there]
        else:
            hits = asked.groupBy("shard").cogroup(self._latest(asked_of, touched, number).groupBy("shard")).applyInPandas(maybe, "sha256 string, shard int").persist()
            opened = [r.shard for r in hits.select("shard").distinct().collect()]
        seen = Observation()
        rows = self._read(f"{asked_of}/data", DATA, opened, number).observe(seen, F.count(F.lit(1)).alias("rows"))
        known = rows.join(hits.select("sha256"), "sha256", "left_semi").select("sha256").persist()
        found = known.count()
        new = asked.join(known, "sha256", "left_anti").persist()
        if not many:
            hits.unpersist()
        figures = {"shards": 1 << level, "asked": len(touched), "opened": len(opened), "rows_read": int(seen.get["rows"]) if opened else 0, "known": found}
        return known, new, figures

    def _latest(self, folder: str, shards: list[int], number: int) -> DataFrame:
        rows = self._read(f"{folder}/filters", FILTER, shards, number)
        return rows.groupBy("shard").agg(F.max(F.struct("batch", "slot", "n", "bits")).alias("x")).select("shard", "x.*")

    def add(self, new: DataFrame, number: int, figures: dict | None = None) -> dict:
        """Let later batches know the hashes that ``of`` called new. Gives the figures, with what was added."""
        folder, _ = self._generation(number)
        counts = new.groupBy("shard").count().collect()
        touched, n = [r[0] for r in counts], sum(r[1] for r in counts)
        if n:
            self._write(new.select("sha256", "shard", F.lit(number).cast("long").alias("batch")), f"{folder}/data", "shard", "batch")
            self._write(self._filters(new, self._latest(folder, touched, number), number), f"{folder}/filters", "shard", "slot")
        told = (figures or {}) | {"batch": number, "added": n, "total": self._total(number) + n}
        self._tell(told)
        if self._asked is not None:  # what new was made from
            self._asked.unpersist()
            self._asked = None
        return told

    def _filters(self, new: DataFrame, before: DataFrame, number: int) -> DataFrame:
        size = self.bits

        def merged(key: tuple, mine: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
            if not len(mine):
                return pd.DataFrame({"shard": [], "slot": [], "batch": [], "n": [], "bits": []})
            bits = np.unpackbits(np.frombuffer(kept["bits"].iloc[0], dtype=np.uint8)) if len(kept) else np.zeros(size, dtype=np.uint8)
            bits[_positions(mine["sha256"], size).ravel()] = 1
            slot = 1 - int(kept["slot"].iloc[0]) if len(kept) else 0
            return pd.DataFrame({"shard": [key[0]], "slot": [slot], "batch": [number], "n": [len(mine) + (int(kept["n"].iloc[0]) if len(kept) else 0)], "bits": [np.packbits(bits).tobytes()]})

        return new.select("sha256", "shard").groupBy("shard").cogroup(before.groupBy("shard")).applyInPandas(merged, FILTER)

    # --- growth ---------------------------------------------------------------------------------------------------------

    def grow(self, number: int) -> bool:
        """Before batch ``number``: deal all rows over four times as many shards, if these are full on average. A new generation is made aside and then renamed."""
        folder, level = self._generation(number)
        total, wider = self._total(number), level
        while total > self.capacity << wider and wider < 30:
            wider += 2
        if wider == level:
            return False
        target = f"{self.root}/g{wider:02d}-{number:012d}"
        self._fs.delete(self._path(f"{target}-new"), True)
        rows = self.spark.read.schema(DATA).parquet(f"{folder}/data").filter(F.col("batch") < number).select("sha256", self._shard(wider), F.lit(-1).cast("long").alias("batch"))
        self._write(rows, f"{target}-new/data", "shard", "batch")
        dealt = self.spark.read.schema(DATA).parquet(f"{target}-new/data")
        self._write(self._filters(dealt, self.spark.createDataFrame([], FILTER), -1), f"{target}-new/filters", "shard", "slot")
        self._fs.rename(self._path(f"{target}-new"), self._path(target))
        return True

    # --- figures --------------------------------------------------------------------------------------------------------

    def _tell(self, told: dict) -> None:
        out = self._fs.create(self._path(f"{self.root}/log/{told['batch']:012d}.json"), True)
        try:
            out.write(bytearray((json.dumps(told) + "\n").encode()))
        finally:
            out.close()

    def _total(self, number: int) -> int:
        """Rows that batches before ``number`` added."""
        before = [n for n in self._names(f"{self.root}/log") if n.endswith(".json") and int(n[:-5]) < number]
        if not before:
            return 0
        stream = self._fs.open(self._path(f"{self.root}/log/{max(before)}"))
        try:
            return int(json.loads(bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())["total"])
        finally:
            stream.close()

    def log(self) -> DataFrame:
        """A row for each batch: shards there are, were asked and were opened, rows read in them, hashes known and added, and all rows so far."""
        return self.spark.read.schema("batch long, shards long, asked long, opened long, rows_read long, known long, added long, total long").json(f"{self.root}/log")

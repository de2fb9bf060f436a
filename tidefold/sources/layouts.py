"""Tables laid out for the way they are read: by key in buckets, so that lookups open one file and joins need no exchange; by order in ranges, so that a page opens only the
files that hold it, at any depth.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = "file string, before long, rows long"


# --- by key ------------------------------------------------------------------------------------------------------------


def _by_buckets(spark: SparkSession) -> None:
    """Spark would read a table without regard to its buckets where no join or aggregate asks for them; a lookup does."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")


def write_keyed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` under ``path`` in ``buckets`` files by the hash of ``key``, each sorted by it, and give the table. Choose buckets so that one fits a task; tables that are to be
    joined by this key take the same number."""
    name = f"keyed_{uuid.uuid4().hex}"
    spark = df.sparkSession
    _by_buckets(spark)
    # the exchange deals rows as the buckets do: one file a bucket
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def read_keyed(spark: SparkSession, path: str, key: str, buckets: int, columns: str) -> DataFrame:
    """The table of another session's ``write_keyed``; files tell their bucket by name. ``columns`` as DDL."""
    name = f"keyed_{uuid.uuid4().hex}"
    _by_buckets(spark)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


# --- by order ----------------------------------------------------------------------------------------------------------


@dataclass
class Ranged:
    """Files in the order of ``order``, each sorted, with the rows before it. A page of ``limit`` rows opens the files that hold it and no others."""

    spark: SparkSession
    path: str
    order: list[Column]
    counts: list[tuple[str, int, int]]

    @property
    def total(self) -> int:
        return sum(rows for _, _, rows in self.counts)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in the order."""
        held = [(file, before) for file, before, rows in self.counts if before < offset + limit and before + rows > offset]
        kind = self.spark.read.parquet(self.path).schema if not held else None
        if not held:
            return self.spark.createDataFrame([], kind)
        read = self.spark.read.parquet(*(f"{self.path}/{file}" for file, _ in held))
        return read.orderBy(*self.order).offset(offset - held[0][1]).limit(limit)


def write_ranged(df: DataFrame, path: str, order: list[Column], files: int) -> Ranged:
    """Write ``df`` in ``files`` ranges of ``order``, which must end with a key, so that every row has one place. Spark cuts the ranges by a sample, so that they are about even."""
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(path)
    spark = df.sparkSession
    # a task's file is named by its range; one row a file comes to the driver
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows")).collect()
    counts, before = [], 0
    for file, n in sorted((r.file, r.rows) for r in rows):
        counts.append((file, before, n))
        before += n
    spark.createDataFrame(counts, COUNTS).coalesce(1).write.parquet(f"{path}/_counts")
    return Ranged(spark, path, order, counts)


def read_ranged(spark: SparkSession, path: str, order: list[Column]) -> Ranged:
    """What an earlier ``write_ranged`` left."""
    rows = spark.read.schema(COUNTS).parquet(f"{path}/_counts").collect()
    return Ranged(spark, path, order, sorted((r.file, r.before, r.rows) for r in rows))

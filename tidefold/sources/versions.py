"""Tables as versions: every change writes a new folder and then names it, so that no plan reads what it overwrites. What streams only add to
is kept as one folder for each micro-batch instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.schemas import schema


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """The finished versions of a table, in order; Spark marks a finished write."""
    fs, p, path = _files(spark, f"{root}/{name}")
    if not fs.exists(p):
        return []
    found = [x.getPath() for x in fs.listStatus(p) if x.isDirectory() and x.getPath().getName().startswith("v")]
    return sorted(int(x.getName()[1:]) for x in found if fs.exists(path(x, "_SUCCESS")))


def read_version(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A version, by default the last; an empty table before the first."""
    have = versions(spark, root, name)
    if not have:
        return spark.createDataFrame([], schema(name))
    return spark.read.schema(schema(name)).parquet(f"{root}/{name}/v{have[-1] if version is None else version:08d}")


def write_batch(df: DataFrame, root: str, name: str, stream: str, number: int) -> None:
    """Write what micro-batch ``number`` of a stream adds to a table; written again, it replaces what it wrote before."""
    columns = [F.col(f.name).cast(f.dataType) for f in schema(name)]
    df.select(*columns).write.mode("overwrite").parquet(f"{root}/{name}/b-{stream}-{number:012d}")


def read_batches(spark: SparkSession, root: str, name: str, stream: str = "", before: int | None = None) -> DataFrame:
    """All finished batches of a table; with ``before``, of ``stream`` only those with lower numbers, so that a batch that runs again sees what
    it saw the first time."""
    fs, p, _ = _files(spark, f"{root}/{name}")
    found = [x.getPath() for x in fs.listStatus(p) if x.isDirectory() and x.getPath().getName().startswith("b-")] if fs.exists(p) else []
    mine = f"b-{stream}-"
    finished = _finished(spark, f"{root}/{name}")
    wanted = [str(x) for x in found if x.getName() in finished and (before is None or not x.getName().startswith(mine) or int(x.getName()[len(mine) :]) < before)]
    return spark.read.schema(schema(name)).parquet(*wanted) if wanted else spark.createDataFrame([], schema(name))


def _finished(spark: SparkSession, root: str) -> set[str]:
    """The folders under ``root`` whose write was finished: one listing by pattern, however many there are."""
    fs, p, _ = _files(spark, f"{root}/b-*/_SUCCESS")
    return {x.getPath().getParent().getName() for x in fs.globStatus(p) or []}


def write_version(df: DataFrame, root: str, name: str) -> int:
    """Write the next version; gives its number. One writer a table."""
    spark = df.sparkSession
    number = (versions(spark, root, name) or [0])[-1] + 1
    columns = [F.col(f.name).cast(f.dataType) for f in schema(name)]
    df.select(*columns).write.mode("overwrite").parquet(f"{root}/{name}/v{number:08d}")
    return number

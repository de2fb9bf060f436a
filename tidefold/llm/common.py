"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space; everything else belongs to words. ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """The UTF-8 words of a text, in order (null: none)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint
    folder. Where neither is set a temporary one serves, but only on a local master; on a cluster that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidefold-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, so that later steps and lost executors
    neither recompute it nor hold its lineage. The table goes when the driver ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    path = f"{shared_folder(spark)}/{context.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)  # when the driver ends
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after its session is told to pass at most 4 MB of rows at once to Python: texts are long, and a batch stands in the
    JVM, in Arrow and in Python at the same time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def map_rows(
    df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], columns: list[str], schema: str, rows_per_batch: int = 2000
) -> DataFrame:
    """``make()`` runs once a task and gives a function from the values of ``columns`` to output rows; Arrow
    carries both sides. Output batches end after ``rows_per_batch`` rows or about 8 MB of text."""
    spark = df.sparkSession
    struct = spark.createDataFrame([], schema).schema

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, out, size = make(), [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # a few Python objects at a time
                part = batch.slice(start, 256)
                for values in zip(*(part.column(k).to_pylist() for k in range(part.num_columns))):
                    for row in f(*values):
                        out.append(row)
                        size += sum(x.nbytes if isinstance(x, np.ndarray) else len(x) for x in row if isinstance(x, (str, bytes, list, np.ndarray)))
                        if len(out) >= rows_per_batch or size > 8_000_000:
                            yield flush()
                            out, size = [], 0
        if out:
            yield flush()

    return bounded(df).select(*columns).mapInArrow(run, struct)


def plain(name: str) -> str:
    """A column name quoted for use in expressions."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        made = f"__{name}"
        while made.lower() in taken:
            made += "_"
        taken.add(made.lower())
        out.append(made)
    return out

"""Upload events: each new content is announced once.

Delivery is at least once: a batch that is run again after a failure is computed against the tables as they were before it and replaces what it
wrote, so that files and uploads are the same and its events are announced again, under the same hash and batch number. The service itself may
lose events; this may not.

Which contents are known is asked of an index by hash (``sources.keyed``), and an upload's number is its place in its micro-batch after that batch's number: no
micro-batch reads what earlier ones wrote but the few shards that may hold its hashes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidefold.functions import scalars as X
from tidefold.operators.uploads import MAX_BYTES, upload
from tidefold.schemas import CONTENT_TYPES, schema
from tidefold.sources.blobs import Files, qualified, store, with_bodies
from tidefold.sources.keyed import Known
from tidefold.sources.versions import write_batch

#: Numbers of uploads that a micro-batch has for itself.
EACH = 1 << 32


def ingest_stream(uploads: DataFrame, root: str, checkpoint: str, events_path: str, archive: str | None = None, capacity: int = 4096) -> StreamingQuery:
    """Run M20 over a stream of uploads (the columns of ``operators.uploads.upload``'s batch): every micro-batch adds to the tables ``files`` and ``uploads``
    under ``root`` (``sources.versions.read_batches``) and to the index of contents there, of ``capacity`` rows a shard, stores new contents under ``archive`` if that is
    given, and last writes its events to ``events_path``. One stream a root."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = Known(spark, f"{root}/contents", capacity)
        index.grow(number)
        batch = batch.withColumn("sha256", X.sha256_hex("content")).persist()
        none = [spark.createDataFrame([], schema(name)) for name in ("files", "uploads")]
        kinds = F.coalesce("content_type", F.lit("match-log")).isin(*CONTENT_TYPES)
        accepted = batch.filter(kinds & (F.octet_length("content") <= MAX_BYTES))
        known, new, figures = index.of(accepted, number)
        change = upload(*none, batch, known=known, first_id=number * EACH + 1, cached=True)
        if archive is not None:
            store(change.tables["blobs"], archive).write.format("noop").mode("overwrite").save()
        write_batch(change.tables["new_files"], root, "files", stream, number)
        write_batch(change.tables["new_uploads"], root, "uploads", stream, number)
        change.tables["events"].write.mode("overwrite").json(f"{events_path}/stream={stream}/batch={number}")
        index.add(new, number, figures)
        for df in (change.values["rows"], known, new, batch):
            df.unpersist()

    return uploads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def archive_stream(spark: SparkSession, root: str) -> DataFrame:
    """Files that arrive in the raw archive: ``path``, ``sha256``, ``content``. What is in them is not defined, so nothing is parsed here. Every trigger lists the archive by tasks, and the names that came before are
    state of the stream, dealt over the executors: the driver holds none. Give it the RocksDB state store (``codes.use_rocksdb``), and a trigger with an interval."""
    spark.dataSource.register(Files)
    names = spark.readStream.format("archive_files").option("path", root).option("top", qualified(spark, root)).load()
    return with_bodies(names.dropDuplicates(["path"])).select("path", F.sha2("content", 256).alias("sha256"), "content")


def new_contents(events: DataFrame, keep: str = "30 days") -> DataFrame:
    """A stream of uploads (``sha256``, ``uploaded_at``) to the first of each hash; hashes are remembered for ``keep`` past the watermark, which bounds the state."""
    return events.withWatermark("uploaded_at", keep).dropDuplicatesWithinWatermark(["sha256"])


def parse_events(raw: DataFrame, topic: str, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON payloads of a topic, beside the columns ``keep`` of the message; unknown fields are ignored, missing ones null, malformed payloads give nulls throughout."""
    return raw.select(F.from_json(F.col(column).cast("string"), schema(topic)).alias("e"), *keep).select(*keep, "e.*")


def publish(df: DataFrame, topic: str) -> DataFrame:
    """Rows as ``topic``, ``value``: what a message sink takes."""
    return df.select(F.lit(topic).alias("topic"), F.to_json(F.struct(*df.columns)).alias("value"))

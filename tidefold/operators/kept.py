"""Aggregates that are kept up: every batch adds its own partial aggregates, and nobody reads the uploads of earlier batches again.

The partials of a machine are counts, latest moments and a sketch of its contents, which merge in any order (HyperLogLog of Apache DataSketches, built into Spark; with 2^12 registers its
estimates have a standard error of about 1.6 %). Beside them stands an exact table, the different contents of each machine. Both go into a ``sources.snapshots.Store``
together, under the batch's mark, so that a batch that runs again counts once.

Answers are kept, too, with the number of the snapshot that they were made from: as long as nothing was added they are read, not computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.sources.snapshots import Store

KEY = ["user_email", "machine_name"]
#: Two to this power registers a sketch.
PRECISION = 12


def partials(uploads: DataFrame) -> DataFrame:
    """Of ``user_email``, ``machine_name``, ``sha256``, ``uploaded_at``: a row for each machine."""
    return uploads.groupBy(*KEY).agg(F.count(F.lit(1)).alias("uploads"), F.max("uploaded_at").alias("last_upload"), F.hll_sketch_agg("sha256", F.lit(PRECISION)).alias("contents"))


def merged(rows: DataFrame) -> DataFrame:
    """Partials of several batches as one row for each machine."""
    return rows.groupBy(*KEY).agg(F.sum("uploads").alias("uploads"), F.max("last_upload").alias("last_upload"), F.hll_union_agg("contents").alias("contents"))


class Devices:
    """Uploads, different contents and the latest moment of each machine, kept up in a store."""

    def __init__(self, store: Store, stream: str = "devices"):
        self.store, self.stream = store, stream

    def add(self, uploads: DataFrame, number: int) -> int:
        """Batch ``number``. The batch is read twice: persist what is dear to compute."""
        base = self.store.snapshot()
        return self.store.change(base, append={"device_partials": partials(uploads), "device_contents": uploads.select(*KEY, "sha256").distinct()}, mark=(self.stream, number))

    def estimates(self) -> DataFrame:
        """The merged partials: ``files`` is the sketch's estimate. Kept until something is added."""
        base = self.store.snapshot()
        name = "device_answers"
        # an answer's folder is entered with the mark of the state that it answers for
        if base.marks.get("device_answers of", -1) == base.marks.get(self.stream, -1) and name in base.folders:
            return base.read(name)
        made = merged(base.read("device_partials")).withColumn("files", F.hll_sketch_estimate("contents").cast("long")).drop("contents")
        self.store.change(base, {name: made}, mark=("device_answers of", base.marks.get(self.stream, -1)))
        return self.store.snapshot().read(name)

    def exact(self) -> DataFrame:
        """The same with ``files`` from the exact table."""
        base = self.store.snapshot()
        files = base.read("device_contents").groupBy(*KEY).agg(F.count_distinct("sha256").alias("files"))
        counts = base.read("device_partials").groupBy(*KEY).agg(F.sum("uploads").alias("uploads"), F.max("last_upload").alias("last_upload"))
        return counts.join(files, KEY)

    def roll_up(self) -> int:
        """One row a machine and one a content, in place of the batches' rows; answers stay as they are."""
        base = self.store.snapshot()
        return self.store.change(base, {"device_partials": merged(base.read("device_partials")), "device_contents": base.read("device_contents").distinct()})

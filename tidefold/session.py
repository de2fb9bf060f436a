"""Session factory: UTC, ANSI, AQE with skew handling; sizes come from the caller's cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

#: Settings that the results rely on (time zone) or that help at every size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # beyond so many rows a page is sorted over ranges instead of being held by every task
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def get_spark(app: str = "tidefold", master: str | None = None, **more: str) -> SparkSession:
    """The active session, or a new one with SETTINGS; ``more`` (dots as ``__``) is added to them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir`` or the context's checkpoint folder; it goes when the driver
    ends. Only a local master may do without either."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidefold-")
    path = f"{base.rstrip('/')}/{context.applicationId}/{name}-{uuid.uuid4().hex}"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_tidefold_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tidefold-"), "tidefold.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tidefold", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._tidefold_shipped = True

"""Uploads: content-addressed files, attribution of every upload, and events for content that is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.functions import scalars as X
from tidefold.operators.transitions import Change, appended, arrival, numbered
from tidefold.schemas import CONTENT_TYPES

MAX_BYTES = 104_857_600


def first_of_content(df: DataFrame, content: str, *order: str) -> DataFrame:
    """W1: of rows with equal content (by hash), the first in the order, which must end with a key."""
    return marked_repeats(df, content, *order).filter("NOT deduped").drop("deduped")


def marked_repeats(df: DataFrame, content: str, *order: str) -> DataFrame:
    """All rows with ``sha256`` and ``deduped``: whether an earlier row has the content. ``order`` must end with a key. The first of each hash is a
    pre-aggregated minimum, so that no hash is sorted in one task."""
    return _marked(df.withColumn("sha256", X.sha256_hex(content)), *order)


def _marked(hashed: DataFrame, *order: str) -> DataFrame:
    first = hashed.groupBy(F.col("sha256").alias("__sha")).agg(F.min(F.struct(*order)).alias("__first"))
    joined = hashed.join(first, F.col("sha256").eqNullSafe(F.col("__sha")))
    return joined.withColumn("deduped", ~F.struct(*order).eqNullSafe(F.col("__first"))).drop("__sha", "__first")


def latest(df: DataFrame, key: str, at: str, *also: str) -> DataFrame:
    """W2: the latest moment of each key, and other columns as of then (of equal moments the greatest value); partial aggregates meet, no sort."""
    return df.groupBy(key).agg(F.max(at).alias(at), *(F.max_by(c, F.when(F.col(at).isNotNull(), F.struct(at, c))).alias(c) for c in also))


def upload(files: DataFrame, uploads: DataFrame, batch: DataFrame, max_bytes: int = MAX_BYTES, known: DataFrame | None = None, first_id: int | None = None, cached: bool = False) -> Change:
    """M20. ``batch``: seq, content (bytes), content_type (null: match-log), original_filename, user_id, agent_registration_id, uploaded_at.

    Each hash is stored once, with the first upload's type and path; every upload is attributed. Refused: no content, too large, unknown type. ``tables`` hold
    files, uploads, what is new of both (``new_files``, ``new_uploads``), ``blobs`` (path and content to store) and ``events`` (``file.ingested``, one for each new
    hash); outcomes are seq, code, sha256, deduped, upload_id. Contents meet nothing but their own ``seq``: whatever is compared or counted goes without them. ``known``: the hashes of
    the batch that are stored already, where an index says so (``sources.keyed``), and ``first_id``: the first number of an upload; without them both are looked for in the
    tables. A batch may bring its contents' ``sha256``. With ``cached`` the accepted rows, without their contents, are persisted, and are ``values["rows"]``."""
    kind = F.coalesce("content_type", F.lit("match-log"))
    size = F.octet_length("content").cast("long")
    seen = batch.withColumn("content_type", kind).withColumn("size_bytes", size).withColumn(
        "code", F.when(F.col("content").isNull(), "missing_file").when(F.col("size_bytes") > max_bytes, "file_too_large").when(~kind.isin(*CONTENT_TYPES), "invalid_content_type").otherwise("ok")
    )
    good = seen.filter("code = 'ok'").withColumn("sha256", F.col("sha256") if "sha256" in batch.columns else X.sha256_hex("content")).drop("content")
    known = (files if known is None else known).select(F.col("sha256").alias("__known"))
    ranked = _marked(good, "uploaded_at", "seq").join(known, F.col("sha256") == F.col("__known"), "left").withColumn("deduped", F.col("deduped") | F.col("__known").isNotNull()).drop("__known")
    start = int(uploads.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) if first_id is None else first_id - 1
    rows = numbered(ranked, arrival(good), "seq").withColumn("id", F.col("number") + start)
    rows = rows.persist() if cached else rows
    new = (rows if cached else ranked).filter("NOT deduped").withColumn("storage_path", X.shard_path("sha256", X.file_extension("content_type", "original_filename")))
    events = new.withColumn("__iso", X.iso_format("uploaded_at")).select(
        F.lit("file.ingested").alias("topic"), "sha256",
        F.to_json(F.struct("sha256", "user_id", "agent_registration_id", F.col("__iso").alias("uploaded_at"), "content_type")).alias("payload"),
    )
    outcomes = seen.filter("code <> 'ok'").select("seq", "code", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("boolean").alias("deduped"), F.lit(None).cast("long").alias("upload_id")).union(
        rows.select("seq", "code", "sha256", "deduped", F.col("id").cast("long"))
    )
    new_files, new_uploads = appended(files.limit(0), new.withColumn("first_uploaded_at", F.col("uploaded_at"))), appended(uploads.limit(0), rows)
    bodies = batch.select(F.col("seq").alias("__seq"), "content")
    tables = {
        "files": files.union(new_files),
        "uploads": uploads.union(new_uploads),
        "new_files": new_files,
        "new_uploads": new_uploads,
        "blobs": new.join(bodies, F.col("seq") == F.col("__seq")).select(F.col("storage_path").alias("path"), "content"),
        "events": events,
    }
    return Change(tables, outcomes, values={"rows": rows})


def attribution_counts(uploads: DataFrame, key: str = "sha256", user: str = "user_id") -> DataFrame:
    """Uploads and different users of each content."""
    return uploads.groupBy(key).agg(F.count(F.lit(1)).alias("uploads"), F.count_distinct(user).alias("users"))

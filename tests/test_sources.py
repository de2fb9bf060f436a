"""Versions, the raw archive and tables."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tidefold.schemas import schema
from tidefold.sources import blobs, versions
from tidefold.sources.tables import table


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    assert versions.read_version(spark, root, "settings").isEmpty()
    now = datetime(2024, 1, 1)
    one = spark.createDataFrame([("a", '"open"', now, 1)], schema("settings"))
    assert versions.write_version(one, root, "settings") == 1
    both = versions.read_version(spark, root, "settings").union(spark.createDataFrame([("b", "1", now, None)], schema("settings")))
    assert versions.write_version(both, root, "settings") == 2  # reads version 1 while version 2 is written
    assert versions.read_version(spark, root, "settings").count() == 2 and versions.read_version(spark, root, "settings", 1).count() == 1


def test_archive(spark, tmp_path):
    data = [b"one", b"two" * 50_000, b"three"]
    rows = [(f"{(h := hashlib.sha256(d).hexdigest())[:2]}/{h[2:4]}/{h}.dat", d) for d in data]
    df = spark.createDataFrame(rows, "path string, content binary")
    root = str(tmp_path / "raw")
    assert [r.written for r in blobs.store(df, root).collect()] == [True] * 3
    assert [r.written for r in blobs.store(df, root).collect()] == [False] * 3
    (tmp_path / "raw/none.dat").touch()
    (tmp_path / "raw/ab").mkdir(exist_ok=True)
    (tmp_path / "raw/ab/none.dat").touch()
    read = blobs.read_bodies(spark, root, 1000).collect()
    assert sorted((r.sha256, bytes(r.content)) for r in read if r.code == "ok") == sorted([(hashlib.sha256(d).hexdigest(), d) for d in data if len(d) <= 1000] + [(hashlib.sha256(b"").hexdigest(), b"")] * 2)
    large = [r for r in read if r.code != "ok"]
    assert [(r.code, r.size_bytes, r.sha256, r.content) for r in large] == [("file_too_large", 150_000, None, None)] and len({r.path.rsplit(":")[0] for r in read}) == 1
    assert {r.path for r in blobs.stored_paths(spark, root).collect()} == {p for p, _ in rows}
    parts = blobs.chunks(df.select(F.sha2("content", 256).alias("sha256"), "content")).orderBy("sha256", "index").collect()
    for d in data:
        assert b"".join(bytes(r.chunk) for r in parts if r.sha256 == hashlib.sha256(d).hexdigest()) == d
    assert max(len(r.chunk) for r in parts) == blobs.CHUNK


def test_the_driver_holds_no_name_of_a_file(spark, tmp_path):
    """Tasks list and read the archive; hidden names and files under way are passed over."""
    for name in ("top.dat", "ab/cd/x.dat", "ab/cd/.y.dat.part", "ab/_no/z.dat", ".no/z.dat"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    read, paths = blobs.read_bodies(spark, str(tmp_path)), blobs.listed(spark, str(tmp_path))
    assert not read.inputFiles() and not paths.inputFiles()
    want = {f"file:{tmp_path}/{name}" for name in ("top.dat", "ab/cd/x.dat")}
    assert {r.path for r in paths.collect()} == {r.path for r in read.collect()} == want
    assert {r.path: bytes(r.content) for r in blobs.with_bodies(paths).collect()} == {r.path: bytes(r.content) for r in read.collect()}


def test_tasks_do_not_grow_with_the_files(spark, tmp_path):
    """What tasks send to the driver goes by their number: more files in as many folders take no more of them, however small a split may be."""
    context = spark.sparkContext

    def tasks(group):
        context.setJobGroup(group, group)
        try:
            found = blobs.read_bodies(spark, str(tmp_path)).filter("code = 'ok'").count()
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        tracker = context.statusTracker()
        stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
        return found, sum(tracker.getStageInfo(i).numTasks for i in stages)

    def put(names):
        for folder in range(40):
            (tmp_path / f"{folder:02x}/00").mkdir(parents=True, exist_ok=True)
            for name in names:
                (tmp_path / f"{folder:02x}/00/{name}.dat").write_bytes(b"one")

    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        put(range(2))
        few = tasks("few files")
        put(range(12))
        many = tasks("many files")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (few[0], many[0]) == (80, 480) and many[1] == few[1]


def test_joins_do_not_send_files_through_the_driver(spark, tmp_path):
    (tmp_path / "x.dat").write_bytes(b"one")
    hashes = spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(),)], "sha256 string").repartition(2)
    for read, key in ((blobs.read_bodies(spark, str(tmp_path)).select("sha256", F.md5("content").alias("body")), "sha256"), (blobs.listed(spark, str(tmp_path)), "path")):
        met = hashes.withColumnRenamed("sha256", key).join(read, key)
        assert len(met.collect()) == (key == "sha256")
        plan = met._jdf.queryExecution().executedPlan().toString()  # as adaptive execution left it
        assert "isFinalPlan=true" in plan and "Broadcast" not in plan.split("Initial Plan")[0]


def test_tables(spark):
    with pytest.raises(ValueError):
        table(spark, "/nowhere", "secrets")

"""Paged listings in batch and as a stream."""

import json

import pytest
from pyspark.sql import functions as F
from tidefold.sources import paged

KINDS = "id int, email string, role string, disabled boolean, must_change_password boolean, created_at string"


@pytest.fixture
def root(spark, tmp_path):
    paged.register(spark)
    rows = [(k, f"u{k}@x.org", "user", k % 2 == 0, False, "2024-05-01T14:00:00+02:00" if k % 3 else "soon") for k in range(95, -1, -1)]
    df = spark.createDataFrame(rows, KINDS).withColumn("page", F.floor(F.col("id") / 10))
    assert paged.write_pages(df, "users", str(tmp_path / "pages"), "page") == 10
    return str(tmp_path / "pages")


def listed(spark, root):
    return spark.read.format("listing").option("path", root).option("listing", "users").load()


def test_batch_and_stream_agree(spark, root, tmp_path):
    rows = sorted(map(tuple, listed(spark, root).collect()))
    assert [r[0] for r in rows] == list(range(96)) and rows[1][5].isoformat() == "2024-05-01T12:00:00" and rows[0][5] is None
    stream = spark.readStream.format("listing").option("path", root).option("listing", "users").load()

    def run():
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(map(tuple, spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()))

    assert run() == rows
    # another page: only its items come
    with open(f"{root}/page-000000010.json", "w") as f:
        json.dump({"users": [{"id": 100, "email": "new@x.org", "unknown": 1}]}, f)
    with open(f"{root}/page-000000011.json", "w") as f:
        f.write("no json")
    assert [r for r in run() if r not in rows] == [(100, "new@x.org", None, None, None, None)]


def test_conditions_on_the_key_open_their_pages_only(spark, root):
    df = listed(spark, root)
    parts = lambda x: x.rdd.getNumPartitions()
    assert parts(df) == 10
    for condition, pages, n in (("id = 42", 1, 1), ("id IN (3, 4, 77)", 2, 3), ("id >= 80 AND id < 90", 1, 10), ("id > 89", 1, 6), ("id < 0", 1, 0), ("id <= 10", 2, 11), ("email = 'u5@x.org'", 10, 1), ("id = 42 AND disabled", 1, 1)):
        found = df.filter(condition)
        assert (parts(found), found.count()) == (pages, n), condition


def test_nothing_there(spark, tmp_path):
    paged.register(spark)
    assert listed(spark, str(tmp_path / "none")).count() == 0


def test_many_pages_share_tasks(spark, tmp_path):
    """Of many pages a task reads a run, and looks into the index before it opens one."""
    paged.register(spark)
    items = spark.range(3000).select(F.col("id").cast("int"), F.lit("e").alias("email"), F.lit("user").alias("role"), F.lit(False).alias("disabled"), F.lit(False).alias("must_change_password"), F.lit(None).cast("string").alias("created_at"), F.floor(F.col("id") / 10).alias("page"))
    root = str(tmp_path / "many")
    assert paged.write_pages(items, "users", root, "page") == 300
    with open(f"{root}/page-000000007.json", "w") as f:
        f.write('{"users": [{"id": 123}]}')  # the index says 70 to 79: this page is not opened for 123
    df = listed(spark, root)
    assert df.rdd.getNumPartitions() == 19 and df.count() == 2991
    assert df.filter("id >= 120 AND id < 130").count() == 10 and df.filter("id = 2999").count() == 1
    pages = [f for p in paged.runs([f"page-{k}" for k in range(100_000)]) for f in p.files]
    assert len(pages) == 100_000 and pages == [f"page-{k}" for k in range(100_000)] and len(paged.runs(pages)) == paged.TASKS

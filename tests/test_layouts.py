"""Layouts: what a lookup and a page open, and joins without exchange."""

import random

import pytest
from pyspark.sql import functions as F
from tidefold.functions import predicates as P
from tidefold.sources.layouts import read_keyed, read_ranged, write_keyed, write_ranged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_lookup_opens_one_bucket(spark, tmp_path):
    agents = spark.range(1000).select(F.col("id"), F.sha2(F.concat(F.lit("token"), "id"), 256).alias("api_token_hash"))
    table = write_keyed(agents, str(tmp_path / "agents"), "api_token_hash", 8)
    found = table.filter(P.secret_is("api_token_hash", "token77"))
    assert "SelectedBucketsCount: 1 out of 8" in plan(found) and [r.id for r in found.collect()] == [77]
    again = read_keyed(spark, str(tmp_path / "agents"), "api_token_hash", 8, "id long, api_token_hash string")
    found = again.filter(P.secret_is("api_token_hash", "token78"))
    assert "SelectedBucketsCount: 1 out of 8" in plan(found) and [r.id for r in found.collect()] == [78]
    assert len([p for p in (tmp_path / "agents").iterdir() if p.name.endswith(".parquet")]) == 8


def test_joins_without_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        users = write_keyed(spark.range(100).select(F.col("id").alias("user_id"), (F.col("id") % 2 == 0).alias("disabled")), str(tmp_path / "users"), "user_id", 8)
        sessions = write_keyed(spark.range(1000).select(F.col("id"), (F.col("id") % 120).alias("user_id")), str(tmp_path / "sessions"), "user_id", 8)
        both = sessions.join(users, "user_id")
        assert "Exchange" not in plan(both) and both.count() == sum(k % 120 < 100 for k in range(1000))
        # only the requests are dealt anew, to the sessions' buckets
        hashed = write_keyed(spark.range(1000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("hash")), str(tmp_path / "hashes"), "hash", 8)
        asks = spark.range(5).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
        met = hashed.join(asks, "hash")
        assert plan(met).count("Exchange hashpartitioning") == 1 and met.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rows", [0, 1, 1000])
def test_pages_of_ranges(spark, tmp_path, rows):
    rng = random.Random(rows)
    data = [(k, rng.choice([None, *range(20)])) for k in range(rows)]
    df = spark.createDataFrame(data, "id long, at int")
    order = [F.col("at").desc_nulls_first(), F.col("id").asc()]
    laid = write_ranged(df, str(tmp_path / "t"), order, 10)
    want = sorted(data, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert laid.total == rows
    for source in (laid, read_ranged(spark, str(tmp_path / "t"), order)):
        for offset in (0, 7, 95, 500, 960, 999, 5000):
            page = source.page(50, offset)
            assert [tuple(r) for r in page.collect()] == want[offset : offset + 50]
            assert len(page.inputFiles()) <= 2

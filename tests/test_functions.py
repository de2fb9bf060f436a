"""Scalars, predicates, paging and listings."""

from datetime import datetime, timedelta
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F
from tidefold.functions import scalars as X
from tidefold.operators import paging
from tidefold.sources.listings import decoded


def values(spark, column, *texts, kind="string"):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], f"k int, x {kind}")
    return [r.v for r in rows.select("k", column.alias("v")).orderBy("k").collect()]


def test_text(spark):
    assert values(spark, X.stripped("x"), "  a b\t", "  a　", "\n", None) == ["a b", "a", "", None]
    assert values(spark, X.clean_email("x"), " A@X.c ", "  ", None) == ["a@x.c", None, None]
    assert values(spark, X.bearer_token("x"), "Bearer abc", "bearer  x ", "Bearer ", "Basic x", None) == ["abc", "x", None, None, None]
    assert values(spark, X.client_ip("x", F.lit("peer")), " 1.2.3.4 , 5.6.7.8", "", None, "::1") == ["1.2.3.4", "peer", "peer", "::1"]
    assert values(spark, X.uuid_or_null("x"), "6F9619FF-8B86-D011-B42D-00CF4FC964FF", "nope", None) == ["6f9619ff-8b86-d011-b42d-00cf4fc964ff", None, None]
    names = ["game.log", ".hidden", "a.tar.gz", "dir.x/file", "plain", "dot.", "..a.b", "x/.b.c", None, ""]
    assert values(spark, X.file_suffix("x"), *names) == [None if n is None else PurePosixPath(n).suffix for n in names]
    assert values(spark, X.file_extension("x", F.lit("game.log")), "unknown", "match-log", "decklist", "else", None) == [".log", ".dat", ".xml", ".bin", ".bin"]
    assert values(spark, X.shard_path("x", ".dat"), "abcdef") == ["ab/cd/abcdef.dat"]
    assert values(spark, X.registration_mode("x"), '"open"', '"invite_only"', '"other"', "open", "7", "{}", None, ' "open" ') == ["open", "invite_only", "invite_only", "invite_only", "invite_only", "invite_only", "invite_only", "open"]
    codes = values(spark, X.random_code(), "a", "b")
    assert all(len(c) == 9 and c[4] == "-" and set(c) <= set(X.CODE_LETTERS + "-") for c in codes)


def test_time(spark):
    at = datetime(2024, 5, 1, 12)
    ages = [at - timedelta(hours=h) for h in (0, 1, 23, 24, 47, 48)] + [at - timedelta(minutes=59), at + timedelta(minutes=1), None]
    assert values(spark, X.age("x", at), *ages, kind="timestamp") == ["0h", "1h", "23h", "1d", "1d", "2d", "0h", "-1h", None]
    moments = [at, at.replace(microsecond=120), None]
    assert values(spark, X.iso_format("x"), *moments, kind="timestamp") == ["2024-05-01T12:00:00+00:00", "2024-05-01T12:00:00.000120+00:00", None]
    assert values(spark, X.parse_iso("x"), "2024-05-01T12:00:00Z", "2024-05-01T14:00:00+02:00", "", "soon", None, "2024-05-01T12:00:00.000120+00:00") == [at, at, None, None, None, moments[1]]


def test_paging(spark):
    df = spark.createDataFrame([(k, k // 2) for k in range(5)], "id int, at int")
    assert [[r.id for r in paging.newest(df, "at", "id", 2, paging.page_offset(p, 2)).collect()] for p in (1, 2, 3)] == [[4, 3], [2, 1], [0]]
    pages = paging.envelope(df, "id", limit=2, offset=4)
    assert [r.id for r in pages.items.collect()] == [4] and pages.total.first().total == 5
    info = [paging.page_info(pages.total, p, 2).first() for p in (1, 3, 4)]
    assert [(i.first_index, i.last_index, i.has_prev, i.has_next) for i in info] == [(1, 2, False, True), (5, 5, True, False), (0, 0, False, False)]
    assert paging.page_info(paging.total(df.limit(1)), 1).first().label == "1 row"
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            paging.page(df, "id", **bad)
    with pytest.raises(ValueError):
        paging.page_offset(0)


def test_listings(spark):
    bodies = ['{"agents": [{"agent_id": "a", "user_id": 1, "created_at": "2024-05-01T12:00:00Z", "last_seen_at": "bad", "more": 1}, {"agent_id": "b"}]}', '{"agents": [{"agent_id": "c"}], "total": 7}', "no json", '{"agents": []}']
    got = {r.agent_id: r for r in decoded(spark.createDataFrame([(b,) for b in bodies], "body string"), "agents").collect()}
    assert {k: r.total for k, r in got.items()} == {"a": 2, "b": 2, "c": 7}
    assert got["a"].created_at == datetime(2024, 5, 1, 12) and got["a"].last_seen_at is None

"""Streams run to their end over small folders."""

import json
import time
from datetime import datetime

from tidefold.schemas import schema
from tidefold.sources.versions import read_batches
from tidefold.streaming import codes, heartbeats, uploads

UPLOADS = "seq int, content binary, content_type string, original_filename string, user_id int, agent_registration_id string, uploaded_at timestamp"
NOW = datetime(2024, 5, 1, 12)


def rows_of(spark, query_name):
    return [tuple(r) for r in spark.table(query_name).collect()]


def test_uploads_announce_new_contents_once(spark, tmp_path):
    source = str(tmp_path / "in")
    for k, body in enumerate([b"one", b"one", b"two"]):
        spark.createDataFrame([(k, body, "match-log", None, k, "a", NOW)], UPLOADS).coalesce(1).write.mode("append").parquet(source)
    for more in (None, b"two"):
        if more:
            spark.createDataFrame([(9, more, "decklist", None, 9, "a", NOW)], UPLOADS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(UPLOADS).option("maxFilesPerTrigger", 1).parquet(source)
        query = uploads.ingest_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "e"), str(tmp_path / "raw"))
        assert query.awaitTermination(120)
    tables = lambda: [sorted(map(tuple, read_batches(spark, str(tmp_path / "t"), n).collect()), key=str) for n in ("uploads", "files")]
    events = lambda: sorted(r.payload for r in spark.read.json(str(tmp_path / "e")).collect())
    before = tables(), events()
    assert [len(x) for x in before[0]] == [4, 2] and sorted(x.read_bytes() for x in (tmp_path / "raw").glob("*/*/*.dat")) == [b"one", b"two"]
    # the last batch runs again, as after a failure before its commit
    last = max((tmp_path / "c/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    assert uploads.ingest_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "e"), str(tmp_path / "raw")).awaitTermination(120)
    assert (tables(), events()) == before
    said = [json.loads(p) for p in events()]
    assert sorted(x["user_id"] for x in said) in ([0, 2], [1, 2]) and all(x["content_type"] == "match-log" for x in said)


def test_events(spark):
    raw = spark.createDataFrame([('{"sha256": "a", "user_id": 3, "new": 1}',), ("{}",), ("broken",)], "value string")
    got = uploads.parse_events(raw, "file.ingested").collect()
    assert [r.user_id for r in got] == [3, None, None] and got[0].sha256 == "a"
    out = uploads.publish(spark.createDataFrame([("m", "r")], "match_id string, request_id string"), "insight.requested").first()
    assert json.loads(out.value) == {"match_id": "m", "request_id": "r"} and out.topic == "insight.requested"
    assert set(schema("match.parsed").names) == {"match_id", "user_id", "game_count", "parsed_at"}


def test_codes(spark, tmp_path):
    codes.use_rocksdb(spark)
    kinds = "code string, kind string, user_id string, seq long, at timestamp"
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s)
    batches = [
        [("A", "mint", "7", 1, at(0)), ("B", "mint", "8", 2, at(0)), ("C", "mint", "x", 3, at(0)), ("A", "consume", None, 4, at(1)), ("A", "consume", None, 5, at(1)), ("Z", "consume", None, 6, at(1))],
        [("B", "consume", None, 7, at(600)), ("C", "consume", None, 8, at(10)), ("A", "consume", None, 9, at(10)), ("D", "mint", "9", 10, at(700))],
        [("D", "consume", None, 11, at(1299)), ("C", "consume", None, 12, at(11)), ("F", "mint", "1", 13, at(5))],
        [("G", "mint", "1", 14, at(200_000))],
        [("G", "mint", "1", 15, at(200_001))],
    ]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files in the order of their times
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source)
    query = codes.consumed(stream).writeStream.format("memory").queryName("codes").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    # F, which nobody consumed, went when the watermark passed its end; G is there
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    assert {s: u for _, s, u in rows_of(spark, "codes")} == {4: 7, 5: None, 6: None, 7: None, 8: None, 9: None, 11: 9, 12: None}


def test_heartbeats(spark, tmp_path):
    kinds = "agent_id string, at timestamp, client_version string"
    source = str(tmp_path / "in")
    for rows in ([("a", NOW, "1"), ("b", NOW, None), ("gone", NOW, "1")], [("a", NOW.replace(hour=13), None), ("a", NOW.replace(hour=11), "0")], [("b", NOW.replace(hour=14), "2")]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    agents = spark.createDataFrame([(i, 1, "pc", i, NOW, None, NOW if i == "gone" else None, None) for i in ("a", "b", "gone")], schema("agents"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source)
    beats = heartbeats.latest_beats(heartbeats.accepted(stream, agents))
    query = beats.writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    last = {}
    for agent, seen, version in rows_of(spark, "beats"):
        if agent not in last or seen >= last[agent][0]:
            last[agent] = (seen, version)
    assert last == {"a": (NOW.replace(hour=13), "1"), "b": (NOW.replace(hour=14), "2")}


def test_remembered_contents(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("x", NOW), ("x", NOW.replace(hour=13)), ("y", NOW)], "sha256 string, uploaded_at timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("sha256 string, uploaded_at timestamp").parquet(source)
    query = uploads.new_contents(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r[0] for r in rows_of(spark, "firsts")) == ["x", "y"]


def test_archive_stream(spark, tmp_path):
    (tmp_path / "raw/ab/cd").mkdir(parents=True)
    (tmp_path / "raw/ab/cd/x.dat").write_bytes(b"one")
    query = uploads.archive_stream(spark, str(tmp_path / "raw")).writeStream.format("memory").queryName("archive").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [r[1] for r in rows_of(spark, "archive")] == ["7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed"]


def test_archive_stream_keeps_names_in_its_state(spark, tmp_path):
    """A file comes once over several runs, and what came before is state of the stream, not the driver's."""
    codes.use_rocksdb(spark)
    (tmp_path / "raw/ab/cd").mkdir(parents=True)

    def run():
        query = uploads.archive_stream(spark, str(tmp_path / "raw")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return query.lastProgress["stateOperators"][0]["numRowsTotal"], sorted(bytes(r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "raw/ab/cd/x.dat").write_bytes(b"one")
    assert run() == (1, [b"one"])
    (tmp_path / "raw/ab/cd/y.dat").write_bytes(b"two")
    (tmp_path / "raw/z.dat").write_bytes(b"")
    assert run() == (3, [b"", b"one", b"two"])

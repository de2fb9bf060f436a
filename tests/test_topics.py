"""Two topics that meet, and machines that fall silent, over streams with late and odd messages."""

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tidefold.streaming import codes, silence, topics
from tidefold.streaming.progress import Figures

NOW = datetime(2024, 5, 1, 12)
MIN = timedelta(minutes=1)


def streamed(spark, folder, batches, kinds):
    """Each list of rows a micro-batch, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{folder}/b={k}")
        for name in os.listdir(f"{folder}/b={k}"):
            os.utime(f"{folder}/b={k}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(f"{kinds}, b int").option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, folder, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", folder).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return query


def parsed(match, at, games=1):
    return ("match.parsed", json.dumps({"match_id": match, "user_id": "u", "game_count": games, "parsed_at": at.isoformat() + "+00:00"}), at)


def asked(match, request, at):
    return ("insight.requested", json.dumps({"match_id": match, "user_id": "u", "request_id": request, "unknown": 1}), at)


def test_requests_meet_matches(spark, tmp_path):
    """Either may come first, in another micro-batch, and late within the delay; who meets nobody comes out once it is certain."""
    end = NOW + timedelta(days=30)
    batches = [
        [asked("m1", "first", NOW), parsed("m2", NOW, 2), asked("m3", "never", NOW), ("match.parsed", "no json", NOW), ("insight.requested", "no json", NOW), asked(None, "no match", NOW)],
        [parsed("m1", NOW + 59 * MIN, 5), asked("m2", "second", NOW + 60 * MIN), asked("m2", "too late", NOW + 61 * MIN)],
        [parsed("m2", NOW + 55 * MIN, 7)],  # late, but not by more than the delay
        [parsed("end", end), asked("end", "end", end)],
    ]
    stream = streamed(spark, str(tmp_path / "in"), batches, "topic string, value string, at timestamp")
    query = run(topics.insights(topics.requests_of(stream), topics.matches_of(stream)), str(tmp_path / "c"), "insights")
    got = sorted(((r.request_id, r.game_count) for r in spark.table("insights").collect() if r.request_id != "end"), key=str)
    assert got == sorted([("first", 5), ("never", None), (None, None), ("no match", None), ("second", 2), ("second", 7), ("too late", 7)], key=str)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # what can meet nobody any more has left the state


def test_insights_of_tables(spark):
    """The same over tables, at once."""
    rows = spark.createDataFrame([parsed("m", NOW), asked("m", "a", NOW + 10 * MIN), asked("m", "b", NOW + 70 * MIN)], "topic string, value string, at timestamp")
    got = topics.insights(topics.requests_of(rows), topics.matches_of(rows))
    assert sorted((r.request_id, r.game_count) for r in got.collect()) == [("a", 1), ("b", None)]


def silent(rows, limit):
    out = []
    for agent in {r[0] for r in rows}:
        at = sorted({r[1] for r in rows if r[0] == agent and r[1]})
        out += [(agent, a) for a, b in zip(at, [*at[1:], None]) if b is None or b > a + limit]
    return sorted(out)


def test_silence_is_reported_when_time_runs_out(spark, tmp_path):
    beat = lambda agent, minutes: (agent, NOW + minutes * MIN)
    batches = [
        [beat("a", 0), beat("a", 5), beat("a", 5), beat("b", 0), (None, NOW), ("c", None)],
        [beat("a", 20), beat("b", 10)],  # a was silent from 5 to 20; b just made it
        [beat("b", 29), beat("a", 28)],
        [beat("b", 20)],  # late, but in time: without it b would have been silent
        [beat("a", 38), beat("b", 90)],
        [("end", NOW + timedelta(days=9))],
    ]
    codes.use_rocksdb(spark)
    stream = streamed(spark, str(tmp_path / "in"), batches, "agent_id string, at timestamp")
    query = run(silence.silences(stream.filter("agent_id IS NOT NULL"), 600), str(tmp_path / "c"), "silences")
    got = sorted((r.agent_id, r.last_seen_at) for r in spark.table("silences").collect())
    assert got == silent([r for b in batches for r in b if r[0] not in (None, "end")], 10 * MIN)
    assert ("b", NOW + 10 * MIN) not in got and all(r.silent_since == r.last_seen_at + 10 * MIN for r in spark.table("silences").collect())
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # the last machine's beat and its timer


def test_figures_of_a_stream(spark, tmp_path):
    """Counts that a stream's own passes take."""
    listener = Figures()
    spark.streams.addListener(listener)
    try:
        stream = streamed(spark, str(tmp_path / "in"), [[(1,), (2,)], [(3,)], [(None,)]], "n int")
        run(stream.observe("beats", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n").isNull()).alias("empty")), str(tmp_path / "c"), "figures")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert (listener.total("beats", "rows"), listener.total("beats", "empty"), listener.batches("beats")) == (4, 1, 3)
    finally:
        spark.streams.removeListener(listener)


def test_silence_asks_the_state_by_buckets(spark, tmp_path):
    """Many machines share a bucket: the state has a row for each bucket, and the answer is the same."""
    codes.use_rocksdb(spark)
    batches = [[(f"m{k}", NOW + (7 * k % 11 + 30 * b) * MIN) for k in range(60)] for b in range(2)]
    stream = streamed(spark, str(tmp_path / "in"), [*batches, [("end", NOW + timedelta(days=9))]], "agent_id string, at timestamp")
    query = run(silence.silences(stream, 600, buckets=3), str(tmp_path / "c"), "bucketed")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 6
    assert sorted((r.agent_id, r.last_seen_at) for r in spark.table("bucketed").collect()) == silent(sum(batches, []), 10 * MIN)


def test_codes_ask_the_state_by_buckets(spark, tmp_path):
    """Codes whose end is no whole millisecond leave the state, too; a null code is a code."""
    codes.use_rocksdb(spark)
    odd = timedelta(microseconds=123_456)
    mints = [(f"c{k}", "mint", str(k), k, NOW + odd) for k in range(50)] + [(None, "mint", "7", 50, NOW)]
    uses = [(f"c{k}", "consume", None, 100 + k, NOW + k * MIN) for k in range(0, 50, 2)] + [(None, "consume", None, 200, NOW + MIN), ("c0", "consume", None, 201, NOW + MIN)]
    batches = [mints, uses, [("z", "mint", "1", 300, NOW + timedelta(days=9))], [("z", "mint", "1", 301, NOW + timedelta(days=9))]]
    stream = streamed(spark, str(tmp_path / "in"), batches, "code string, kind string, user_id string, seq long, at timestamp")
    query = run(codes.consumed(stream, 600, buckets=3), str(tmp_path / "c"), "coded")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 6 and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    want = {100 + k: k if k * MIN < 10 * MIN + odd else None for k in range(0, 50, 2)} | {200: 7, 201: None}
    assert {r.seq: r.user_id for r in spark.table("coded").collect()} == want

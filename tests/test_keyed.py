"""The index of known contents: what it answers, how much it reads, and what a batch that runs again does."""

import hashlib
import random

import pytest
from tidefold.sources.keyed import Known


def sha(k):
    return hashlib.sha256(str(k).encode()).hexdigest()


def run(index, spark, number, keys):
    index.grow(number)
    known, new, figures = index.of(spark.createDataFrame([(sha(k),) for k in keys] + [(None,)], "sha256 string"), number)
    got = {r.sha256 for r in known.collect()}, {r.sha256 for r in new.collect()}
    return *got, index.add(new, number, figures)


def test_against_a_set(spark, tmp_path):
    """Batches with repeats inside and across; shards split on the way; the last batch runs twice."""
    rng, index, seen = random.Random(1), Known(spark, str(tmp_path / "i"), capacity=8, level=1), set()
    for number in range(6):
        keys = [rng.randrange(120) for _ in range(40)]
        for _ in range(2 if number in (0, 3, 5) else 1):
            known, new, told = run(index, spark, number, keys)
            assert known == {sha(k) for k in keys if k in seen} and new == {sha(k) for k in keys if k not in seen}
            assert told["known"] == len(known) and told["added"] == len(new)
        seen |= set(keys)
        assert told["total"] == len(seen)
    assert told["shards"] > 2
    assert [r.batch for r in index.log().orderBy("batch").collect()] == list(range(6))


def test_reads_do_not_grow(spark, tmp_path):
    """Every batch brings 60 new hashes and asks for four old ones: what it reads is bounded by these four shards, however much there is."""
    index, read = Known(spark, str(tmp_path / "i"), capacity=32, level=2), []
    for number in range(8):
        keys = [*range(60 * number, 60 * number + 60), *(range(4) if number else ())]
        known, new, told = run(index, spark, number, keys)
        assert len(known) == (4 if number else 0) and len(new) == 60
        read.append((told["rows_read"], told["opened"], told["total"]))
    assert all(opened <= 10 and rows <= opened * 64 for rows, opened, _ in read) and read[-1][2] == 480
    assert max(r[0] for r in read[5:]) <= 2 * max(r[0] for r in read[1:4]) + 64


@pytest.mark.parametrize("rows", [[], [(None,)]])
def test_empty(spark, tmp_path, rows):
    index = Known(spark, str(tmp_path / "i"))
    known, new, figures = index.of(spark.createDataFrame(rows, "sha256 string"), 0)
    assert known.count() == new.count() == 0 and index.add(new, 0, figures)["total"] == 0


def test_a_batch_that_died_half_way_leaves_no_trace(spark, tmp_path, monkeypatch):
    index = Known(spark, str(tmp_path / "i"), capacity=8, level=1)
    run(index, spark, 0, range(20))
    monkeypatch.setattr(Known, "_filters", lambda *a: (_ for _ in ()).throw(RuntimeError("power cut")))
    with pytest.raises(RuntimeError):
        run(index, spark, 1, range(10, 30))
    monkeypatch.undo()
    known, new, told = run(index, spark, 1, range(10, 30))
    assert known == {sha(k) for k in range(10, 20)} and new == {sha(k) for k in range(20, 30)} and told["total"] == 30


def test_large_batches_ask_no_filter(spark, tmp_path, monkeypatch):
    """A batch of many hashes a shard opens the shards at once, with the same answer, and leaves nothing cached but what it gives."""
    index = Known(spark, str(tmp_path / "i"), capacity=1000, level=1)
    run(index, spark, 0, range(200))
    monkeypatch.setattr(Known, "_latest", lambda *a: (_ for _ in ()).throw(RuntimeError("a filter was read")))
    known, new, figures = index.of(spark.createDataFrame([(sha(k),) for k in range(100, 400)], "sha256 string"), 1)
    assert {r.sha256 for r in known.collect()} == {sha(k) for k in range(100, 200)} and {r.sha256 for r in new.collect()} == {sha(k) for k in range(200, 400)}
    assert figures["opened"] == 2 and figures["rows_read"] == 200
    monkeypatch.undo()
    asked = index._asked
    assert index.add(new, 1, figures)["total"] == 400 and not asked.is_cached


def test_large_first_batch(spark, tmp_path):
    index = Known(spark, str(tmp_path / "i"), capacity=1000, level=1)
    known, new, told = run(index, spark, 0, range(300))
    assert not known and len(new) == 300 and (told["opened"], told["rows_read"], told["total"]) == (0, 0, 300)

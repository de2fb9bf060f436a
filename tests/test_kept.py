"""Aggregates that are kept up equal those of one run over everything."""

import random
from datetime import datetime, timedelta

import pytest
from tidefold.operators import stats
from tidefold.operators.kept import Devices
from tidefold.sources.snapshots import Store

NOW = datetime(2024, 5, 1)
KINDS = "user_email string, machine_name string, sha256 string, uploaded_at timestamp"


def rows_of(df):
    return {(r.user_email, r.machine_name): (r.uploads, r.files, r.last_upload) for r in df.collect()}


def test_batches_equal_one_run(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(f"u{rng.randrange(3)}", rng.choice(["pc", "mac", None]), f"s{rng.randrange(40)}", NOW + timedelta(minutes=rng.randrange(999))) for _ in range(60)] for _ in range(4)]
    kept = Devices(Store(spark, str(tmp_path / "db")))
    for k, rows in enumerate(batches):
        for _ in range(2 if k == 2 else 1):  # one runs again
            kept.add(spark.createDataFrame(rows, KINDS), k)
    everything = spark.createDataFrame([r for b in batches for r in b], KINDS)
    want = rows_of(stats.device_counts(everything))
    exact = {k: v for k, v in rows_of(kept.exact()).items() if k[1]}
    assert exact == {k: v for k, v in want.items() if k[1]}
    told = rows_of(kept.estimates())
    assert told.keys() == want.keys() and all(told[k][0] == want[k][0] and told[k][2] == want[k][2] and abs(told[k][1] - want[k][1]) <= 1 for k in want)


def test_answers_are_kept_until_something_is_added(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    kept = Devices(store)
    kept.add(spark.createDataFrame([("u", "pc", "a", NOW)], KINDS), 0)
    first, number = rows_of(kept.estimates()), store.snapshot().number
    assert rows_of(kept.estimates()) == first and store.snapshot().number == number  # nothing was made anew
    kept.add(spark.createDataFrame([("u", "pc", "b", NOW), ("u", "pc", "a", NOW)], KINDS), 1)
    assert rows_of(kept.estimates()) == {("u", "pc"): (3, 2, NOW)} and store.snapshot().number > number
    kept.roll_up()
    assert rows_of(kept.estimates()) == rows_of(kept.exact()) == {("u", "pc"): (3, 2, NOW)}
    assert store.snapshot().read("device_partials").count() == 1 and store.snapshot().read("device_contents").count() == 2


def test_the_sketch_is_close(spark):
    """Within five standard errors for tens of thousands of contents, in parts that merge."""
    from pyspark.sql import functions as F
    from tidefold.operators.kept import merged, partials

    part = lambda a, b: partials(spark.range(a, b).select(F.lit("u").alias("user_email"), F.lit("m").alias("machine_name"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.lit(NOW).alias("uploaded_at")))
    both = merged(part(0, 30_000).union(part(20_000, 50_000))).select(F.hll_sketch_estimate("contents")).first()[0]
    assert both == pytest.approx(50_000, rel=0.08)

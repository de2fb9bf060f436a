"""Commands in rows: refused arguments; cuts of the win rate."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tidefold.operators import stats
from tidefold.schemas import broken_arguments, check_any, check_limits, check_text


def test_broken_arguments_agree_with_the_checks_of_one_command(spark):
    """Every row is judged as a single command would be."""
    rows = [(k, n, t, a, b) for k, (n, t, a, b) in enumerate([(1, "x", 1, None), (0, "x", None, None), (200, "", None, True), (201, "y" * 5, 1, True), (None, None, None, None), (7, "y" * 6, None, False), (7, "ß" * 5, 0, None)])]
    df = spark.createDataFrame(rows, "k int, n int, t string, a int, b boolean")
    got = {r.k: r.broken for r in broken_arguments(df, {"n": (1, 200)}, {"t": (1, 5)}, ("a", "b")).collect()}

    def refused(call):
        try:
            call()
        except ValueError:
            return True
        return False

    for k, n, t, a, b in rows:
        want = [name for name, call in (("n", lambda: check_limits(n=(n, 1, 200))), ("t", lambda: check_text("t", t, 1, 5)), ("any of a, b", lambda: check_any(a=a, b=b))) if refused(call)]
        assert got.get(k, []) == want
    assert broken_arguments(df).count() == 0 and broken_arguments(df.limit(0), {"n": (1, 2)}).count() == 0


def test_cuts_by_one_shuffle(spark):
    at = datetime(2024, 5, 1, 12)
    rows = [("m", 1, "o", None, "league", "a", "b", at, True), ("m2", 1, None, "std", "league", "a", "b", at, None), ("m3", 2, "o", "std", None, "a", "c", at.replace(day=9), False)]
    df = spark.createDataFrame(rows, "match_id string, user_id int, opponent string, format string, event_type string, archetype_played string, archetype_faced string, played_at timestamp, won boolean")
    made = stats.cuts(df, [("user_id",), ("since", "format"), ()], "1 week")
    got = {(r.cut, r.user_id, r.format): (r.games, r.wins, r.undecided, r.win_rate) for r in made.collect()}
    assert got[("", None, None)] == (3, 1, 1, 0.5) and got[("user_id", 1, None)] == (2, 1, 1, 1.0)
    # a null that is a value is told apart from a column that is not part of the cut
    assert got[("since,format", None, None)] == (1, 1, 0, 1.0) and sum(c == "since,format" for c, _, _ in got) == 2
    assert made.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert made.filter("cut = 'user_id'").agg(F.sum("games")).first()[0] == 3
    for bad in ([("colour",)], [("since",)]):
        with pytest.raises(ValueError):
            stats.cuts(df, bad)

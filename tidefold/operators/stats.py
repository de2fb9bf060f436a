"""Statistics over matches, and device cuts. These are an extension: the service declares them and has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("archetype_played", "archetype_faced", "format", "event_type", "opponent")


def rates(df: DataFrame, won: str | Column, *dimensions: str) -> DataFrame:
    """Games, wins and win rate; games with an unknown outcome are counted apart and not part of the rate (null without any)."""
    w = F.col(won) if isinstance(won, str) else won
    return df.groupBy(*dimensions).agg(
        F.count(F.lit(1)).alias("games"), F.count_if(w).alias("wins"), F.count_if(w.isNull()).alias("undecided"), F.avg(w.cast("int")).alias("win_rate")
    )


def win_rates(matches: DataFrame, *dimensions: str, user_id: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Win rates by some of DIMENSIONS, of one user or all, from ``since`` until before ``until``; both reach the scan."""
    if unknown := set(dimensions) - {*DIMENSIONS, "user_id"}:
        raise ValueError(f"unknown dimensions: {sorted(unknown)}")
    for condition in (
        None if user_id is None else F.col("user_id") == user_id, None if since is None else F.col("played_at") >= F.lit(since).cast("timestamp"), None if until is None else F.col("played_at") < F.lit(until).cast("timestamp")
    ):
        matches = matches if condition is None else matches.filter(condition)
    return rates(matches, "won", *dimensions)


def cuts(matches: DataFrame, sets: list[tuple[str, ...]], window: str | None = None) -> DataFrame:
    """The win rates of several cuts from one pass and one shuffle: each of ``sets`` names some of DIMENSIONS, user_id and ``since``, where a stretch of ``window`` begins. ``cut`` names the
    columns that a row is cut by; the others are null there."""
    columns = [c for c in ("since", "user_id", *DIMENSIONS) if any(c in s for s in sets)]
    if unknown := {c for s in sets for c in s} - set(columns):
        raise ValueError(f"unknown dimensions: {sorted(unknown)}")
    if "since" in columns:
        if window is None:
            raise ValueError("a cut by time needs a window")
        matches = matches.withColumn("since", F.window("played_at", window)["start"])
    w = F.col("won")
    names = F.concat_ws(",", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in columns))
    return matches.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        names.alias("cut"), F.count(F.lit(1)).alias("games"), F.count_if(w).alias("wins"), F.count_if(w.isNull()).alias("undecided"), F.avg(w.cast("int")).alias("win_rate")
    )


def device_counts(attributed: DataFrame) -> DataFrame:
    """Uploads, different contents and the latest moment of each machine of an owner."""
    return attributed.groupBy("user_email", "machine_name").agg(F.count(F.lit(1)).alias("uploads"), F.count_distinct("sha256").alias("files"), F.max("uploaded_at").alias("last_upload"))

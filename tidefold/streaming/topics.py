"""Consumers of two topics: a request for insight meets the parsed match that it is about.

Neither topic waits for the other, and messages come late. Both sides carry a watermark, and a request meets only matches parsed within a stretch of time around it,
so that Spark can drop from its state what nothing can meet any more. A request that met nothing comes out without a match once that is certain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.functions import scalars as X
from tidefold.streaming.uploads import parse_events


def matches_of(messages: DataFrame) -> DataFrame:
    """``match.parsed`` from ``topic``, ``value``: match_id, user_id, game_count, parsed_at. Messages without a match or a moment can meet nobody and are left out."""
    said = parse_events(messages.filter("topic = 'match.parsed'"), "match.parsed").withColumn("parsed_at", X.parse_iso("parsed_at"))
    return said.filter("match_id IS NOT NULL AND parsed_at IS NOT NULL")


def requests_of(messages: DataFrame, at: str = "at") -> DataFrame:
    """``insight.requested`` from ``topic``, ``value`` and the message's moment: requested_at, match_id, user_id, request_id."""
    return parse_events(messages.filter("topic = 'insight.requested'"), "insight.requested", keep=(at,)).withColumnRenamed(at, "requested_at")


def insights(requests: DataFrame, matches: DataFrame, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Each request with each match of its id parsed up to ``within`` before or after it; without any, once with nulls. Streams or tables. ``delay`` is how late messages may be;
    a request without a match id meets nobody."""
    r = requests.withWatermark("requested_at", delay)
    m = matches.withWatermark("parsed_at", delay).select(F.col("match_id").alias("__match"), "game_count", "parsed_at")
    stretch = F.expr(f"INTERVAL {within}")
    near = (F.col("match_id") == F.col("__match")) & (F.col("parsed_at") >= F.col("requested_at") - stretch) & (F.col("parsed_at") <= F.col("requested_at") + stretch)
    return r.join(m, near, "left_outer").drop("__match")

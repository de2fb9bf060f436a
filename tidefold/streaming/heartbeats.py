"""The last sign of life of each agent, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accepted(beats: DataFrame, agents: DataFrame) -> DataFrame:
    """Beats of agents that are known and not revoked: a join of the stream with a table."""
    live = agents.filter(F.col("revoked_at").isNull()).select(F.col("id").alias("agent_id"))
    return beats.join(live, "agent_id", "left_semi") if not beats.isStreaming else beats.join(live, "agent_id")


def latest_beats(beats: DataFrame) -> DataFrame:
    """A stream ``agent_id``, ``at``, ``client_version`` to the latest moment and the latest version that was given, whenever they change."""

    def keep(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, said, version = state.get if state.exists else (None, None, None)
        before = (seen, said, version)
        for frame in rows:
            top = frame["at"].max()
            seen = top if seen is None else max(pd.Timestamp(seen), top)
            with_version = frame[frame["client_version"].notna()]
            if len(with_version):
                row = with_version.loc[with_version["at"].idxmax()]
                if said is None or row["at"] >= pd.Timestamp(said):
                    said, version = row["at"], row["client_version"]
        if (seen, said, version) != before:
            state.update((seen, said, version))
            yield pd.DataFrame({"agent_id": [key[0]], "last_seen_at": [seen], "client_version": [version]})

    return beats.groupBy("agent_id").applyInPandasWithState(
        keep, "agent_id string, last_seen_at timestamp, client_version string", "seen timestamp, said timestamp, version string", "update", GroupStateTimeout.NoTimeout
    )

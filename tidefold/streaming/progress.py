"""What streams count while they run: observed figures of each micro-batch, without a pass of their own."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql.streaming import StreamingQueryListener


class Figures(StreamingQueryListener):
    """Keeps the figures that ``DataFrame.observe(name, ...)`` gives in streams, by name: the last of every micro-batch, so that one that runs again counts once."""

    def __init__(self) -> None:
        self._rows: dict[str, dict[tuple[str, int], dict[str, object]]] = defaultdict(dict)
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            for name, row in p.observedMetrics.items():
                self._rows[name][str(p.id), p.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def total(self, name: str, figure: str) -> int:
        with self._lock:
            return sum(row[figure] or 0 for row in self._rows[name].values())

    def batches(self, name: str) -> int:
        with self._lock:
            return len(self._rows[name])

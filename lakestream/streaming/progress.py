"""What streams report while they run: rows read, rows dropped as late, and observed metrics, summed over all batches."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Sums over every batch of the queries of a session, however many there are."""

    def __init__(self):
        self.rows_read, self.rows_dropped, self.observed = 0, 0, Counter()
        self._ended, self._changed = set(), threading.Condition()

    def onQueryStarted(self, event):  # noqa: N802 - Spark's name
        pass

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        progress = event.progress
        self.rows_read += progress.numInputRows
        self.rows_dropped += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        for name, row in progress.observedMetrics.items():
            for metric, value in row.asDict().items():
                self.observed[f"{name}.{metric}"] += value or 0

    def onQueryTerminated(self, event):  # noqa: N802
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Reports arrive in order, so all of a query's are in once its end is."""
        with self._changed:
            if not self._changed.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError("the end of the query was not reported")


@contextmanager
def watched(session: SparkSession) -> Iterator[Progress]:
    progress = Progress()
    session.streams.addListener(progress)
    try:
        yield progress
    finally:
        session.streams.removeListener(progress)


def metered(stream: DataFrame, name: str, metrics: dict[str, Column]) -> DataFrame:
    """Count ``metrics`` (aggregates) on the rows that pass here, in the batch's own job."""
    return stream.observe(name, *[column.alias(metric) for metric, column in metrics.items()])

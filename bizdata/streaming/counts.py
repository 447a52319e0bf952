"""Counts of what a running stream has read (R-02, R-06)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def observed(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """The stream with its number of rows, and further counts, observed under `name` in every batch."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])


def totals(run: StreamingQuery, name: str) -> dict[str, int]:
    """The observed counts of a stream summed over the batches it remembers (spark.sql.streaming.numRecentProgressUpdates)."""
    out: dict[str, int] = {}
    for progress in run.recentProgress:
        row = progress.observedMetrics.get(name)
        for key, value in (row.asDict() if row is not None else {}).items():
            out[key] = out.get(key, 0) + (value or 0)
    return out


class Counts(StreamingQueryListener):
    """Observed counts of all streams of a session, summed by name over all their batches; `spark.streams.addListener(Counts())`."""

    def __init__(self) -> None:
        self.sums: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            kept = self.sums.setdefault(name, {})
            for key, value in row.asDict().items():
                kept[key] = kept.get(key, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

"""Progress of a running job, reported to a callback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = ("total", "completed", "failed")


def _metrics():
    ok = F.col("success")
    return [F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed")]


def observed(results: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Results that count themselves while an action reads them; ``observation.get`` has the totals after it."""
    observation = Observation(name)
    return results.observe(observation, *_metrics()), observation


def observed_stream(results: DataFrame, name: str = "progress") -> DataFrame:
    """A stream of results that reports its totals with every batch."""
    return results.observe(name, *_metrics())


class ProgressListener(StreamingQueryListener):
    """Calls ``on_progress(total, completed, failed)`` with the totals so far after every batch."""

    def __init__(self, on_progress: Callable[[int, int, int], None], name: str = "progress"):
        self.on_progress = on_progress
        self.name = name
        self.totals = dict.fromkeys(METRICS, 0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            for m in METRICS:
                self.totals[m] += row[m]
            self.on_progress(*[self.totals[m] for m in METRICS])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

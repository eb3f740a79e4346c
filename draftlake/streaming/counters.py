"""Counters of a running stream, without a second scan of its events."""

from __future__ import annotations

import time
from collections import Counter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from draftlake.streaming import events as ev

# ---------------------------------------------------------------- fixed values
OTHER = "other"
METRIC = "events by topic"
WAIT_S = 60.0
# ---------------------------------------------------------- end of fixed values


def topics() -> list[str]:
    """Every event type the library knows."""
    return sorted({*ev.STATUS_BY_EVENT, *(t for pair in ev.STAGES.values() for t in pair)})


def counted(events: DataFrame) -> DataFrame:
    """``events`` unchanged; each micro-batch reports its events by type, those of other types together."""
    names = topics()
    known = F.coalesce(F.col("event_type").isin(names), F.lit(False))
    one = [F.count_if(F.col("event_type") == t).alias(t) for t in names]
    return events.observe(METRIC, *one, F.count_if(~known).alias(OTHER))


class TopicCounters(StreamingQueryListener):
    """Adds up what ``counted`` streams report; a micro-batch that is reported again counts once."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        metrics = event.progress.observedMetrics.get(METRIC)
        if metrics is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = metrics.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict[str, int]:
        out: Counter[str] = Counter()
        for counts in list(self.batches.values()):
            out.update(counts)
        return {t: n for t, n in sorted(out.items()) if n}

    def settled(self, query: StreamingQuery, wait: float = WAIT_S) -> TopicCounters:
        """Waits until the last micro-batch of a query that has ended is reported."""
        last, stop = query.lastProgress, time.monotonic() + wait
        while last is not None and (str(query.id), last["batchId"]) not in self.batches and time.monotonic() < stop:
            time.sleep(0.05)
        return self

    def table(self, like: DataFrame) -> DataFrame:
        """(event_type, events): one row per type that occurred."""
        return like.sparkSession.createDataFrame([Row(event_type=t, events=n) for t, n in self.totals().items()], "event_type string, events long")

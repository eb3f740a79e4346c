"""Stream operators with state of their own: moves of pages, first completion of requests.

Pages are dealt to a fixed number of buckets, which are the keys of the state, so a micro-batch
asks for state once a bucket and not once a page.  Rows of a bucket wait in list state, as
tables in Arrow's format, until the watermark has passed them and are then read in the order of
their event time, all pages at once; neither the order of arrival nor the cut into micro-batches
shows in the result.  Each bucket has one timer, set to the next moment at which something can be
decided.  Rows behind the watermark of the micro-batch before are late and dropped by Spark,
so no row can come before one that was handed over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from draftlake.operators.ordered import with_next
from draftlake.streaming import events as ev

# ---------------------------------------------------------------- fixed values
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 256  # keys of the state; must not change while a stream's checkpoint is in use
CHUNK_ROWS = 10_000  # rows of a table in state
# ---------------------------------------------------------- end of fixed values


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which own state variables need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _chunks(table: pa.Table) -> list[tuple[bytes]]:
    """A table as rows of state."""
    out = []
    for at in range(0, table.num_rows, CHUNK_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table.slice(at, CHUNK_ROWS))
        out.append((sink.getvalue().to_pybytes(),))
    return out


class _Held:
    """A table in list state."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema) -> None:
        self.state, self.schema = handle.getListState(name, "rows binary"), schema

    def add(self, rows: pd.DataFrame) -> None:
        self.state.appendList(_chunks(pa.Table.from_pandas(rows, self.schema, preserve_index=False)))

    def get(self) -> pa.Table:
        return pa.concat_tables([self.schema.empty_table(), *(pa.ipc.open_stream(rows).read_all() for (rows,) in self.state.get())])

    def put(self, table: pa.Table) -> None:
        if table.num_rows:
            self.state.put(_chunks(table))
        else:
            self.state.clear()


_ROW = [("micros", pa.int64()), ("kind", pa.int32()), ("event_id", pa.string()), ("mark", pa.string())]


class InOrder(StatefulProcessor):
    """Hands over the rows of a bucket in the order (key, micros, kind, event_id), once the watermark has passed them."""

    key: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = pa.schema([*((k, pa.string()) for k in self.key), *_ROW])
        self.waiting = _Held(handle, "waiting", self.rows)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                self.waiting.add(pdf[self.rows.names])
                least = int(pdf["micros"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.waiting.get()
        micros = held["micros"].to_numpy()
        due, rest = held.filter(micros <= passed), held.filter(micros > passed)
        if due.num_rows:  # else the waiting rows stay as they are
            self.waiting.put(rest)
        self.timer.clear()
        out = [found for found in self.decided(due, passed) if len(found)]
        moments = [m for m in (int(micros[micros > passed].min()) if rest.num_rows else None, self.deadline()) if m is not None]
        if moments:
            self._wake(min(moments))
        return iter(out)

    def _wake(self, micros: int) -> None:
        """One timer per bucket: the earliest moment asked for."""
        at, known = -(-micros // 1000), self.timer.get()
        if known is None or at < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _sorted(self, table: pa.Table) -> pd.DataFrame:
        return table.sort_by([(c, "ascending") for c in (*self.key, "micros", "kind", "event_id", "mark")]).to_pandas()

    def decided(self, due: pa.Table, passed: int) -> Iterable[pd.DataFrame]:
        raise NotImplementedError

    def deadline(self) -> int | None:
        """When something besides the waiting rows has to be decided."""
        return None

    def close(self) -> None:
        pass


class Moves(InOrder):
    """One row per event of a page: the status before it and the status it brings."""

    key = ("page_id",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = _Held(handle, "last", pa.schema([("page_id", pa.string()), ("status", pa.string())]))

    def decided(self, due, passed):
        if not due.num_rows:
            return
        rows = self._sorted(due)
        page, mark = rows["page_id"], rows["mark"]
        known = self.last.get().to_pandas().set_index("page_id")["status"]
        begins = page != page.shift()
        before = mark.shift().where(~begins, page.map(known))
        now = rows.loc[page != page.shift(-1), ["page_id", "mark"]].set_index("page_id")["mark"]
        known = pd.concat([known[~known.index.isin(now.index)], now])
        self.last.put(pa.table({"page_id": known.index, "status": known.to_numpy()}, self.last.schema))
        before = before.astype(object).where(before.notna(), None)
        yield pd.DataFrame({"page_id": page, "event_id": rows["event_id"], "micros": rows["micros"], "from_status": before, "to_status": mark})


class FirstCompletion(InOrder):
    """One row per request: the first completion at or after it, or none once its time is over."""

    key = ("page_id", "stage")

    def __init__(self, within: int) -> None:
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = _Held(handle, "open", self.rows)
        self.first = handle.getValueState("first", "micros long")

    def decided(self, due, passed):
        # Requests that are still open come before all rows that are due.
        rows = self._sorted(pa.concat_tables([self.open.get(), due]))
        size, micros, asked = len(rows), rows["micros"].to_numpy(), rows["kind"].to_numpy() == 0
        change = ((rows["page_id"] != rows["page_id"].shift()) | (rows["stage"] != rows["stage"].shift())).to_numpy()
        group = np.cumsum(change)
        after = np.minimum.accumulate(np.where(asked, size, np.arange(size))[::-1])[::-1]  # the next completion, of any key
        place = np.minimum(after, max(size - 1, 0))
        met = (after < size) & (group[place] == group)
        done = np.where(met, micros[place], 0)
        intime = met & (done - micros <= self.within)
        out = asked & (met | (micros + self.within <= passed))
        still = rows[asked & ~out]
        self.open.put(pa.Table.from_pandas(still, self.rows, preserve_index=False))
        if len(still):
            self.first.update((int(still["micros"].min()),))
        else:
            self.first.clear()
        found = rows.loc[out, ["page_id", "stage", "event_id"]].assign(asked=micros[out])
        yield found.assign(done=pd.arrays.IntegerArray(done[out], ~intime[out]))

    def deadline(self):
        known = self.first.get()
        return None if known is None else known[0] + self.within


def _bucketed(rows: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    """``rows`` (with created_at as their event time) through ``processor``, bucket by bucket.

    A watermark never passes a row without time, so such rows are left out.
    """
    bucket = F.pmod(F.xxhash64(*processor.key), F.lit(BUCKETS)).cast("int")
    return (
        rows.where(F.col("created_at").isNotNull())
        .withColumn("bucket", bucket)
        .groupBy("bucket")
        .transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    )


def _legal() -> Column:
    moves = [f"{a}>{b}" for a, more in ev.NEXT_STATUS.items() for b in more]
    return F.concat_ws(">", F.coalesce("from_status", F.lit("")), "to_status").isin(moves)


def _statuses(events: DataFrame) -> DataFrame:
    named = F.coalesce(F.col("page_id"), F.lit("")) != ""
    return events.withColumn("status", ev.status_of()).where(named & F.col("status").isNotNull())


def page_moves(events: DataFrame) -> DataFrame:
    """Every status event of a page with the status before it, and whether that move is legal.

    Columns: page_id, event_id, moved_at, from_status (null for the first), to_status, legal.  The
    order is (created_at, event_id); a page with a large share of all events is cut into
    slices.  Events without page or status make no move.
    """
    step = F.struct("created_at", "event_id", "status").alias("step")
    own = _statuses(events).select("page_id", "created_at", "event_id", step)
    pairs = with_next(own, ["page_id"], ["created_at", "event_id"], "step", "after").where(F.col("after").isNotNull())
    later = pairs.select("page_id", F.col("after.event_id").alias("event_id"), F.col("after.created_at").alias("moved_at"), F.col("step.status").alias("from_status"), F.col("after.status").alias("to_status"))
    first = own.groupBy("page_id").agg(F.min("step").alias("step"))
    first = first.select("page_id", F.col("step.event_id").alias("event_id"), F.col("step.created_at").alias("moved_at"), F.lit(None).cast("string").alias("from_status"), F.col("step.status").alias("to_status"))
    return first.unionByName(later).withColumn("legal", _legal())


def page_moves_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Streaming twin of ``page_moves``; a move is given out once the watermark has passed it."""
    own = _statuses(events.withWatermark("created_at", watermark)).select(
        "page_id", "created_at", F.unix_micros("created_at").alias("micros"), F.lit(0).alias("kind"), "event_id", F.col("status").alias("mark")
    )
    schema = "page_id string, event_id string, micros long, from_status string, to_status string"
    out = _bucketed(own, Moves(), schema)
    return out.select("page_id", "event_id", F.timestamp_micros("micros").alias("moved_at"), "from_status", "to_status", _legal().alias("legal"))


def first_completions(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Batch twin of the stream below: ``stage_latency`` with completions inside the time bound only."""
    bound = F.col("done_at") <= F.col("requested_at") + F.expr(f"INTERVAL {within}")
    return ev.stage_latency(events).select("page_id", "stage", "event_id", "requested_at", F.when(bound, F.col("done_at")).alias("done_at"))


def first_completions_stream(events: DataFrame, within: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """One row per stage request: page_id, stage, event_id, requested_at, done_at.

    ``done_at`` is the first completion at or after the request, null if none comes within
    the time bound.  State holds the rows ahead of the watermark and the requests that are
    still open, never pairs.
    """
    asked, done = ev.stage_of(0), ev.stage_of(1)
    own = (
        events.withWatermark("created_at", watermark)
        .where(F.coalesce(F.col("page_id"), F.lit("")) != "")
        .withColumn("stage", F.coalesce(asked, done))
        .where(F.col("stage").isNotNull())
        .select("page_id", "stage", "created_at", F.unix_micros("created_at").alias("micros"), done.isNotNull().cast("int").alias("kind"), "event_id", F.lit("").alias("mark"))
    )
    micros = events.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP_SECONDS(0) + INTERVAL {within})").first()[0]
    schema = "page_id string, stage string, event_id string, asked long, done long"
    out = _bucketed(own, FirstCompletion(micros), schema)
    return out.select("page_id", "stage", "event_id", F.timestamp_micros("asked").alias("requested_at"), F.timestamp_micros("done").alias("done_at"))

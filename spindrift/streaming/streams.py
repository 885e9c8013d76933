"""Streaming forms of ingest, dedup, readiness and quotas."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.urls import normalize_url
from ..sources.keyed_table import KeyedTable
from ..sources.readers import ARTICLE_DDL

Step = Callable[[tuple | None, object], tuple[tuple, list]]


def article_stream(spark: SparkSession, path: str) -> DataFrame:
    """New JSON Lines files of a folder as they come."""
    return spark.readStream.schema(ARTICLE_DDL).json(path)


def ingest_stream(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch through ``upsert``; takes what is there and stops."""
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batch(root: str, merge: Callable[[DataFrame, DataFrame], DataFrame], *, stream: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts each batch once into the keyed table at ``root``.

    The table's version names the last batch of ``stream`` that it holds, and a batch and its
    number are committed by one rename: a batch that comes again after a failure changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, root).upsert(batch, merge, stream=stream, batch=number)

    return run


def dedup_stream(stream: DataFrame, url: str, ts: str, horizon: str = "48 hours") -> DataFrame:
    """The first arrival of each normalised address; repeats within the horizon and rows later
    than it are dropped. The state of an address goes once the watermark has passed it."""
    return stream.withColumn(url, normalize_url(F.col(url))).withWatermark(ts, horizon).dropDuplicatesWithinWatermark([url])


def ready_sessions(events: DataFrame, key: str, ts: str, *, quiet: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Sessions of a cluster that end after a quiet gap; works on tables and on streams.

    A stream's sessions come out, in append mode, once the watermark (``late`` behind the
    newest event) has passed their end; events that are later than that are dropped.
    """
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ready_at"), "n")


# ---- rules that need the order of events


#: Rows of one value of the state, about: state is read and written value by value.
HELD_ROWS = 20_000


def _held_values(frames: Iterator[pd.DataFrame], ts: str) -> Iterator[tuple[int, bytes]]:
    """The smallest time of some rows and the rows, as arrays, about HELD_ROWS in a value."""
    some: list[pd.DataFrame] = []
    for f in itertools.chain(frames, [None]):
        if f is not None and len(f):
            some.append(f)
        if some and (f is None or sum(map(len, some)) >= HELD_ROWS):
            rows, some = pd.concat(some, ignore_index=True), []
            yield int(rows[ts].min()), pickle.dumps({c: rows[c].to_numpy() for c in rows.columns}, protocol=5)


class _InOrder(StatefulProcessor):
    """Rows wait until the watermark has passed their time, then go through a step in order.

    Waiting rows are held many in a value; values whose rows all wait on aren't opened.
    """

    def __init__(self, ts: str, order: list[str], step: Step, names: list[str], kept: list[str], memory: StructType, horizon_ms: int | None):
        self._ts, self._order, self._step, self._names, self._kept = ts, order, step, names, kept
        self._memory_schema, self._horizon = memory, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "low long, held binary")
        self._memory = handle.getValueState("memory", self._memory_schema)

    def _settle(self, key: tuple, frames: Iterator[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        before = [(int(low), bytes(held)) for low, held in self._waiting.get()] if self._waiting.exists() else []
        stay, opened = [v for v in before if v[0] > watermark], [v for v in before if v[0] <= watermark]
        due: list[pd.DataFrame] = []

        def later() -> Iterator[pd.DataFrame]:
            for rows in itertools.chain((pd.DataFrame(pickle.loads(held)) for _, held in opened), frames):
                past = rows[self._ts] <= watermark
                due.append(rows[past])
                yield rows[~past]

        new = list(_held_values(later(), self._ts))
        memory, out = self._memory.get() if self._memory.exists() else None, []
        ready = pd.concat([f for f in due if len(f)], ignore_index=True).sort_values(self._order) if any(map(len, due)) else pd.DataFrame([], columns=self._kept)
        for row in ready.itertuples(index=False):
            memory, rows = self._step(memory, row)
            out += [(*key, *r) for r in rows]
        if opened:
            self._waiting.put(stay + new) if stay or new else self._waiting.clear()
        elif new:
            self._waiting.appendList(new)
        if memory is not None and len(ready):
            self._memory.update(tuple(memory))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if stay or new:
            self._handle.registerTimer(min(low for low, _ in stay + new))
        elif self._horizon is not None and len(ready):
            self._handle.registerTimer(int(ready[self._ts].max()) + self._horizon)
        yield pd.DataFrame(out, columns=self._names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self._settle(key, (f[self._kept] for f in rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self._waiting.exists():
            yield from self._settle(key, iter(()), timerValues.getCurrentWatermarkInMs())
        else:
            self._memory.clear()
            yield pd.DataFrame([], columns=self._names)

    def close(self) -> None:
        pass


def in_event_order(stream: DataFrame, key: str, ts: str, step: Step, *, out: str, memory: str, late: str, order: list[str] = (), forget_ms: int | None = None) -> DataFrame:
    """``step(memory, row) -> (memory, rows)`` over the rows of each key in the order of their time.

    ``step`` is a pure function; ``memory`` is None at first and then a tuple of the type
    ``memory``, ``out`` the type of the rows it gives, the key put before them. A row's time
    is in milliseconds there, its fields are named as the columns. Rows wait in state until
    the watermark (``late`` behind the newest row) has passed their time, so their order holds
    across triggers and files; rows that come later than that are dropped. ``forget_ms`` after
    a key's last row its memory goes. Needs the RocksDB state store (``ordered_session``).
    Rows of one time go by the columns of ``order``. No column
    may be named event_ms.
    """
    kept = [c for c in stream.columns if c != key]
    rows = stream.withWatermark(ts, late).withColumn("event_ms", F.unix_millis(ts))
    kind = stream.select(key).schema[0].dataType.simpleString()
    shaped = StructType.fromDDL(f"{key} {kind}, {out}")

    class Processor(_InOrder):
        def handleInputRows(self, k: tuple, frames: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
            yield from super().handleInputRows(k, (f.drop(columns=[ts]).rename(columns={"event_ms": ts}) for f in frames), timers)

    processor = Processor(ts, [ts, *order], step, shaped.names, kept, StructType.fromDDL(memory), forget_ms)
    return rows.groupBy(key).transformWithStateInPandas(processor, shaped, "append", "eventtime")


def ordered_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that ``in_event_order`` needs; the given one stays as it is."""
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return s


def quota_in_order(classified: DataFrame, ts: str, *, late: str, max_total: int = 1000, min_check: int = 200, max_ratio: float = 0.5) -> DataFrame:
    """Fresh encounters (scope, pos) of each scope until its stop, in the order of time and pos,
    whatever triggers they come in."""

    def step(memory: tuple | None, row) -> tuple[tuple, list]:
        fresh, seen, stopped = memory or (0, 0, False)
        if stopped:
            return (fresh, seen, stopped), []
        seen, is_fresh = seen + 1, row.kind == "fresh"
        fresh += is_fresh
        stopped = fresh >= max_total or (seen >= min_check and (seen - fresh) / seen > max_ratio)
        return (fresh, seen, stopped), [(row.pos,)] if is_fresh else []

    rows = classified.select("scope", "pos", F.col("class").alias("kind"), ts)
    return in_event_order(rows, "scope", ts, step, out="pos long", memory="fresh long, seen long, stopped boolean", late=late, order=["pos"])


def first_in_horizon(stream: DataFrame, url: str, ts: str, tie: str, *, late: str, horizon_ms: int) -> DataFrame:
    """url, tie: each row without a kept row of its normalised address within ``horizon_ms`` before
    it, in the order of time; an address comes again once the horizon is over."""

    def step(memory: tuple | None, row) -> tuple[tuple, list]:
        at = getattr(row, ts)
        if memory is not None and at - memory[0] < horizon_ms:
            return memory, []
        return (at,), [(getattr(row, tie),)]

    rows = stream.select(normalize_url(F.col(url)).alias(url), ts, tie)
    kind = stream.select(tie).schema[0].dataType.simpleString()
    return in_event_order(rows, url, ts, step, out=f"{tie} {kind}", memory="last long", late=late, order=[tie], forget_ms=horizon_ms)


def quota_stream(classified: DataFrame, *, max_total: int = 1000, min_check: int = 200, max_ratio: float = 0.5) -> DataFrame:
    """Fresh encounters (scope, pos, class) of each scope until its stop, with counts kept as state.

    The order holds within a trigger; ``quota_in_order`` holds it across triggers.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh, seen, stopped = state.get if state.exists else (0, 0, False)
        out = []
        whole = pd.concat(list(frames))  # a trigger's rows of one scope come in parts, in no order
        for pos, kind in whole.sort_values("pos")[["pos", "class"]].itertuples(index=False):
            if stopped:
                break
            seen += 1
            if kind == "fresh":
                fresh += 1
                out.append((key[0], pos))
            stopped = fresh >= max_total or (seen >= min_check and (seen - fresh) / seen > max_ratio)
        state.update((fresh, seen, stopped))
        yield pd.DataFrame(out, columns=["scope", "pos"])

    return classified.groupBy("scope").applyInPandasWithState(step, "scope string, pos long", "fresh long, seen long, stopped boolean", "append", GroupStateTimeout.NoTimeout)

"""Keyed state with timers (R-05, R-07): the processors of transformWithState."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """transformWithState keeps its columns in this store; a stream reads the setting when it starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def micros(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1_000_000)


def pieces(batches: Iterator[pd.DataFrame], folded: Callable[[], int], least: int = 1 << 17) -> Iterator[pd.DataFrame]:
    """A group's batches joined to pieces no smaller than what they are folded into, so that folding stays linear."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= max(folded(), least):
            yield pd.concat(waiting)
            waiting = []
    if waiting:
        yield pd.concat(waiting)


def merged(users: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Overlapping spans of one user made one; a span ends before its end, so one that starts there is another.  users: numbers
    from 0.  Also the order of the given spans by user and start, and where in it each merged span begins."""
    order = np.lexsort((starts, users))
    users, starts, ends, counts = (c[order] for c in (users, starts, ends, counts))
    by_end, rank = np.argsort(ends, kind="stable"), np.empty(len(ends), np.int64)
    rank[by_end] = np.arange(len(ends))
    base = users * len(ends)  # ranks of one user's ends lie above those of the user before
    reach = ends[by_end][np.maximum.accumulate(base + rank) - base]
    new = np.ones(len(starts), bool)
    new[1:] = (users[1:] != users[:-1]) | (starts[1:] >= reach[:-1])
    at = np.flatnonzero(new)
    return [users[at], starts[at], np.maximum.reduceat(ends, at), np.add.reduceat(counts, at)], order, at


class Sessions(StatefulProcessor):
    """The sessions that may still grow, of the users of one bucket. A row for each that a batch has changed ('open'), one for each that a
    later event has joined to an earlier one ('merged', no events), and one when the watermark has passed its end ('closed')."""

    def __init__(self, gap: int, user: str, kind: str) -> None:
        self.gap, self.user, self.kind = gap, user, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getValueState("spans", f"users array<{self.kind}>, starts array<bigint>, ends array<bigint>, counts array<bigint>")

    def held(self) -> list[np.ndarray]:
        """Users as they are, starts, ends, counts."""
        users, *numbers = self.spans.get() if self.spans.exists() else ([], [], [], [])
        return [pd.Series(users, dtype=object).to_numpy(), *(np.array(c, np.int64) for c in numbers)]

    def keep(self, spans: list[np.ndarray]) -> None:
        """Store the spans, with one timer: when the first of them ends."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(spans[0]):
            self.spans.update(tuple(c.tolist() for c in spans))
            self.handle.registerTimer(int(spans[2].min()) // 1000 + 1)
        else:
            self.spans.clear()

    def rows(self, spans: list[np.ndarray], status: str) -> pd.DataFrame:
        return pd.DataFrame({self.user: spans[0], "session_start": pd.to_datetime(spans[1], unit="us"), "session_end": pd.to_datetime(spans[2], unit="us"),
                             "n_events": spans[3], "status": [status] * len(spans[0])})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.held()
        names = pd.Index(pd.unique(old[0]), dtype=object)
        fresh = [np.zeros(0, np.int64)] * 4
        for batch in pieces(rows, lambda: len(fresh[0])):
            met = batch[self.user].astype(object)
            names = names.append(pd.Index(met[~met.isin(names)].unique(), dtype=object))
            times = batch["at"].to_numpy().astype("datetime64[us]").astype(np.int64)
            read = names.get_indexer(met), times, times + self.gap, np.ones(len(times), np.int64)
            fresh, _, _ = merged(*(np.concatenate(pair) for pair in zip(fresh, read, strict=True)))
        n, known = len(old[0]), [names.get_indexer(old[0]), *old[1:]]
        spans, order, at = merged(*(np.concatenate(pair) for pair in zip(known, fresh, strict=True)))
        spans[0] = names.to_numpy()[spans[0]]
        self.keep(spans)
        alone = np.diff(np.append(at, len(order))) == 1
        changed = ~(alone & (order[at] < n))
        start = np.repeat(spans[1], np.diff(np.append(at, len(order))))  # of the span that each given one is now in
        joined = order[(order < n) & (np.concatenate([known[1], fresh[1]])[order] != start)]
        if changed.any():
            yield self.rows([c[changed] for c in spans], "open")
        if len(joined):
            yield self.rows([*(c[joined] for c in old[:3]), np.zeros(len(joined), np.int64)], "merged")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans = self.held()
        done = spans[2] // 1000 < timerValues.getCurrentWatermarkInMs()
        self.keep([c[~done] for c in spans])
        if done.any():
            yield self.rows([c[done] for c in spans], "closed")

    def close(self) -> None:
        pass


def stream_sessions(log: DataFrame, gap: str = "30 minutes", ts: str = "searched_at", user: str = "user_session", late: str = "1 hour",
                    buckets: int = 1024) -> DataFrame:
    """R-07: activity sessions per user: start, end (last event and the gap), events and status, in update mode.

    A session is known by user and start. Its last row counts: 'open' while it may grow, so a run that ends has the sessions
    still open as well; 'closed' once the watermark is past its end; 'merged' when an event between two sessions has made the later
    one part of the earlier. Events without a time or user take no part; those later than the watermark are dropped. State: the user and three
    numbers for each open session. Users are kept in hashed buckets, each with one timer for the first session that ends.
    """
    use_state_store(log.sparkSession)
    kind = log.schema[user].dataType.simpleString()
    rows = log.select(user, F.col(ts).alias("at")).where(F.col(user).isNotNull() & F.col("at").isNotNull()).withWatermark("at", late)
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")).groupBy("_bucket").transformWithStateInPandas(
        Sessions(micros(gap), user, kind), f"{user} {kind}, session_start timestamp, session_end timestamp, n_events bigint, status string", "Update", "EventTime")


class Silence(StatefulProcessor):
    """Jobs that have been started and not heard of since, by the clock of the machine."""

    def __init__(self, patience: int, forget: int) -> None:
        self.patience, self.forget = patience, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "attempts int, since bigint", self.forget)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts, since = self.running.get() if self.running.exists() else (0, 0)
        events = sorted(x for batch in rows for x in zip(batch["at"], batch["event_id"], batch["result"], strict=True))
        status = events[-1][2]
        attempts += sum(e[2] == "started" for e in events)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentProcessingTimeInMs()
        if status == "started":
            self.handle.registerTimer(now + self.patience)
            self.running.update((int(attempts), int(now)))
        elif status == "completed":
            self.running.clear()
        else:
            self.running.update((int(attempts), 0))
        yield pd.DataFrame({"queue_id": [key[0]], "status": [{"started": "processing", "completed": "completed"}.get(status, "pending")], "attempts": [attempts], "reason": [None]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts, _ = self.running.get()
        self.running.update((attempts, 0))
        yield pd.DataFrame({"queue_id": [key[0]], "status": ["pending"], "attempts": [attempts], "reason": ["timed out"]})

    def close(self) -> None:
        pass


def stream_stuck(results: DataFrame, stuck_after: str = "20 minutes", forget_after: str = "30 days") -> DataFrame:
    """R-05: a job that was started and is silent for `stuck_after` of processing time is pending again, with its attempts and
    the reason 'timed out', also if no event ever arrives after it. Rows as for stream_jobs (queue_id, event_id, result, at), in
    update mode; the last one of a batch by time and id counts. A completed job has no state; others are forgotten by `forget_after`."""
    use_state_store(results.sparkSession)
    keyed = results.select(F.col("queue_id").cast("string").alias("queue_id"), "event_id", "result", "at")
    return keyed.groupBy("queue_id").transformWithStateInPandas(
        Silence(micros(stuck_after) // 1000, micros(forget_after) // 1000), "queue_id string, status string, attempts int, reason string", "Update", "ProcessingTime")

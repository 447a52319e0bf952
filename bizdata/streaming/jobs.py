"""Streams (R-01 … R-07).  Rows later than the watermark are dropped."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType, TimestampNTZType

from ..operators.upsert import upsert_registry
from ..sources.registry import CSV_COLUMNS, map_registry_rows, raw_columns
from .state import micros, pieces
from .tables import BucketTable, TopTable


def read_registry_stream(spark: SparkSession, folder: str, active_only: bool = False, files_per_batch: int = 10) -> DataFrame:
    """R-01: registry files as they arrive."""
    schema = ", ".join(f"`{header}` string" for header in CSV_COLUMNS)
    raw = (spark.readStream.schema(schema).options(header=True, quote='"', escape='"', enforceSchema=True)
           .option("maxFilesPerTrigger", files_per_batch).csv(folder))
    rows = map_registry_rows(raw_columns(raw), active_only)
    return rows.withColumn("_place", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"))


def registry_table(spark: SparkSession, table: str, companies: DataFrame, buckets: int = 64) -> BucketTable:
    """R-01: the table that stream_registry keeps."""
    names = [f for f in companies.schema.fields if f.name != "_place"]
    return BucketTable(spark, table, "company_number", StructType([*names, StructField("last_updated", TimestampNTZType())]), [f.name for f in names], buckets)


def stream_registry(companies: DataFrame, table: str, checkpoint: str, as_of: Callable[[int], str], buckets: int = 64) -> DataStreamWriter:
    """R-01: UPSERT every batch into a table of hashed buckets (see BucketTable): only the buckets that a batch's numbers fall in
    are rewritten, and a repeated batch changes nothing. `as_of` gives the time stamp of a batch number. Of several rows of a company
    in one batch the last one counts, by the time and name of its file and its place there, which no packing of files into
    tasks changes.
    """
    store = registry_table(companies.sparkSession, table, companies, buckets)

    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("_seq", F.struct("_place", F.monotonically_increasing_id())).drop("_place")
        store.change(keyed, number, lambda old, new: upsert_registry(old, new, as_of(number), seq="_seq"))

    return companies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_rates(events: DataFrame, ts: str, source: str, late: str = "1 hour", window: str = "10 minutes",
                 slide: str | None = None) -> DataFrame:
    """R-02: rows per source in tumbling (or sliding) windows of event time."""
    spans = F.window(ts, window, slide) if slide else F.window(ts, window)
    grouped = events.withWatermark(ts, late).groupBy(spans.alias("w"), F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source", "n")


def stream_dedup(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """R-03: repeats of a key within the watermark are dropped; the state forgets older keys."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def stream_trending(log: DataFrame, ts: str = "searched_at", late: str = "1 hour", window: str = "1 hour",
                    slide: str = "10 minutes") -> DataFrame:
    """R-06: searches per sliding window; stream_top ranks them."""
    grouped = log.filter(F.col("search_query").isNotNull()).withWatermark(ts, late).groupBy(
        F.window(ts, window, slide).alias("w"), "search_query").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "search_query", "n")


def stream_top(counts: DataFrame, folder: str, checkpoint: str, n: int) -> DataStreamWriter:
    """R-06: the n most frequent searches of every window, ranked while the stream runs (see TopTable)."""
    store = top_table(counts, folder, n)
    return counts.writeStream.outputMode("update").foreachBatch(store.change).option("checkpointLocation", checkpoint)


def top_table(counts: DataFrame, folder: str, n: int) -> TopTable:
    return TopTable(counts.sparkSession, folder, n, "window_start", "search_query", "window_start timestamp, search_query string, n bigint")


# --- job state --------------------------------------------------------------------------------

JOB_OUTPUT = "queue_id string, status string, attempts int, due_at timestamp"
#: Jobs of one bucket side by side: statuses as places in STATUSES, times in microseconds (`due`) and milliseconds (`wake`).
JOB_STATE = "ids array<string>, statuses array<int>, attempts array<int>, due array<bigint>, wake array<bigint>"
STATUSES = np.array(["pending", "processing", "completed", "failed"], object)
PENDING, PROCESSING, COMPLETED, FAILED = range(4)
NEVER = (1 << 63) - 1


def _last_results(rows: pd.DataFrame) -> pd.DataFrame:
    """A job's last result by time and id, with the number of its starts and its latest time; results of no known kind come first."""
    rows = rows.sort_values(["known", "at", "event_id", "result"], na_position="first", kind="stable")
    by = rows.groupby("queue_id", dropna=False, sort=False)
    rows = rows.assign(starts=by["starts"].transform("sum"), latest=by["latest"].transform("max"))
    return rows.drop_duplicates("queue_id", keep="last")


def _micros(times: pd.Series) -> np.ndarray:
    return np.where(times.isna(), NEVER, times.to_numpy().astype("datetime64[us]").astype(np.int64))


def _job_step(max_attempts: int, retry: int, stuck_after: int, forget_after: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], [], [])
        last = pd.DataFrame({"queue_id": []})
        for batch in pieces(batches, lambda: len(last)):
            batch = batch.assign(known=batch["result"].isin(["started", "completed", "failed"]), starts=(batch["result"] == "started").astype("int64"), latest=batch["at"])
            last = _last_results(pd.concat([last, batch]) if len(last) else batch)
        codes, ids = pd.factorize(np.array([*held[0], *last["queue_id"]], object), use_na_sentinel=False)
        ids = np.where(pd.isna(ids), None, ids)
        old, new = codes[:len(held[0])], codes[len(held[0]):]
        status, attempts, due, wake = np.zeros(len(ids), int), np.zeros(len(ids), int), np.full(len(ids), NEVER), np.full(len(ids), NEVER)
        for column, values in zip((status, attempts, due, wake), held[1:], strict=True):
            column[old] = values
        watermark, told = state.getCurrentWatermarkMs(), np.zeros(len(ids), bool)
        if len(new):
            attempts[new] += last["starts"].to_numpy(int)
            at, latest = _micros(last["at"]), _micros(last["latest"])
            started, completed, failed = (last["result"].eq(r).to_numpy(bool) for r in ("started", "completed", "failed"))
            used_up = failed & (attempts[new] >= max_attempts)
            now = np.select([started, completed, used_up, failed], [PROCESSING, COMPLETED, FAILED, PENDING], status[new])
            until = np.select([completed | used_up, started | failed], [NEVER, np.where(at == NEVER, NEVER, np.minimum(at, NEVER >> 1) + np.where(started, stuck_after, retry))], due[new])
            kept_until = np.maximum(np.where(latest == NEVER, watermark, latest // 1000), watermark) + forget_after // 1000
            status[new], due[new], told[new] = now, until, True
            wake[new] = np.select([(now == PROCESSING) & (until < NEVER), (now == COMPLETED) | (now == FAILED)], [np.maximum(until // 1000, watermark + 1), kept_until], NEVER)
        over = ~told & (wake < watermark)
        gone = over & ((status == COMPLETED) | (status == FAILED))  # kept long enough
        silent = over & ~gone  # the attempts stay
        status[silent], due[silent], wake[silent] = PENDING, NEVER, watermark + forget_after // 1000
        if gone.all():
            state.remove()
        else:
            state.update(tuple(c[~gone].tolist() for c in (ids, status, attempts, due, wake)))
            if (first := int(wake[~gone].min())) < NEVER:
                state.setTimeoutTimestamp(max(first, watermark + 1))
        told |= silent
        if told.any():
            times = pd.Series(np.where(due[told] == NEVER, np.datetime64("NaT", "us"), due[told].astype("datetime64[us]")))
            yield pd.DataFrame({"queue_id": ids[told], "status": STATUSES[status[told]], "attempts": attempts[told], "due_at": times})

    return step


def stream_jobs(results: DataFrame, max_attempts: int = 3, retry: str = "1h", stuck_after: str = "20min",
                late: str = "5 minutes", forget_after: str = "30d", buckets: int = 1024) -> DataFrame:
    """R-04, R-05: state of every job from its result events (queue_id, event_id, result, at).

    A failed job is pending again after `retry` until its attempts are used up; a job that is started and
    silent for `stuck_after` of event time is pending again, with its attempts.  The state is four values per job; that
    of a completed or failed job goes after `forget_after` of event time.  Jobs are kept in hashed buckets, each with one
    timer for the first of them: a batch pays for the buckets that its jobs fall in, not for a call per job.
    """
    step = _job_step(max_attempts, *(micros(text) for text in (retry, stuck_after, forget_after)))
    keyed = results.select(F.col("queue_id").cast("string").alias("queue_id"), "event_id", "result", "at")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("queue_id"), F.lit(buckets)).cast("int"))
    return keyed.withWatermark("at", late).groupBy("bucket").applyInPandasWithState(
        step, JOB_OUTPUT, JOB_STATE, "update", GroupStateTimeout.EventTimeTimeout)

"""Queries R-01 … R-07: the streams run over the event files until these are used up (availableNow)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import shared_folder
from ..streaming import counts, jobs, state
from .registry import query
from .views import AS_OF, Tables


def stream_of(t: Tables, name: str) -> DataFrame:
    """A base table as a stream of its files."""
    return t.spark.readStream.schema(t.base(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def drain(stream: DataFrame) -> DataFrame:
    """Run an append stream to its end and read what it wrote."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    run = (stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state")
           .trigger(availableNow=True).start(f"{folder}/out"))
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_windows(stream: DataFrame, *keys: str) -> DataFrame:
    """Run a stream of window counts to its end and read the last count of every window, those still open as well."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/v={number}")

    run = (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    seen = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return seen.groupBy(*keys).agg(F.max("n").alias("n"))  # a count only grows


def plain_times(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).cast("timestamp_ntz").alias(n) if k == "timestamp" else F.col(n) for n, k in df.dtypes])


def events(t: Tables) -> DataFrame:
    return stream_of(t, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type"), F.col("user_id"))


MARK = "(SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)"

query("r02_rates_10min", f"""
    SELECT * FROM (SELECT TIME_BUCKET(INTERVAL 10 MINUTE, ts) AS window_start, TIME_BUCKET(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS window_end,
      event_type AS source, COUNT(*) AS n FROM events GROUP BY ALL)""")(
    lambda t: plain_times(drain_windows(jobs.stream_rates(events(t), "ts", "event_type"), "window_start", "window_end", "source")))

query("r02_rates_1h_sliding", f"""
    SELECT * FROM (SELECT TIME_BUCKET(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS window_start,
        TIME_BUCKET(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE + INTERVAL 1 HOUR AS window_end, event_type AS source, COUNT(*) AS n
      FROM events, (SELECT UNNEST([0, 1, 2, 3, 4, 5]) AS k) GROUP BY ALL)""")(
    lambda t: plain_times(drain_windows(jobs.stream_rates(events(t), "ts", "event_type", window="1 hour", slide="10 minutes"), "window_start", "window_end", "source")))

query("r03_dedup", "SELECT DISTINCT event_id FROM events")(
    lambda t: drain(jobs.stream_dedup(events(t), ["event_id"], "ts").select("event_id")))

query("r06_trending", f"""
    SELECT window_start, search_query, n FROM (SELECT TIME_BUCKET(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS window_start, event_type AS search_query, COUNT(*) AS n
      FROM events, (SELECT UNNEST([0, 1, 2, 3, 4, 5]) AS k) GROUP BY ALL)""")(
    lambda t: plain_times(drain_windows(jobs.stream_trending(events(t).select(
        F.col("ts").alias("searched_at"), F.col("event_type").alias("search_query"))), "window_start", "search_query")))



def _ranked(t: Tables) -> DataFrame:
    """The two most frequent searches of each window, from several batches of events."""
    folder = shared_folder(t.spark)
    counts = jobs.stream_trending(deliveries(t, folder).select(F.col("ts").alias("searched_at"), F.col("event_type").alias("search_query")), late="1000 days")
    run = jobs.stream_top(counts, f"{folder}/top", f"{folder}/state", 2).trigger(availableNow=True).start()
    run.awaitTermination()
    return plain_times(jobs.top_table(counts, f"{folder}/top", 2).read())


def deliveries(t: Tables, folder: str) -> DataFrame:
    """The events in three deliveries, each a batch of the stream: odd ids, then those that four does not divide, then the rest."""
    base = t.base("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    for rest in ((1, 3), (2,), (0,)):
        base.where((F.col("event_id") % 4).isin(*rest)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return t.spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


query("r06_ranked", f"""
    SELECT window_start, search_query, n, CAST(rank AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY window_start ORDER BY n DESC, search_query) AS rank FROM (
      SELECT TIME_BUCKET(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS window_start, event_type AS search_query, COUNT(*) AS n
      FROM events, (SELECT UNNEST([0, 1, 2, 3, 4, 5]) AS k) GROUP BY ALL)) WHERE rank <= 2""")(_ranked)


@query("r02_late_rows", """
    WITH mark AS (SELECT MAX(ts) - INTERVAL 1 HOUR AS reached FROM events WHERE event_id % 2 = 1)
    SELECT COUNT(*) AS n_read, COUNT(*) FILTER (WHERE NOT late) AS n_counted, COUNT(*) FILTER (WHERE late) AS n_late
    FROM (SELECT event_id % 4 = 0 AND TIME_BUCKET(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE <= reached AS late FROM events, mark)""")
def _late(t: Tables) -> DataFrame:
    """Rows of the third delivery come too late for windows that the first has closed (Spark drops rows by the watermark of the
    batch before): rows read, less rows in windows."""
    folder = shared_folder(t.spark)
    rates = jobs.stream_rates(counts.observed(deliveries(t, folder), "read"), "ts", "event_type")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/v={number}")

    run = (rates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    run.awaitTermination()
    read = counts.totals(run, "read")["rows"]
    held = t.spark.read.schema(rates.schema).parquet(f"{folder}/out").groupBy("window_start", "source").agg(F.max("n").alias("n"))
    return held.agg(F.lit(read).cast("bigint").alias("n_read"), F.sum("n").alias("n_counted"), (F.lit(read) - F.sum("n")).cast("bigint").alias("n_late"))


@query("r07_sessions", f"""
    SELECT user_session, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS n_events,
      CASE WHEN MAX(ts) + INTERVAL 30 MINUTE < {MARK} THEN 'closed' ELSE 'open' END AS status FROM (
      SELECT *, SUM(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_session ORDER BY ts, event_id) AS s FROM (
        SELECT event_id, user_id AS user_session, ts, ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE AS gap FROM events))
    GROUP BY user_session, s""")
def _sessions(t: Tables) -> DataFrame:
    """The last row of each session, those still open when the events end as well."""
    folder = shared_folder(t.spark)
    stream = state.stream_sessions(events(t).select(F.col("ts").alias("searched_at"), F.col("user_id").alias("user_session")))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/v={number}")

    run = (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    run.awaitTermination()
    rows = t.spark.read.schema(StructType([*stream.schema.fields, StructField("v", IntegerType())])).parquet(f"{folder}/out")
    final = F.struct("v", (F.col("status") == "closed").alias("closed"), "session_end", "n_events", "status")
    last = rows.groupBy("user_session", "session_start").agg(F.max(final).alias("s")).where("s.status != 'merged'")
    return plain_times(last.select("user_session", "session_start", "s.session_end", "s.n_events", "s.status"))


@query("r01_registry_stream", """
    SELECT number AS company_number, name, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY number ORDER BY seq DESC) AS rn FROM (
      SELECT p_partkey AS seq, LPAD(CAST(p_partkey % 1500 AS STRING), 8, '0') AS number, p_name AS name, p_type AS status FROM part)) WHERE rn = 1""")
def _registry(t: Tables) -> DataFrame:
    """Part rows written as registry files one after the other, taken in as a stream of several batches, read from the
    last manifest."""
    folder = shared_folder(t.spark)
    part = t.base("part")
    most = part.agg(F.max("p_partkey")).first()[0]
    rows = part.select(
        F.floor(F.col("p_partkey") * 5 / (most + 1)).alias("_file"), "p_partkey", F.lpad((F.col("p_partkey") % 1500).cast("string"), 8, "0").alias("CompanyNumber"), F.col("p_name").alias("CompanyName"),
        F.lit("").alias("CompanyCategory"), F.col("p_type").alias("CompanyStatus"),
        *[F.lit("").alias(c) for c in list(jobs.CSV_COLUMNS)[4:]])
    for k in range(5):  # five deliveries; rows of one company come in different ones
        own = rows.filter(F.col("_file") == k).orderBy("p_partkey").drop("_file", "p_partkey")
        own.write.mode("append").option("header", True).csv(f"{folder}/in")
    stream = jobs.read_registry_stream(t.spark, f"{folder}/in", files_per_batch=2)
    run = jobs.stream_registry(stream, f"{folder}/companies", f"{folder}/state", lambda n: AS_OF, buckets=16).trigger(availableNow=True).start()
    run.awaitTermination()
    return jobs.registry_table(t.spark, f"{folder}/companies", stream, 16).read().select("company_number", "name", "status")


def _last_states(results: DataFrame) -> DataFrame:
    """Run the job-state stream to its end and keep the last state per job."""
    spark, folder = results.sparkSession, shared_folder(results.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/v={number}")

    run = (jobs.stream_jobs(results).writeStream.outputMode("update").foreachBatch(write)
           .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    run.awaitTermination()
    seen = spark.read.schema(jobs.JOB_OUTPUT + ", batch int").parquet(f"{folder}/out")
    return seen.groupBy("queue_id").agg(F.max(F.struct("batch", "status", "attempts")).alias("s")).select(
        F.col("queue_id").cast("bigint").alias("queue_id"), "s.status", "s.attempts")


def _results(t: Tables, at) -> DataFrame:
    """Line items as job results."""
    kind = F.col("l_linenumber") % 3
    return stream_of(t, "lineitem").select(
        F.col("l_orderkey").alias("queue_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("event_id"),
        F.when(kind == 1, "started").when(kind == 2, "completed").otherwise("failed").alias("result"), at.alias("at"))


STATES = """SELECT l_orderkey AS queue_id, MAX_BY(CASE l_linenumber % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' ELSE 'completed' END, k) AS last, MAX(l_shipdate) AS shipped,
        CAST(COUNT(*) FILTER (WHERE l_linenumber % 3 = 1) AS INT) AS attempts FROM (SELECT *, {order} AS k FROM lineitem) GROUP BY l_orderkey"""

query("r04_job_state", f"""
    SELECT queue_id, CASE WHEN last = 'failed' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE last END AS status, attempts
    FROM ({STATES.format(order='l_linenumber * 1000000 + l_partkey')})""")(
    lambda t: _last_states(_results(t, F.timestamp_seconds(F.lit(1704067200) + F.col("l_linenumber") * 60))))

# the same results at their ship dates: a job whose last word was "started" has long been silent, unless it is one of the very last
query("r05_stuck_jobs", f"""
    SELECT queue_id, attempts, CASE WHEN last = 'processing' AND shipped + INTERVAL 20 MINUTE <= (SELECT MAX(l_shipdate) - INTERVAL 5 MINUTE FROM lineitem) THEN 'pending'
      WHEN last = 'failed' AND before >= 3 THEN 'failed' WHEN last = 'failed' THEN 'pending' ELSE last END AS status
    FROM (SELECT *, attempts AS before FROM ({STATES.format(order='EPOCH(l_shipdate) * 100000000 + l_linenumber * 1000000 + l_partkey')}))""")(
    lambda t: _last_states(_results(t, F.col("l_shipdate").cast("timestamp"))).select("queue_id", "attempts", "status"))

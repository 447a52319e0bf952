"""Streams give the result of their batch twin; silent jobs return to the queue."""

from pyspark.sql import functions as F

from bizdata.streaming import counts, jobs, state


def files(spark, folder, batches, schema):
    """One file per batch, read back in that order."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # the file source orders files by modification time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_silent_job_is_pending_again(spark, tmp_path):
    schema = "queue_id string, event_id int, result string, at_text string"
    batches = [[("a", 1, "started", "2024-01-01 00:00:00"), ("b", 2, "started", "2024-01-01 00:00:00")],
               [("b", 3, "failed", "2024-01-01 00:10:00")],
               [("c", 4, "started", "2024-01-01 03:00:00")],
               [("c", 5, "completed", "2024-01-01 03:01:00")]]
    stream = files(spark, tmp_path / "in", batches, schema).withColumn("at", F.col("at_text").cast("timestamp")).drop("at_text")
    seen = []

    def collect(batch, number):
        seen.extend((number, r.queue_id, r.status, r.attempts) for r in batch.collect())

    run = (jobs.stream_jobs(stream).writeStream.outputMode("update").foreachBatch(collect)
           .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    run.awaitTermination()
    last = {}
    for number, job, status, attempts in sorted(seen):
        last[job] = (status, attempts)
    assert last == {"a": ("pending", 1), "b": ("pending", 1), "c": ("completed", 1)}


def registry_files(folder, deliveries):
    import time

    header = ",".join(jobs.CSV_COLUMNS)
    folder.mkdir()
    for i, lines in enumerate(deliveries):
        rows = [line + "," * (len(jobs.CSV_COLUMNS) - 4) for line in lines]
        (folder / f"{i}.csv").write_text("\n".join([header, *rows]) + "\n")
        time.sleep(1.1)


def test_registry_batches_rewrite_their_buckets_only(spark, tmp_path):
    many = [f"{n},Old {n},,Active" for n in range(200)]
    registry_files(tmp_path / "in", [many, ["7,New,,Closed", "9999,Late,,Active", ",No number,,Active"]])
    stream = jobs.read_registry_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    run = jobs.stream_registry(stream, str(tmp_path / "t"), str(tmp_path / "s"), lambda n: f"2024-01-0{n + 1} 00:00:00", buckets=16).trigger(availableNow=True).start()
    run.awaitTermination()
    store = jobs.registry_table(spark, str(tmp_path / "t"), stream, 16)
    got = {r.company_number: (r.name, r.status) for r in store.read().collect()}
    assert len(got) == 202 and got["7"] == ("New", "Closed") and got["9999"][0] == "Late" and got["8"] == ("Old 8", "Active")
    versions = store.versions()
    assert set(versions.values()) == {0, 1} and sum(v == 1 for v in versions.values()) <= 3
    assert len(list((tmp_path / "t" / "data" / "v=1").glob("_bucket=*"))) == sum(v == 1 for v in versions.values())

    # a batch that is run again, and one that failed before its manifest, change nothing
    again = spark.createDataFrame([("7", "Closed", "New")], "company_number string, status string, name string")
    before = sorted(map(str, store.read().collect()))
    rows = [c for c in store.schema.names if c not in again.columns]
    batch = again.select("*", *[F.lit(None).cast(store.schema[c].dataType).alias(c) for c in rows if c != "last_updated"])
    jobs.upsert_registry(store.read({b: v for b, v in store.versions(1).items()}), batch, "2024-01-02 00:00:00")
    store.bucketed(batch).write.partitionBy("_bucket").parquet(str(tmp_path / "t" / "data" / "v=2"))
    assert sorted(map(str, store.read().collect())) == before

    # old versions go once no manifest names them
    gone = store.vacuum(2)
    assert gone == sum(v == 1 for v in versions.values() if v == 1) and sorted(map(str, store.read().collect())) == before


def test_sessions_grow_merge_and_close(spark, tmp_path):
    schema = "user_session string, at_text string"
    batches = [[("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:50:00"), ("v", "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00"), ("u", None)],
               [("u", "2024-01-01 00:25:00"), ("v", "2024-01-01 00:30:00")],  # joins two sessions of u; v's gap is just reached
               [("w", "2024-01-01 09:00:00")], [("u", "2024-01-01 08:55:00")]]
    stream = files(spark, tmp_path / "in", batches, schema).withColumn("searched_at", F.col("at_text").cast("timestamp"))
    seen = []

    def collect(batch, number):
        seen.extend((r.user_session, r.session_start.hour * 60 + r.session_start.minute, number, r.status == "closed", r.n_events, r.status) for r in batch.collect())

    run = state.stream_sessions(stream).writeStream.outputMode("update").foreachBatch(collect).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    run.awaitTermination()
    last = {(u, at): (n, status) for u, at, _, _, n, status in sorted(seen, key=lambda r: r[:4])}
    assert last == {("u", 0): (3, "closed"), ("u", 50): (0, "merged"), ("v", 0): (1, "closed"), ("v", 30): (1, "closed"), ("w", 540): (1, "open"), ("u", 535): (1, "open")}


def test_silent_job_is_freed_without_a_later_event(spark, tmp_path):
    import time

    schema = "queue_id string, event_id int, result string, at_text string"
    batches = [[("a", 1, "started", "2024-01-01 00:00:00"), ("b", 2, "started", "2024-01-01 00:00:00"), ("b", 3, "completed", "2024-01-01 00:01:00"), ("c", 4, "started", "2024-01-01 00:00:00"),
                ("c", 5, "failed", "2024-01-01 00:01:00"), ("c", 6, "started", "2024-01-01 00:02:00")]]
    stream = files(spark, tmp_path / "in", batches, schema).withColumn("at", F.col("at_text").cast("timestamp")).drop("at_text")
    seen = []
    run = (state.stream_stuck(stream, stuck_after="3 seconds").writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(b.collect()))
           .option("checkpointLocation", str(tmp_path / "s")).trigger(processingTime="500 milliseconds").start())
    try:
        for _ in range(120):
            if sum(r["reason"] == "timed out" for r in seen) == 2:
                break
            time.sleep(0.5)
    finally:
        run.stop()
    last = {r["queue_id"]: (r["status"], r["attempts"], r["reason"]) for r in seen}
    assert last == {"a": ("pending", 1, "timed out"), "b": ("completed", 1, None), "c": ("pending", 2, "timed out")}


def test_top_table_keeps_what_may_still_lead(spark, tmp_path):
    from datetime import datetime

    w1, w2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    schema = "window_start timestamp, search_query string, n bigint"
    store = jobs.top_table(spark.createDataFrame([], schema), str(tmp_path / "top"), 2)
    for k, rows in enumerate([[(w1, "a", 3), (w1, "b", 2), (w1, "c", 1)], [(w1, "c", 4), (w2, "a", 1)], [(w1, "b", 4)], [(w2, "z", 1), (w2, "b", 1)]]):
        store.change(spark.createDataFrame(rows, schema), k)
        store.change(spark.createDataFrame(rows, schema), k)  # a repeated batch
    got = sorted((r.window_start, r.rank, r.search_query, r.n) for r in store.read().collect())
    assert got == [(w1, 1, "b", 4), (w1, 2, "c", 4), (w2, 1, "a", 1), (w2, 2, "b", 1)]


def test_counts_of_a_stream(spark, tmp_path):
    import time

    listener = counts.Counts()
    spark.streams.addListener(listener)
    stream = files(spark, tmp_path / "in", [[(1,), (2,)], [(3,)]], "k int")
    run = (counts.observed(stream, "seen", odd=F.count_if(F.col("k") % 2 == 1)).writeStream.format("noop")
           .option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start())
    run.awaitTermination()
    assert counts.totals(run, "seen") == {"rows": 3, "odd": 2}
    for _ in range(40):
        if listener.sums.get("seen", {}).get("rows") == 3:
            break
        time.sleep(0.25)
    spark.streams.removeListener(listener)
    assert listener.sums["seen"] == {"rows": 3, "odd": 2}


def job_by_job(batches, late=300, stuck=1200, retry=3600, most=3, forget=30 * 86400):
    """Last state of each job, one result after the other; a batch works with the watermark of the batches before it, and
    drops rows by the one before that."""
    held, last, dropped, watermark, seen = {}, {}, 0, 0, 0

    def expire(data):
        for job, (status, n, wake) in list(held.items()):
            if job not in data and wake is not None and wake < watermark:
                if status in ("completed", "failed"):
                    del held[job]
                else:
                    held[job], last[job] = ("pending", n, watermark + forget), ("pending", n)

    for rows in [*batches, []]:
        data = {}
        for job, number, result, at in rows:
            if at > dropped:
                data.setdefault(job, []).append((at, number, result))
            seen = max(seen, at)
        for job, results in data.items():
            status, n, _ = held.get(job, ("pending", 0, None))
            for at, _, result in sorted(results):
                if result == "started":
                    status, n, due = "processing", n + 1, at + stuck
                else:
                    status = "completed" if result == "completed" else "failed" if n >= most else "pending"
            wake = max(due, watermark + 0.001) if status == "processing" else None if status == "pending" else max(max(results)[0], watermark) + forget
            held[job], last[job] = (status, n, wake), (status, n)
        expire(data)
        dropped, watermark = watermark, max(watermark, seen - late)
    return last


def test_jobs_of_one_bucket_keep_their_own_states_and_timers(spark, tmp_path):
    import random

    rng, start = random.Random(5), 1_704_067_200
    batches = [[(rng.choice([None, *map(str, range(60))]), k * 1000 + i, rng.choice(["started", "completed", "failed"]), start + days * 86400 + rng.randrange(3600)) for i in range(80)]
               for k, days in enumerate((0, 0, 1, 40))]
    stream = files(spark, tmp_path / "in", batches, "queue_id string, event_id int, result string, s long").withColumn("at", F.timestamp_seconds("s"))
    seen = []
    run = (jobs.stream_jobs(stream, buckets=3).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend((n, r.queue_id, r.status, r.attempts) for r in b.collect()))
           .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    run.awaitTermination()
    assert {job: (status, n) for _, job, status, n in sorted(seen, key=lambda r: r[0])} == job_by_job(batches)
    assert 0 < run.recentProgress[-1].stateOperators[0].numRowsTotal <= 3


def test_sessions_of_one_bucket_stay_apart(spark, tmp_path):
    import random

    rng = random.Random(3)
    batches = [[(rng.choice("abcdefghij"), 1_704_067_200 + rng.randrange(6 * 3600)) for _ in range(60)] for _ in range(3)]
    stream = files(spark, tmp_path / "in", batches, "user_session string, s long").withColumn("searched_at", F.timestamp_seconds("s"))
    seen = []
    run = (state.stream_sessions(stream, late="1 day", buckets=2).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend((n, *r) for r in b.collect()))
           .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    run.awaitTermination()
    last = {(user, int(begin.timestamp())): (int(end.timestamp()), n) for _, user, begin, end, n, _ in sorted(seen)}
    want = {}
    for user in "abcdefghij":
        times = sorted(s for rows in batches for u, s in rows if u == user)
        for at in times:
            if want and (key := max(want)) and key[0] == user and at < want[key][0]:
                want[key] = (at + 1800, want[key][1] + 1)
            else:
                want[user, at] = (at + 1800, 1)
    assert {k: v for k, v in last.items() if v[1]} == want
    assert run.recentProgress[-1].stateOperators[0].numRowsTotal <= 2 * 2  # spans and timer of a bucket

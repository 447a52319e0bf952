"""Work queues as tables (P-29 … P-33).  One job plans the batches, so no locks are needed."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.company import as_time
from ..functions.presence import missing
from .joins import without
from .search import is_completed, next_jobs
from .upsert import merge_rows

OPEN = ("pending", "processing")


def enqueue(queue: DataFrame, companies: DataFrame, n: int, as_of: str, max_attempts: int = 3) -> DataFrame:
    """P-29: queue plus the n newest companies without a website that are not queued already."""
    open_jobs = queue.filter(F.col("status").isin(*OPEN))
    wanted = without(companies.filter(missing("website")), open_jobs, [("id", "company_id")])
    picked = wanted.orderBy(F.desc_nulls_last("created_at"), F.asc("id")).limit(n)
    now = as_time(as_of)
    rows = picked.select(
        F.concat(F.lit("job-"), F.col("id").cast("string")).alias("queue_id"), F.col("id").alias("company_id"),
        F.lit(0).alias("priority"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
        F.lit(max_attempts).alias("max_attempts"), now.alias("scheduled_for"), now.alias("created_at"))
    return queue.unionByName(rows, allowMissingColumns=True)


def upsert_queue(queue: DataFrame, wanted: DataFrame) -> DataFrame:
    """P-30: a pending row of the company takes the new priority; other companies get a new row.

    `wanted` holds one row per company: company_id, priority and the columns of a new job.
    """
    pending = queue.filter(F.col("status") == "pending")
    rest = queue.filter(F.col("status") != "pending")
    return merge_rows(pending, wanted, ["company_id"], overwrite=["priority"]).unionByName(rest)


def apply_results(queue: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """P-31: state transitions from (queue_id, result, error).

    started: processing.  completed: done.  failed: 'failed' when the attempts are used up, else pending again in
    one hour.  Every "started" row of a job is an attempt more, whatever else the batch says of the job, and counts
    before the attempts are judged; rows that repeat an `event_id`, if there is such a column, count once.  Of several
    results a final one decides, completed before failed, with the greatest error text.
    """
    now = as_time(as_of)
    if "event_id" in results.columns:
        results = results.dropDuplicates(["queue_id", "event_id"])
    final = F.when(F.col("result") == "completed", 2).when(F.col("result") == "failed", 1).otherwise(0)
    res = results.filter(F.col("queue_id").isNotNull()).groupBy("queue_id").agg(
        F.max_by("result", final).alias("_r"), F.max_by("error", F.struct(final, "error")).alias("_e"),
        F.count_if(F.col("result") == "started").cast("int").alias("_starts"))
    out = queue.join(res, "queue_id", "left")
    r = F.col("_r")
    attempts = F.col("attempts") + F.coalesce("_starts", F.lit(0))
    spent = attempts >= F.col("max_attempts")
    changed = {
        "status": F.when(r == "started", "processing").when(r == "completed", "completed")
        .when((r == "failed") & spent, "failed").when(r == "failed", "pending").otherwise(F.col("status")),
        "attempts": attempts,
        "started_at": F.when(F.col("_starts") > 0, now).otherwise(F.col("started_at")),
        "completed_at": F.when(r == "completed", now).otherwise(F.col("completed_at")),
        "scheduled_for": F.when(r == "failed", now + F.expr("INTERVAL '1' HOUR")).otherwise(F.col("scheduled_for")),
        "error_message": F.when(r == "failed", F.col("_e")).otherwise(F.col("error_message")),
        "updated_at": F.when(r.isNotNull(), now).otherwise(F.col("updated_at")),
    }
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in queue.columns])


def assign_batch(queue: DataFrame, n: int, workers: int, as_of: str) -> DataFrame:
    """P-32: the next n jobs, split over w workers without overlap.  The window sees only those n rows."""
    order = [F.desc("priority"), F.asc("created_at"), F.asc("queue_id")]
    slots = F.ntile(workers).over(Window.orderBy(*order))
    return next_jobs(queue, n, as_of).withColumn("worker", slots)


def reset_stale(queue: DataFrame, as_of: str, minutes: int = 20) -> DataFrame:
    """P-33: jobs that have been running too long are pending again."""
    limit = as_time(as_of) - F.expr(f"INTERVAL '{int(minutes)}' MINUTE")
    old = (F.col("status") == "in_progress") & (F.col("started_at").isNull() | (F.col("started_at") < limit))
    marked = queue.withColumn("_stale", F.coalesce(old, F.lit(False)))
    return (marked.withColumn("status", F.when(F.col("_stale"), F.lit("pending")).otherwise(F.col("status")))
            .withColumn("started_at", F.when(~F.col("_stale"), F.col("started_at"))).drop("_stale"))


def skip_completed(queue: DataFrame, areas: DataFrame) -> DataFrame:
    """P-33: pending rows of finished areas become skipped."""
    done = is_completed(queue.filter(F.col("status") == "pending"), areas).select("queue_id").withColumn("_done", F.lit(True))
    out = queue.join(done, "queue_id", "left")
    status = F.when(F.col("_done"), F.lit("skipped")).otherwise(F.col("status"))
    return out.withColumn("status", status).select(*queue.columns)


def clear_done(queue: DataFrame) -> DataFrame:
    """P-33."""
    return queue.filter(~F.col("status").isin("completed", "failed"))

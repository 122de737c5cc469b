"""The control plane as append-only tables: jobs, checkpoints, a cache with expiry, a ledger of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params

# The stages in order, and the job states that end a job.
STAGES = ("ingest", "transcribe", "context", "entities", "segment", "queries", "image_search", "download", "dedupe", "rank", "video_search", "timestamps", "clips", "collect", "report")
TERMINAL = ("COMPLETE", "REVIEW_REQUIRED", "FAILED")


def stage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STAGES)), "ord int, stage string")


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last entry of each key of an append-only log: what an update in place would leave."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def rejection(project: Column, source_path: Column) -> Column:
    """Why a request for a job is turned down; null for a good one."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(project), "project name is empty").when(blank(source_path), "source_path is empty")


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """job_id, project, source_path, state, error, finished_at of all jobs after the requests (request_id, job_id, project, source_path).

    A request without a job_id makes a job named by its request_id. One for a known job queues that again and leaves its project and path
    alone; of several for one unknown id the first (by request_id) makes it. Requests that `rejection` turns down change nothing.
    """
    good = requests.where(rejection(F.col("project"), F.col("source_path")).isNull())
    named = good.select(F.coalesce(F.col("job_id"), F.col("request_id").cast("string")).alias("job_id"), "request_id", F.struct("project", "source_path").alias("new"))
    asked = named.groupBy("job_id").agg(F.min_by("new", "request_id").alias("new"))
    known, wanted = F.col("state").isNotNull(), F.col("new").isNotNull()
    own = lambda c: F.when(known, F.col(c)).otherwise(F.col(f"new.{c}")).alias(c)
    return jobs.join(asked, "job_id", "full").select(
        "job_id", own("project"), own("source_path"), F.when(wanted, "QUEUED").otherwise(F.col("state")).alias("state"), F.when(wanted, "").otherwise(F.col("error")).alias("error"), F.when(~wanted, F.col("finished_at")).alias("finished_at"),
    )


def list_jobs(jobs: DataFrame, state: str | None = None, limit: int = 50) -> DataFrame:
    """The newest jobs, of one state if asked for."""
    return (jobs if state is None else jobs.where(F.col("state") == state)).orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest queued job (the reading half of a claim: a claim itself needs a lock that a table does not give)."""
    return jobs.where("state = 'QUEUED'").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id"), F.min("created_at").alias("created_at")).where("job_id is not null")


def completed_stages(checkpoints: DataFrame) -> DataFrame:
    return latest(checkpoints, ["job_id", "stage"], [F.desc("at"), F.desc("seq")]).where("ok").select("job_id", "stage")


def resume_point(jobs: DataFrame, checkpoints: DataFrame, stages: DataFrame) -> DataFrame:
    """The first stage of each job without an ok checkpoint, else the last stage. All stages count; the product is one row a job and stage."""
    every = jobs.select("job_id").distinct().crossJoin(stages)
    left = every.join(completed_stages(checkpoints), ["job_id", "stage"], "left_anti").groupBy("job_id").agg(F.min_by("stage", "ord").alias("stage"))
    return jobs.select("job_id").distinct().join(left, "job_id", "left").select("job_id", F.coalesce("stage", F.lit(STAGES[-1])).alias("stage"))


def clear_checkpoints(checkpoints: DataFrame, jobs: DataFrame) -> DataFrame:
    return checkpoints.join(jobs.select("job_id").distinct(), "job_id", "left_anti")


def stale_jobs(jobs: DataFrame, now: Column, params: Params = DEFAULTS) -> DataFrame:
    """Jobs that have not ended and whose last heartbeat is too old."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("heartbeat_at").cast("timestamp"))
    return jobs.where(~F.col("state").isin(*TERMINAL) & F.col("heartbeat_at").isNotNull() & (age > params.stale_after_s * 1_000_000))


def claim_names(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The first of each file name without regard to case that the ledger does not hold."""
    keyed = files.withColumn("key", F.lower("name"))
    return latest(keyed, ["key"], [F.col("arrival"), F.col("name")]).join(ledger.select(F.lower("filename").alias("key")).distinct(), "key", "left_anti")


def release_names(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger (filename, status, job_id) with what `done` (the same columns, one row a name) says of its names; other names of `done` are ignored."""
    said = done.select(F.lower("filename").alias("key"), F.struct("status", "job_id").alias("said"))
    joined = ledger.withColumn("key", F.lower("filename")).join(said, "key", "left")
    new = lambda c: F.when(F.col("said").isNotNull(), F.col(f"said.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("filename", new("status"), new("job_id"))


def discard_names(ledger: DataFrame, names: DataFrame) -> DataFrame:
    """The ledger without the claims on the names (column filename), so that the files can be taken again."""
    gone = names.select(F.lower("filename").alias("key")).distinct()
    return ledger.withColumn("key", F.lower("filename")).join(gone, "key", "left_anti").drop("key")


def stage_timings(checkpoints: DataFrame, stages: DataFrame) -> DataFrame:
    last = latest(checkpoints, ["job_id", "stage"], [F.desc("at"), F.desc("seq")])
    return last.join(stages, "stage").select("job_id", "ord", "stage", "seconds")


def cache_live(cache: DataFrame, now: Column) -> DataFrame:
    """The last entry of each key, if it has not expired."""
    return latest(cache, ["key"], [F.desc("created_at"), F.desc("seq")]).where(F.col("expires_at") > now)


def cache_get(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests by key with the value that is alive, null for a miss."""
    return requests.join(cache_live(cache, now).select("key", "value"), "key", "left")


def cache_stats(cache: DataFrame, now: Column) -> DataFrame:
    last = latest(cache, ["key"], [F.desc("created_at"), F.desc("seq")])
    return last.groupBy("provider").agg(F.count("*").alias("entries"), F.count_if(F.col("expires_at") <= now).alias("expired"), F.sum("hits").alias("hits"))


def cache_purge(cache: DataFrame, now: Column, provider: str | None = None) -> DataFrame:
    """What stays: entries alive, or all but one provider's."""
    return cache.where(F.col("expires_at") > now) if provider is None else cache.where(F.col("provider") != provider)


def complete_segments(segments: DataFrame, manifests: DataFrame, picks: DataFrame) -> DataFrame:
    """segments with complete: a manifest stands, and there are picks or nothing ranked to pick from."""
    have = manifests.groupBy("project", "index").agg(F.count_if(F.col("rank") >= 1).alias("ranked"))
    chosen = picks.groupBy("project", "index").agg(F.count("*").alias("chosen"))
    joined = segments.join(have, ["project", "index"], "left").join(chosen, ["project", "index"], "left")
    return joined.withColumn("complete", F.col("ranked").isNotNull() & ((F.coalesce("chosen", F.lit(0)) > 0) | (F.col("ranked") == 0))).drop("ranked", "chosen")


def replace_segment(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table with the segments that `fresh` holds replaced by its rows; clips picked before stay."""
    keys = fresh.select("project", "index").distinct()
    kept = table.join(keys, ["project", "index"], "left_anti")
    clips = table.where("kind = 'clip'").join(keys, ["project", "index"], "left_semi")
    return kept.unionByName(clips).unionByName(fresh)


def next_stage(stage: Column) -> Column:
    """The stage after; null after the last."""
    return F.try_element_at(F.create_map(*[x for a, b in zip(STAGES, STAGES[1:]) for x in (F.lit(a), F.lit(b))]), stage)


def disk_reservations(reservations: DataFrame, free_bytes: Column) -> DataFrame:
    """job_id, bytes in order of arrival -> granted, while what the others hold leaves room."""
    before = Window.partitionBy("drive").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return reservations.withColumn("held", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("granted", F.col("held") + F.col("bytes") <= free_bytes)

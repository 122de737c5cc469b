"""Queries that change jobs, claims, checkpoints and the cache: orders as requests, events as jobs, parts as files; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import control
from . import delivery
from .tables import load


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are done ask for their customer's job, others for a new one; unclear ones lack a project, low ones under way a path."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.when(status == "F", F.concat(F.lit("job-"), F.col("o_custkey"))).alias("job_id"),
        F.when(priority == "4-NOT SPECIFIED", " ").otherwise(priority).alias("project"), F.when(~((status == "P") & (priority == "5-LOW")), F.concat(F.lit("/in/"), F.col("o_orderkey"))).alias("source_path"),
    )


def enqueue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = delivery.latest_state(spark, sf_dir)
    ended = F.col("state").isin(*control.TERMINAL)
    jobs = last.select(F.concat(F.lit("job-"), F.col("job_id")).alias("job_id"), F.lit("events").alias("project"), F.concat(F.lit("/seen/"), F.col("seq")).alias("source_path"), "state", F.when(F.col("state") == "FAILED", "broken").otherwise("").alias("error"), F.when(ended, F.col("seq")).alias("finished_at"))
    return control.enqueue(jobs, _requests(spark, sf_dir))


def enqueue_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("request_id", control.rejection(F.col("project"), F.col("source_path")).alias("reason")).where("reason is not null")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_name").alias("filename")).distinct().select("filename", F.lit("claimed").alias("status"), F.lit(None).cast("long").alias("job_id"))


def release_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = load(spark, sf_dir, "part").where("p_size >= 45").groupBy(F.upper("p_name").alias("filename")).agg(F.lit("processed").alias("status"), F.min("p_partkey").alias("job_id"))
    return control.release_names(_ledger(spark, sf_dir), done)


def discard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.discard_names(_ledger(spark, sf_dir), load(spark, sf_dir, "part").where("p_size >= 45").select(F.upper("p_name").alias("filename"))).select("filename", "status")


def cache_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = load(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    key = T.cache_key(F.col("event_type"), F.lit("search"), F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit("}")))
    return control.cache_get(asked.withColumn("key", key), delivery._cache(spark, sf_dir), delivery._cutoff()).select("event_type", "user_id", "value")


def cache_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = delivery._cache(spark, sf_dir)
    expired, one = control.cache_purge(cache, delivery._cutoff()), control.cache_purge(cache, delivery._cutoff(), "view")
    return expired.select(F.lit("expired").alias("purged"), "seq").union(one.select(F.lit("view"), "seq"))


def clear_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of jobs whose last state is not COMPLETE."""
    complete = delivery.latest_state(spark, sf_dir).where("state = 'COMPLETE'")
    return control.clear_checkpoints(delivery._checkpoints(spark, sf_dir), complete).select("job_id", "stage", "seq")


QUERIES = {f.__name__: f for f in (enqueue_jobs, enqueue_rejected, release_names, discard_names, cache_get, cache_purge, clear_checkpoints)}

_REQUESTS = """requests AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'F' THEN 'job-' || o_custkey END AS job_id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ' ' ELSE o_orderpriority END AS project,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE '/in/' || o_orderkey END AS source_path FROM orders),
judged AS (SELECT *, CASE WHEN trim(coalesce(project, '')) = '' THEN 'project name is empty' WHEN trim(coalesce(source_path, '')) = '' THEN 'source_path is empty' END AS reason FROM requests)"""
_CUTOFF = "TIMESTAMP '2024-01-20 00:00:00'"

ORACLE_SQL = {
    "enqueue_jobs": f"""WITH {delivery._JOBS}, {_REQUESTS},
old AS (SELECT 'job-' || job_id AS job_id, 'events' AS project, '/seen/' || seq AS source_path, state, CASE WHEN state = 'FAILED' THEN 'broken' ELSE '' END AS error, CASE WHEN state IN ('COMPLETE', 'REVIEW_REQUIRED', 'FAILED') THEN seq END AS finished_at FROM last),
asked AS (SELECT coalesce(job_id, CAST(request_id AS VARCHAR)) AS job_id, project, source_path FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY coalesce(job_id, CAST(request_id AS VARCHAR)) ORDER BY request_id) = 1)
SELECT * FROM old WHERE job_id NOT IN (SELECT job_id FROM asked)
UNION ALL SELECT job_id, project, source_path, 'QUEUED', '', NULL FROM old WHERE job_id IN (SELECT job_id FROM asked)
UNION ALL SELECT job_id, project, source_path, 'QUEUED', '', NULL FROM asked WHERE job_id NOT IN (SELECT job_id FROM old)""",
    "enqueue_rejected": f"WITH {_REQUESTS} SELECT request_id, reason FROM judged WHERE reason IS NOT NULL",
    "release_names": "SELECT p_name AS filename, CASE WHEN max(p_size) >= 45 THEN 'processed' ELSE 'claimed' END AS status, min(p_partkey) FILTER (WHERE p_size >= 45) AS job_id FROM part GROUP BY p_name",
    "discard_names": "SELECT p_name AS filename, 'claimed' AS status FROM part GROUP BY p_name HAVING max(p_size) < 45",
    "cache_get": f"""WITH {delivery._CACHE},
asked AS (SELECT DISTINCT event_type, user_id, sha256(event_type || chr(0) || 'search' || chr(0) || '{{"user":' || user_id || '}}') AS key FROM events)
SELECT a.event_type, a.user_id, l.value FROM asked a LEFT JOIN (SELECT * FROM last WHERE expires_at > {_CUTOFF}) l ON l.key = a.key""",
    "cache_purge": f"WITH {delivery._CACHE} SELECT 'expired' AS purged, seq FROM cache WHERE expires_at > {_CUTOFF} UNION ALL SELECT 'view', seq FROM cache WHERE provider <> 'view'",
    "clear_checkpoints": f"""WITH {delivery._JOBS}, stages(ord, stage) AS (VALUES {delivery._STAGES})
SELECT user_id % 40 AS job_id, stage, event_id AS seq FROM events JOIN stages ON ord = event_id % 15 WHERE user_id % 40 NOT IN (SELECT job_id FROM last WHERE state = 'COMPLETE')""",
}

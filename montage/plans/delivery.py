"""Queries over delivery and control: documents and vectors as segments and picks, events as jobs and stages; and their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import control, deliver, politeness
from ..streaming import watch
from .tables import load


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as segments of their source, in order of id."""
    docs = load(spark, sf_dir, "documents")
    index = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    notes = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("searched twice"), F.lit("no clip was found"), F.lit("thin"))).otherwise(F.array(F.lit("fine")))
    return docs.select(F.col("source").alias("project"), index.alias("index"), (F.col("doc_id") % 90 / 100.0).alias("confidence"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(" | "), F.col("lang")).alias("label"), (F.col("n_chars") % 7000).cast("double").alias("start"), (F.col("n_chars") % 7000 + 8).cast("double").alias("end"), notes.alias("notes"), "doc_id")


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three picks a segment: a clip and two images."""
    seg = _segments(spark, sf_dir).select("project", "index", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    k, d = F.col("k"), F.col("doc_id")
    return seg.select(
        "project", "index", F.when(k == 0, "clip").otherwise("image").alias("kind"), F.concat(F.lit("/m/"), d.cast("string"), F.lit("_"), k.cast("string"), F.when(k == 0, ".MP4").otherwise(".jpg")).alias("path"), (F.lit(3) - k).alias("rank"), (d * (k + 3) % 101 / 100.0).alias("score"),
        F.when(d % 10 == 0, 0.0).otherwise(d * (k + 3) % 101 / 100.0).alias("confidence"), ((d + k) % 4 != 0).alias("use"), (d % 17 == 0).alias("user_set"), "doc_id", "k",
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return labels.groupBy(deliver.confidence_band(F.col("n_chars") % 101 / 100.0).alias("band"), "quality").agg(F.count("*").alias("n"))


def selected_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.plan_selected(_segments(spark, sf_dir), _picks(spark, sf_dir))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.gaps(_segments(spark, sf_dir), selected_plan(spark, sf_dir)).select("project", "index", deliver.gap_reason(F.col("notes")).alias("reason"))


def shotlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.shotlist(_segments(spark, sf_dir), selected_plan(spark, sf_dir))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), "doc_id", F.col("n_chars").alias("bytes"))
    wanted = docs.where("doc_id % 3 <> 0").withColumn("bytes", F.when(F.col("doc_id") % 11 != 0, F.col("bytes")))
    on_disk = docs.where("doc_id % 4 <> 1").withColumn("bytes", F.when(F.col("doc_id") % 5 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return deliver.snapshot_diff(wanted, on_disk, docs.where("doc_id % 2 = 0"))


def rename_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    name = lambda k: F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % k == 0, "_SELECTED").otherwise(""), F.lit(".jpg"))
    return deliver.rename_diff(docs.where("doc_id % 7 <> 0").select(F.col("source").alias("project"), name(2).alias("name")), docs.where("doc_id % 5 <> 0").select(F.col("source").alias("project"), name(3).alias("name")))


def all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _picks(spark, sf_dir).where("kind = 'image'").withColumn("query", F.when(F.col("doc_id") % 3 == 0, "").otherwise("Some Query"))
    return deliver.all_candidates(_segments(spark, sf_dir), ranked, selected_plan(spark, sf_dir))


def _credited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    planned, picks = selected_plan(spark, sf_dir), _picks(spark, sf_dir)
    d = F.col("doc_id")
    images = picks.where("kind = 'image' and doc_id % 6 <> 0").select("project", "index", F.concat(F.lit("/other"), "path").alias("path"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), "doc_id")
    images = images.select("project", "index", "path", "ord", F.concat(F.lit("http://i/"), d.cast("string"), F.lit("/"), F.col("ord").cast("string")).alias("image_url"), F.lit("http://page").alias("source_page"), F.lit("who").alias("creator"), F.when(d % 2 == 0, "CC0").otherwise("").alias("license"), F.lit("").alias("license_url"), F.lit("q").alias("query"))
    videos = picks.where("kind = 'clip' and doc_id % 4 <> 1").select("project", "index", F.col("path").alias("clip_path"), F.lit(1).alias("ord"), F.concat(F.lit("http://v?id="), d.cast("string"), F.lit("&t=5s")).alias("url"), F.lit("channel").alias("channel"), (d % 4000).cast("double").alias("start"), F.lit("vq").alias("query"))
    return planned, deliver.credits(planned, images, videos)


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _credited(spark, sf_dir)[1]


def credits_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.credits_match(*_credited(spark, sf_dir))


def project_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.project_page(_segments(spark, sf_dir), _picks(spark, sf_dir)).select("project", "index", "best", "picks", "band")


def image_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = load(spark, sf_dir, "embeddings").select(F.lit("p").alias("project"), F.col("label").alias("index"), F.col("vec_id").cast("string").alias("path"), (F.col("vec_id") % 12).alias("rank"), (F.col("vec_id") * 7 % 100 / 100.0).alias("score"))
    picks = records.where("rank = 1").select("project", "index", "path", F.lit(True).alias("use"), F.lit(False).alias("rejected"))
    return deliver.image_grid(records, picks).select("index", "path", "place", "use")


def pick_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = _picks(spark, sf_dir).select("project", "index", "path", "kind", "rank", "confidence", "use", "user_set", F.lit(False).alias("favorite"), F.lit(False).alias("rejected"), "doc_id")
    none = F.lit(None).cast("boolean")
    actions = picks.where("doc_id % 3 = 0").select("project", "index", "path", F.when(F.col("doc_id") % 2 == 0, F.lit(True)).otherwise(none).alias("use"), F.when(F.col("doc_id") % 5 == 0, F.lit(True)).otherwise(none).alias("rejected"), F.when(F.col("doc_id") % 7 == 0, F.lit(True)).otherwise(none).alias("favorite"))
    return deliver.apply_actions(picks.drop("doc_id"), actions)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of jobs: users are jobs, event types their states."""
    state = F.create_map(*[F.lit(x) for x in ("signup", "QUEUED", "view", "RANKING", "click", "TRANSCRIBING", "purchase", "COMPLETE", "error", "FAILED")])
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.element_at(state, F.col("event_type")).alias("state"), "value", "event_type")


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.latest(_jobs(spark, sf_dir), ["job_id"], [F.desc("ts"), F.desc("seq")]).select("job_id", "state", "seq")


def jobs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = control.latest(_jobs(spark, sf_dir), ["job_id"], [F.desc("ts"), F.desc("seq")]).withColumnRenamed("ts", "created_at")
    return control.list_jobs(jobs, "RANKING").select("job_id", "seq")


def claim_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = control.latest(_jobs(spark, sf_dir), ["job_id"], [F.desc("ts"), F.desc("seq")]).withColumnRenamed("ts", "created_at")
    return control.next_job(jobs).select("job_id")


def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = control.latest(_jobs(spark, sf_dir), ["job_id"], [F.desc("ts"), F.desc("seq")]).withColumnRenamed("ts", "heartbeat_at")
    now = jobs.agg(F.max("heartbeat_at").alias("now"))
    return control.stale_jobs(jobs.crossJoin(F.broadcast(now)), F.col("now")).select("job_id", "state")


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.array(*[F.lit(s) for s in control.STAGES])
    return load(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("job_id"), F.element_at(stages, (F.col("event_id") % 15 + 1).cast("int")).alias("stage"), (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("value").alias("seconds"))


def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints = _checkpoints(spark, sf_dir)
    return control.resume_point(checkpoints, checkpoints, control.stage_table(spark))


def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.stage_timings(_checkpoints(spark, sf_dir), control.stage_table(spark))


def stage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("project"), F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 2).alias("seconds"))
    return deliver.stage_share(timings)


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.model_calls(_segments(spark, sf_dir))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    key = T.cache_key(F.col("event_type"), F.lit("search"), F.concat(F.lit('{"user":'), (F.col("user_id") % 50).cast("string"), F.lit("}")))
    return rows.select(key.alias("key"), F.col("event_type").alias("provider"), F.col("props").alias("value"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires_at"), F.lit(1).alias("hits"))


def _cutoff() -> Column:
    return F.to_timestamp(F.lit("2024-01-20 00:00:00"))


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir).select("key", "seq")


def cache_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.cache_live(_cache(spark, sf_dir), _cutoff()).select("key", "seq", "value")


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.cache_stats(_cache(spark, sf_dir), _cutoff())


def claim_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_partkey").alias("arrival"))
    ledger = load(spark, sf_dir, "part").where("p_partkey < 20").select(F.col("p_name").alias("filename"))
    return control.claim_names(files, ledger).select("key", "arrival")


def rate_limit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = load(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("string").alias("host"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) % 3_600_000).cast("long").alias("at_ms"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("refused"))
    return politeness.host_waits(requests).select("host", "seq", "factor", "wait_ms")


def stable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = load(spark, sf_dir, "events").select((F.col("user_id") % 25).cast("string").alias("path"), (F.col("event_id") % 3).cast("long").alias("bytes"), F.col("ts").alias("seen_at"))
    return watch.stable(seen).select("path", "bytes", F.date_format("since", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("since"))


def seen_files_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files put into a folder in two goes, watched by a stream that counts each name once; the ledger that it leaves."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = f"{shared}/watch-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="montage-watch-")
    folder, ledger, check = f"{root}/in", f"{root}/ledger", f"{root}/check"
    for go in range(2):
        rows = load(spark, sf_dir, "region").select(F.col("r_name").alias("value"))
        rows.coalesce(1).write.mode("append").text(f"{folder}/go={go}")
        files = watch.watch_folder(spark, f"{folder}/go=*", ("txt",))
        watch.deliver(watch.first_arrivals(files).select("key", "bytes"), check, lambda batch, _: batch.write.mode("append").parquet(ledger)).awaitTermination()
    return spark.read.parquet(ledger).groupBy("bytes").agg(F.count("*").alias("files"))


QUERIES = {
    f.__name__: f
    for f in (
        bands, selected_plan, gaps, shotlist, snapshot_diff, rename_diff, all_candidates, credits, credits_match, project_page, image_grid, pick_actions, latest_state, jobs_recent, claim_oldest, stale_jobs, resume_point, stage_timings, stage_share,
        model_calls, cache_key, cache_live, cache_stats, claim_names, rate_limit_state, stable_files, seen_files_stream,
    )
}

_SEG = """seg AS (SELECT source AS project, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS index, doc_id % 90 / 100.0::DOUBLE AS confidence, 'Doc ' || doc_id || ' | ' || lang AS label, (n_chars % 7000)::DOUBLE AS start, (n_chars % 7000 + 8)::DOUBLE AS stop,
  CASE WHEN doc_id % 2 = 0 THEN 'no clip was found' END AS reason, doc_id FROM documents),
widths AS (SELECT project, greatest(3, length(CAST(max(index) AS VARCHAR))) AS width FROM seg GROUP BY project),
picks AS (SELECT project, index, CASE WHEN k = 0 THEN 'clip' ELSE 'image' END AS kind, '/m/' || doc_id || '_' || k || CASE WHEN k = 0 THEN '.MP4' ELSE '.jpg' END AS path, CAST(3 - k AS INTEGER) AS rank, CASE WHEN doc_id % 10 = 0 THEN 0.0::DOUBLE ELSE doc_id * (k + 3) % 101 / 100.0::DOUBLE END AS confidence,
  (doc_id + k) % 4 <> 0 AS use, doc_id % 17 = 0 AS user_set, doc_id, k, label, confidence AS of_segment FROM seg, range(3) r(k)),
sure AS (SELECT *, coalesce(nullif(confidence, 0), of_segment, 0) AS c FROM picks WHERE use),
plan AS (SELECT project, index, CAST(row_number() OVER (PARTITION BY project, index ORDER BY kind <> 'clip', rank, path) AS INTEGER) AS position, kind, path, c AS confidence, CASE WHEN c >= 0.85::DOUBLE THEN 'high' WHEN c >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS band, label, doc_id, k FROM sure WHERE user_set OR c >= 0.6::DOUBLE),
slugged AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM plan),
planned AS (SELECT s.*, lpad(CAST(index AS VARCHAR), CAST(width AS INTEGER), '0') || '_' || position || '_' || slug || '.' || lower(split_part(path, '.', 2)) AS name FROM slugged s JOIN widths USING (project))"""
_CODE = lambda x: f"CASE WHEN {x} >= 3600 THEN printf('%d:%02d:%02d', {x} // 3600, {x} % 3600 // 60, {x} % 60) ELSE printf('%d:%02d', {x} // 60, {x} % 60) END"
_JOBS = """jobs AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RANKING' WHEN 'click' THEN 'TRANSCRIBING' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAILED' END AS state FROM events),
last AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1)"""
_STAGES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(control.STAGES))
_CHECKS = f"""stages(ord, stage) AS (VALUES {_STAGES}),
checks AS (SELECT user_id % 40 AS job_id, stage, ord, event_type <> 'error' AS ok, ts, event_id AS seq, value AS seconds FROM events JOIN stages ON ord = event_id % 15),
last AS (SELECT * FROM checks QUALIFY row_number() OVER (PARTITION BY job_id, stage ORDER BY ts DESC, seq DESC) = 1)"""
_CACHE = """cache AS (SELECT sha256(event_type || chr(0) || 'search' || chr(0) || '{"user":' || user_id % 50 || '}') AS key, event_type AS provider, props AS value, ts, event_id AS seq, ts + INTERVAL 6 HOUR AS expires_at FROM events),
last AS (SELECT * FROM cache QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1)"""
_CREDITS = f"""{_SEG},
credited AS (SELECT project, name, index, kind, band, CASE WHEN kind = 'clip' THEN CASE WHEN doc_id % 4 <> 1 THEN 'http://v?id=' || doc_id || '&t=5s' ELSE '' END ELSE CASE WHEN doc_id % 6 <> 0 THEN 'http://i/' || doc_id || '/2' ELSE '' END END AS source_url,
  CASE WHEN kind = 'clip' THEN CASE WHEN doc_id % 4 <> 1 THEN 'http://v?id=' || doc_id ELSE '' END ELSE CASE WHEN doc_id % 6 <> 0 THEN 'http://page' ELSE '' END END AS source_page,
  CASE WHEN kind = 'clip' THEN CASE WHEN doc_id % 4 <> 1 THEN 'channel' ELSE '' END ELSE CASE WHEN doc_id % 6 <> 0 THEN 'who' ELSE '' END END AS creator,
  CASE WHEN kind = 'clip' AND doc_id % 4 <> 1 THEN {_CODE('(doc_id % 4000)')} ELSE '' END AS timestamp, CASE WHEN kind = 'image' AND doc_id % 6 <> 0 AND doc_id % 2 = 0 THEN 'CC0' ELSE 'unknown' END AS license, '' AS license_url,
  CASE WHEN kind = 'clip' THEN CASE WHEN doc_id % 4 <> 1 THEN 'vq' ELSE '' END ELSE CASE WHEN doc_id % 6 <> 0 THEN 'q' ELSE '' END END AS query FROM planned)"""

ORACLE_SQL = {
    "bands": "SELECT CASE WHEN n_chars % 101 / 100.0::DOUBLE >= 0.85::DOUBLE THEN 'high' WHEN n_chars % 101 / 100.0::DOUBLE >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS band, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2",
    "selected_plan": f"WITH {_SEG} SELECT project, index, position, kind, path, confidence, band, name FROM planned",
    "gaps": f"WITH {_SEG} SELECT project, index, reason FROM seg s WHERE NOT EXISTS (SELECT 1 FROM planned p WHERE p.project = s.project AND p.index = s.index)",
    "shotlist": f"""WITH {_SEG}, files AS (SELECT project, index, string_agg(name, ', ' ORDER BY position) AS files FROM planned GROUP BY ALL)
SELECT project, index, '| ' || {_CODE('CAST(start AS BIGINT)')} || '-' || {_CODE('CAST(stop AS BIGINT)')} || ' | ' || replace(label, '|', '\\|') || ' | ' || coalesce(files, 'gap: ' || coalesce(reason, 'nothing confident')) || ' |' AS line FROM seg LEFT JOIN files USING (project, index)""",
    "snapshot_diff": """WITH d AS (SELECT source AS project, 'f' || doc_id AS name, doc_id, n_chars FROM documents)
SELECT project, name, CASE WHEN doc_id % 3 <> 0 AND doc_id % 11 = 0 THEN 'missing_source' WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 1 AND doc_id % 5 <> 0 THEN 'unchanged' WHEN doc_id % 3 <> 0 THEN 'written' WHEN doc_id % 2 = 0 THEN 'removed' ELSE 'foreign' END AS action FROM d WHERE doc_id % 3 <> 0 OR doc_id % 4 <> 1""",
    "rename_diff": """WITH w AS (SELECT source AS project, doc_id, doc_id || CASE WHEN doc_id % 2 = 0 THEN '_SELECTED' ELSE '' END || '.jpg' AS name FROM documents WHERE doc_id % 7 <> 0),
o AS (SELECT source AS project, doc_id, doc_id || CASE WHEN doc_id % 3 = 0 THEN '_SELECTED' ELSE '' END || '.jpg' AS old FROM documents WHERE doc_id % 5 <> 0)
SELECT project, name, old, CASE WHEN old IS NULL THEN 'written' WHEN name IS NULL THEN 'removed' WHEN name = old THEN 'unchanged' ELSE 'renamed' END AS action FROM w FULL JOIN o USING (project, doc_id)""",
    "all_candidates": f"""WITH {_SEG}, chosen AS (SELECT DISTINCT project, path FROM planned WHERE kind = 'image')
SELECT p.project, p.index, p.rank, p.path, lpad(CAST(p.index AS VARCHAR), CAST(width AS INTEGER), '0') || '_' || printf('%02dm%02ds', CAST(s.start AS BIGINT) // 60, CAST(s.start AS BIGINT) % 60) || '_' || lpad(CAST(p.rank AS VARCHAR), 2, '0') || '_' || CASE WHEN p.doc_id % 3 = 0 THEN trim(regexp_replace(lower(s.label), '[^a-z0-9]+', '_', 'g'), '_') ELSE 'some_query' END
  || CASE WHEN c.path IS NOT NULL THEN '_SELECTED' ELSE '' END || '.jpg' AS name, c.path IS NOT NULL AS selected FROM picks p JOIN seg s USING (project, index) JOIN widths w ON w.project = p.project LEFT JOIN chosen c ON c.project = p.project AND c.path = p.path WHERE p.kind = 'image'""",
    "credits": f"WITH {_CREDITS} SELECT * FROM credited",
    "credits_match": f"WITH {_CREDITS} SELECT (SELECT count(*) FROM planned) AS files, (SELECT count(*) FROM credited) AS credits, (SELECT count(*) FROM planned) = (SELECT count(*) FROM credited) AS match",
    "project_page": f"""WITH {_SEG}, best AS (SELECT project, index, coalesce(max(confidence) FILTER (WHERE use), 0.0::DOUBLE) AS best, count(*) AS picks FROM picks GROUP BY ALL)
SELECT project, index, best, picks, CASE WHEN best >= 0.85::DOUBLE THEN 'high' WHEN best >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS band FROM best""",
    "image_grid": """WITH r AS (SELECT label AS index, CAST(vec_id AS VARCHAR) AS path, vec_id % 12 AS rank, vec_id * 7 % 100 / 100.0::DOUBLE AS score FROM embeddings),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY index ORDER BY coalesce(nullif(rank, 0), 999), score DESC, path) AS INTEGER) AS place FROM r) SELECT index, path, place, CASE WHEN rank = 1 THEN true END AS use FROM p WHERE place <= 24""",
    "pick_actions": f"""WITH {_SEG} SELECT project, index, path, kind, rank, confidence, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN false WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN true ELSE use END AS use, user_set OR (doc_id % 3 = 0 AND (doc_id % 2 = 0 OR doc_id % 5 = 0)) AS user_set,
  doc_id % 3 = 0 AND doc_id % 7 = 0 AS favorite, doc_id % 3 = 0 AND doc_id % 5 = 0 AS rejected FROM picks""",
    "latest_state": f"WITH {_JOBS} SELECT job_id, state, seq FROM last",
    "jobs_recent": f"WITH {_JOBS} SELECT job_id, seq FROM last WHERE state = 'RANKING' ORDER BY ts DESC, job_id DESC LIMIT 50",
    "claim_oldest": f"WITH {_JOBS} SELECT arg_min(job_id, {{'t': ts, 'j': job_id}}) AS job_id FROM last WHERE state = 'QUEUED' HAVING count(*) > 0",
    "stale_jobs": f"WITH {_JOBS} SELECT job_id, state FROM last WHERE state NOT IN ('COMPLETE', 'FAILED') AND epoch_us((SELECT max(ts) FROM last)) - epoch_us(ts) > 1800000000",
    "resume_point": f"""WITH {_CHECKS}, every AS (SELECT DISTINCT job_id FROM checks), open AS (SELECT e.job_id, arg_min(s.stage, s.ord) AS stage FROM every e CROSS JOIN stages s WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.job_id = e.job_id AND l.stage = s.stage AND l.ok) GROUP BY e.job_id)
SELECT job_id, coalesce(stage, 'report') AS stage FROM every LEFT JOIN open USING (job_id)""",
    "stage_timings": f"WITH {_CHECKS} SELECT job_id, ord, stage, seconds FROM last",
    "stage_share": "WITH t AS (SELECT user_id % 10 AS project, event_type AS stage, round(sum(value), 2) AS seconds FROM events GROUP BY ALL) SELECT project, stage, seconds, round(100 * seconds / sum(seconds) OVER (PARTITION BY project), 1) AS share FROM t",
    "model_calls": "SELECT source AS project, CAST(1 + ceil(count(*) / 20) AS BIGINT) AS calls FROM documents GROUP BY source",
    "cache_key": f"WITH {_CACHE} SELECT key, seq FROM cache",
    "cache_live": f"WITH {_CACHE} SELECT key, seq, value FROM last WHERE expires_at > TIMESTAMP '2024-01-20 00:00:00'",
    "cache_stats": f"WITH {_CACHE} SELECT provider, count(*) AS entries, count(*) FILTER (WHERE expires_at <= TIMESTAMP '2024-01-20 00:00:00') AS expired, count(*) AS hits FROM last GROUP BY provider",
    "claim_names": "SELECT lower(p_name) AS key, min(p_partkey) AS arrival FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey < 20) GROUP BY 1",
    "rate_limit_state": """WITH RECURSIVE r AS MATERIALIZED (SELECT CAST(user_id % 7 AS VARCHAR) AS host, epoch_us(ts) // 1000 % 3600000 AS t, event_id AS seq, event_type = 'error' AS refused, row_number() OVER (PARTITION BY user_id % 7 ORDER BY epoch_us(ts) // 1000 % 3600000, event_id) AS k FROM events),
walk AS (SELECT host, k, seq, 1.0::DOUBLE AS factor, CAST(0 AS BIGINT) AS wait_ms, t + 500 AS allowed, CASE WHEN refused THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS next FROM r WHERE k = 1
  UNION ALL SELECT r.host, r.k, r.seq, w.next, greatest(0, w.allowed - r.t), greatest(w.allowed, r.t) + CAST(500 * w.next AS BIGINT), CASE WHEN r.refused THEN least(16.0::DOUBLE, w.next * 2) ELSE w.next END FROM walk w JOIN r ON r.host = w.host AND r.k = w.k + 1)
SELECT host, seq, factor, wait_ms FROM walk""",
    "stable_files": """WITH s AS (SELECT CAST(user_id % 25 AS VARCHAR) AS path, event_id % 3 AS bytes, ts FROM events), l AS (SELECT path, arg_max(bytes, ts) AS bytes, max(ts) AS seen FROM s GROUP BY path),
c AS (SELECT l.path, l.bytes, l.seen, max(s.ts) FILTER (WHERE s.bytes <> l.bytes) AS changed FROM l JOIN s USING (path) GROUP BY ALL),
b AS (SELECT c.path, c.bytes, c.seen, min(s.ts) AS since FROM c JOIN s ON s.path = c.path AND (c.changed IS NULL OR s.ts > c.changed) GROUP BY ALL)
SELECT path, bytes, strftime(since, '%Y-%m-%d %H:%M:%S.%f') AS since FROM b WHERE bytes > 0 AND epoch_ms(seen) - epoch_ms(since) >= 3000""",
}

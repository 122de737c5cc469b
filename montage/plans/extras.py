"""Queries over the smaller operators: transcripts, prompts, context, answers of models, completeness, reports; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, control, dedupe, deliver, gather, lexicon, locate, politeness, rank, search, words
from .entities import query_build
from .media import _records
from .tables import load


def transcript_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: turns are segments with nested words; flattened in order."""
    turns = load(spark, sf_dir, "conversations")
    nested = F.transform(T.words(F.col("text")), lambda w, i: F.struct(w.alias("word"), (i * 1.0).alias("start"), (i + 0.5).alias("end")))
    one = turns.groupBy(F.col("conv_id").alias("project")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("id"), nested.alias("words")))).alias("segments"))
    flat = words.flatten_words(one)
    return flat.select("project", F.col("pos.i").alias("segment"), F.col("pos.j").alias("place"), "word", "start", "end")


def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    w = T.words(F.col("text"))
    return docs.select(
        "doc_id",
        rank.build_prompt(F.when(F.col("doc_id") % 3 == 0, F.array_join(F.slice(w, 1, 90), " ")).otherwise(""), F.when(F.col("doc_id") % 2 == 0, F.slice(w, 1, 6)).otherwise(F.slice(w, 1, 0)), F.lit(""), F.when(F.col("doc_id") % 5 == 0, F.col("lang")), F.lit("spoken words"), F.lit("Tale")).alias("prompt"),
    )


def subject_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    tag = search.subject_tag(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(""), F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_type", "p_brand", "p_name", "p_type")), F.col("p_brand"))
    return parts.select("p_partkey", search.strip_null_markers(F.concat(F.lit("N/A "), tag, F.lit(" unknown. x none"))).alias("tag"))


def thin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = dedupe.exact_duplicates(_records(spark, sf_dir), ["project"]).withColumn("keeper", F.when(F.col("duplicate"), F.col("keeper")))
    return dedupe.thin(marked, ["project"], 49)


def thin_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = query_build(spark, sf_dir)
    counted = queries.groupBy("project", "index").agg(F.count("*").alias("n"))
    return counted.join(search.thin_segments(queries).select("project", "index", F.lit(True).alias("thin")), ["project", "index"], "left").groupBy(F.coalesce("thin", F.lit(False)).alias("thin")).agg(F.count("*").alias("segments"))


def context_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as projects with a context half known, a model's answers for the rest."""
    n = load(spark, sf_dir, "nation")
    even = F.col("n_nationkey") % 2 == 0
    empty = F.array().cast("array<string>")
    lists = [F.when(even, F.array(F.col("n_name"), F.lit("Known"))).otherwise(empty).alias(c) for c in ("terminology", "characters", "places", "events")]
    known = n.select(F.col("n_nationkey").alias("project"), F.when(even, F.col("n_name")).otherwise("").alias("franchise"), F.lit("").alias("subject"), F.lit(None).cast("string").alias("search_tag"), *lists)
    told = [F.array(F.lower("n_name"), F.lit("New"), F.lit("KNOWN")).alias(c) for c in ("terminology", "characters", "places", "events")]
    answers = n.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("project"), F.lit("Told").alias("franchise"), F.lit("Subject").alias("subject"), F.lit("tag").alias("search_tag"), *told)
    fixes = n.where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("project"), F.lit(0.9).alias("confidence"), F.lit("x").alias("original"), F.lit("Resolved").alias("resolved"), F.lit(True).alias("applied"))
    filled = analysis.add_resolved(analysis.fill_context(known, answers), fixes)
    return filled.select("project", "franchise", "subject", "search_tag", F.array_join("terminology", "|").alias("terminology"), F.array_join("characters", "|").alias("characters"))


def answers_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as segments and as a model's answers about them."""
    rows = load(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("index"), F.col("p_size").cast("double").alias("start"), (F.col("p_size") + 8).cast("double").alias("end"), F.col("p_type").alias("flag"), F.col("p_partkey").alias("k"), (F.col("p_size") / 100.0).alias("d"))
    seg = rows.select("project", "index", "start", "end", F.lit("said").alias("narration"), F.lit("old").alias("topic"), F.lit("").alias("event"), F.lit("here").alias("location"), F.lit("").alias("interpretation"), F.array(F.lit("Old")).alias("entities"), F.lit("B_ROLL").alias("visual_intent"), F.lit(0.2).alias("confidence"))
    shot = lambda a, b: F.struct((F.col("start") + a).alias("start"), (F.col("start") + b).alias("end"), F.lit("t").alias("topic"))
    told = rows.where("k % 3 <> 0").select(
        "project", "index", F.when(F.col("k") % 2 == 0, " new ").otherwise("  ").alias("topic"), F.col("flag").alias("event"), F.lit(None).cast("string").alias("location"), F.lit("read").alias("interpretation"), F.when(F.col("k") % 5 == 0, F.array("flag")).otherwise(F.array().cast("array<string>")).alias("entities"),
        F.when(F.col("k") % 2 == 0, "comic").otherwise("nonsense").alias("visual_intent"), (F.col("d") * 30).alias("confidence"), F.array(shot(-5.0, 3.0), shot(7.0, 20.0), shot(9.0, 12.0)).alias("sub_shots"),
    )
    out = analysis.apply_analysis(seg, told)
    return out.select("project", "index", "topic", "event", "location", "visual_intent", F.round("confidence", 6).alias("confidence"), F.array_join("entities", ",").alias("entities"), F.size("sub_shots").alias("shots"), F.try_element_at("sub_shots", F.lit(1))["start"].alias("first_start"))


def model_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    open_names = parts.where("p_partkey % 2 = 0").select(F.col("p_type").alias("project"), F.col("p_name").alias("original"))
    answers = parts.groupBy(F.col("p_type").alias("project"), F.col("p_name").alias("original")).agg(F.min("p_partkey").alias("k"))
    told = answers.select("project", "original", F.when(F.col("k") % 7 == 0, " ").otherwise("Real").alias("resolved"), F.when(F.col("k") % 5 != 0, F.col("k") % 150 / 100.0).alias("confidence"), F.lit("model").alias("reason"))
    return lexicon.resolve_answers(told, open_names)


def complete_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.lit("p").alias("project"), F.col("o_orderkey").alias("index"))
    lines = load(spark, sf_dir, "lineitem")
    manifests = lines.where("l_orderkey % 5 <> 0").select(F.lit("p").alias("project"), F.col("l_orderkey").alias("index"), F.when(F.col("l_orderkey") % 7 == 0, 0).otherwise(F.col("l_linenumber")).alias("rank"))
    chosen = lines.where("l_returnflag = 'R'").select(F.lit("p").alias("project"), F.col("l_orderkey").alias("index"))
    return control.complete_segments(orders, manifests, chosen).select("index", "complete")


def segment_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select(F.lit("p").alias("project"), F.col("label").cast("int").alias("index"), F.when(F.col("vec_id") % 6 == 0, "clip").otherwise("image").alias("kind"), F.col("vec_id").cast("string").alias("path"))
    fresh = v.where("index = 3 and kind = 'image'").withColumn("path", F.concat(F.lit("new"), "path"))
    return control.replace_segment(v, fresh).groupBy("index", "kind").agg(F.count("*").alias("n"), F.min("path").alias("least"))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    hosts = pages.select("host").distinct()
    rule = lambda prefix, allow, at: hosts.select("host", F.lit(prefix).alias("prefix"), F.lit(allow).alias("allow"), F.to_timestamp(F.lit(at)).alias("fetched_at"))
    rules = rule("/", True, "2024-01-01 00:50:00").union(rule("/en/", False, "2024-01-01 00:50:00")).union(rule("/en/1", True, "2024-01-01 00:30:00")).union(rule("/fr/", False, "2023-12-31 00:00:00"))
    return politeness.allowed_by_robots(pages, rules, F.to_timestamp(F.lit("2024-01-01 01:00:00"))).select("id", "allowed")


def disk_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 20).alias("drive"), F.col("o_orderkey").alias("arrival"), F.round(F.col("o_totalprice")).cast("long").alias("bytes"))
    return control.disk_reservations(orders, F.lit(20_000_000)).select("arrival", "held", "granted")


def next_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.stage_table(spark).select("stage", control.next_stage(F.col("stage")).alias("next"))


def clip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.lit("p").alias("project"), F.col("l_orderkey").alias("index"), F.col("l_linenumber").alias("rank"), F.when(F.col("l_discount") > 0.08, "ok").when(F.col("l_tax") > 0.04, "low_confidence").otherwise("section_failed").alias("outcome"), F.lit("c.mp4").alias("path"), F.lit(0.9).alias("confidence"))
    taken, failed = locate.clip_picks(lines)
    return taken.groupBy(F.concat(F.lit("taken "), F.col("rank").cast("string")).alias("what")).agg(F.count("*").alias("n")).union(failed.groupBy(F.concat(F.lit("no clip: "), "reason").alias("what")).agg(F.count("*").alias("n")))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).alias("project"), F.col("o_orderkey").alias("index"), F.when(F.col("o_orderstatus") == "F", "degraded").otherwise("ok").alias("status"), (F.col("o_orderkey") % 5000 * 1.5).alias("start"), (F.col("o_orderkey") % 5000 * 1.5 + 8).alias("end"))


def project_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = load(spark, sf_dir, "lineitem").where("l_discount > 0.07").select(F.col("l_orderkey").alias("index"), F.when(F.col("l_linenumber") == 1, "clip").otherwise("image").alias("kind"), deliver.confidence_band(F.col("l_tax") * 12).alias("band"))
    seg = _segments(spark, sf_dir)
    return deliver.project_report(seg, planned.join(seg.select("project", "index"), "index"))


def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.segment_names(_segments(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(deliver.cell(F.col("text"))).alias("digest"), deliver.duration_text(F.col("n_chars") / 2.0).alias("duration"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("digest"))


def prefetch_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as candidates that are refused before their bytes are looked at."""
    k = F.col("page_id")
    pages = load(spark, sf_dir, "pages").select(
        gather.prefetch_rejection(
            F.concat("url", F.when(k % 9 == 0, ".SVG").otherwise("")), F.when(k % 4 != 0, k % 7 != 0), F.when(k % 11 == 0, "timeout"), F.when(k % 5 == 0, "text/html").when(k % 5 == 1, "Image/PNG"), F.when(k % 13 == 0, "../x").otherwise("x/y"), k % 17 == 0
        ).alias("reason")
    )
    return pages.groupBy("reason").agg(F.count("*").alias("n"))


def provider_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = load(spark, sf_dir, "orders").select(F.lit("p").alias("project"), F.col("o_orderkey").alias("index"), F.lit("ok").alias("status"), F.array(F.lit("note")).alias("notes"))
    failures = load(spark, sf_dir, "lineitem").where("l_tax > 0.06").select(F.lit("p").alias("project"), F.col("l_orderkey").alias("index"), F.concat(F.lit("provider"), (F.col("l_linenumber") % 3).cast("string")).alias("provider"), F.lit("timeout").alias("error"))
    return gather.with_failures(seg, failures).select("index", "status", F.array_join("notes", "|").alias("notes"))


QUERIES = {
    f.__name__: f
    for f in (
        transcript_words, build_prompts, subject_tags, thin_groups, thin_segments, context_fill, answers_applied, model_resolutions, complete_segments, segment_replaced, robots, disk_grants, next_stages, clip_reasons, project_report, segment_names,
        cells, page_texts, prefetch_reasons, provider_failures,
    )
}

_W = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_ORDERS = "seg AS (SELECT o_custkey % 9 AS project, o_orderkey AS index, CASE WHEN o_orderstatus = 'F' THEN 'degraded' ELSE 'ok' END AS status, o_orderkey % 5000 * 1.5::DOUBLE AS s, o_orderkey % 5000 * 1.5::DOUBLE + 8 AS e FROM orders)"
_STAMP = lambda x: f"printf('%02dm%02ds', CAST(trunc({x}) AS BIGINT) // 60, CAST(trunc({x}) AS BIGINT) % 60)"
_ENTITIES = "replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"

ORACLE_SQL = {
    "transcript_words": f"""WITH t AS (SELECT conv_id AS project, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS segment, {_W} AS ws FROM conversations)
SELECT project, segment, CAST(place AS INTEGER) AS place, word, place * 1.0::DOUBLE AS start, place + 0.5::DOUBLE AS "end" FROM (SELECT project, segment, unnest(range(len(ws))) AS place, unnest(ws) AS word FROM t)""",
    "build_prompts": f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN nullif(array_to_string({_W}[1:90], ' '), '') END AS a, CASE WHEN doc_id % 2 = 0 THEN nullif(array_to_string({_W}[1:4], ', '), '') END AS b, CASE WHEN doc_id % 5 = 0 THEN lang END AS c FROM documents)
SELECT doc_id, left(concat_ws('. ', a, b, c, CASE WHEN coalesce(a, b, c) IS NULL THEN 'spoken words' END, 'Tale'), 600) AS prompt FROM p""",
    "subject_tags": """WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN p_type || ' ' || p_brand || ' ' || p_name || ' ' || p_type ELSE p_brand END AS t FROM part)
SELECT p_partkey, array_to_string(string_split(t, ' ')[1:3], ' ') || ' x' AS tag FROM c""",
    "thin_groups": "SELECT source AS project, count(DISTINCT text) AS kept FROM documents GROUP BY source HAVING count(DISTINCT text) < 49",
    "context_fill": """WITH n AS (SELECT n_nationkey AS project, n_name, n_nationkey % 2 = 0 AS even, n_nationkey % 3 <> 0 AS told FROM nation),
l AS (SELECT *, list_concat(CASE WHEN even THEN [n_name, 'Known'] ELSE [] END, CASE WHEN NOT told THEN [] WHEN even THEN ['New'] ELSE [lower(n_name), 'New', 'KNOWN'] END) AS terminology FROM n)
SELECT project, CASE WHEN even THEN n_name WHEN told THEN 'Told' END AS franchise, CASE WHEN told THEN 'Subject' END AS subject, CASE WHEN told THEN 'tag' END AS search_tag, array_to_string(terminology, '|') AS terminology, array_to_string(CASE WHEN project % 4 = 0 THEN list_concat(terminology, ['Resolved']) ELSE terminology END, '|') AS characters FROM l""",
    "answers_applied": """SELECT p_brand AS project, p_partkey AS index, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS topic, CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE '' END AS event, 'here' AS location,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN 'COMIC' ELSE 'B_ROLL' END AS visual_intent, round(CASE WHEN p_partkey % 3 <> 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, p_size / 100.0::DOUBLE * 30)) ELSE 0.2::DOUBLE END, 6) AS confidence,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 = 0 THEN p_type ELSE 'Old' END AS entities, CAST(CASE WHEN p_partkey % 3 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS shots, CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS first_start FROM part""",
    "model_resolutions": """WITH o AS (SELECT DISTINCT p_type AS project, p_name AS original FROM part WHERE p_partkey % 2 = 0), a AS (SELECT p_type AS project, p_name AS original, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT project, original, 'Real' AS resolved, round(least(1.0::DOUBLE, k % 150 / 100.0::DOUBLE), 3) AS confidence, 'llm' AS method, k % 150 / 100.0::DOUBLE >= 0.75::DOUBLE AS applied, 'model' AS reason FROM a JOIN o USING (project, original) WHERE k % 7 <> 0 AND k % 5 <> 0""",
    "complete_segments": """WITH m AS (SELECT l_orderkey AS index, count(*) FILTER (WHERE l_orderkey % 7 <> 0) AS ranked FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1), c AS (SELECT DISTINCT l_orderkey AS index FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey AS index, m.index IS NOT NULL AND (c.index IS NOT NULL OR m.ranked = 0) AS complete FROM orders LEFT JOIN m ON m.index = o_orderkey LEFT JOIN c ON c.index = o_orderkey""",
    "segment_replaced": """WITH v AS (SELECT CAST(label AS INTEGER) AS index, CASE WHEN vec_id % 6 = 0 THEN 'clip' ELSE 'image' END AS kind, CAST(vec_id AS VARCHAR) AS path FROM embeddings)
SELECT index, kind, count(*) AS n, min(CASE WHEN index = 3 AND kind = 'image' THEN 'new' || path ELSE path END) AS least FROM v GROUP BY index, kind""",
    "robots": """SELECT page_id AS id, CASE WHEN path LIKE '/en/1%' THEN true WHEN path LIKE '/en/%' THEN false ELSE true END AS allowed FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
    "disk_grants": """WITH o AS (SELECT o_orderkey % 20 AS drive, o_orderkey AS arrival, CAST(round(o_totalprice) AS BIGINT) AS bytes FROM orders),
h AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY drive ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS held FROM o) SELECT arrival, held, held + bytes <= 20000000 AS granted FROM h""",
    "next_stages": f"WITH s(i, stage) AS (VALUES {', '.join(f'({i}, {s!r})' for i, s in enumerate(control.STAGES))}) SELECT stage, lead(stage) OVER (ORDER BY i) AS next FROM s",
    "clip_reasons": """WITH l AS (SELECT l_orderkey AS index, l_linenumber AS rank, CASE WHEN l_discount > 0.08::DOUBLE THEN 'ok' WHEN l_tax > 0.04::DOUBLE THEN 'low_confidence' ELSE 'section_failed' END AS outcome FROM lineitem),
ok AS (SELECT index, row_number() OVER (PARTITION BY index ORDER BY rank) AS r FROM l WHERE outcome = 'ok')
SELECT 'taken ' || r AS what, count(*) AS n FROM ok GROUP BY 1 UNION ALL SELECT 'no clip: ' || reason, count(*) FROM (SELECT index, arg_min(outcome, {'r': rank, 'o': outcome}) AS reason FROM l WHERE index NOT IN (SELECT index FROM ok) GROUP BY index) GROUP BY 1""",
    "project_report": f"""WITH {_ORDERS}, p AS (SELECT project, index, l_linenumber = 1 AS clip, l_tax * 12 AS c FROM lineitem JOIN seg ON index = l_orderkey WHERE l_discount > 0.07::DOUBLE),
d AS (SELECT project, count(*) AS files, count(*) FILTER (WHERE clip) AS clips, count(*) FILTER (WHERE c >= 0.85::DOUBLE) AS high, count(*) FILTER (WHERE c >= 0.6::DOUBLE AND c < 0.85::DOUBLE) AS flagged, count(DISTINCT index) AS covered FROM p GROUP BY project),
o AS (SELECT project, count(*) AS segments, count(*) FILTER (WHERE status <> 'ok') AS degraded, CAST(1 + ceil(count(*) / 20) AS BIGINT) AS calls FROM seg GROUP BY project)
SELECT project, segments, degraded, coalesce(files, 0) AS files, coalesce(clips, 0) AS clips, coalesce(high, 0) AS high, coalesce(flagged, 0) AS flagged, segments - coalesce(covered, 0) AS gaps, calls FROM o LEFT JOIN d USING (project)""",
    "segment_names": f"WITH {_ORDERS} SELECT project, index, lpad(CAST(index AS VARCHAR), CAST(greatest(3, length(CAST(max(index) OVER (PARTITION BY project) AS VARCHAR))) AS INTEGER), '0') || '_' || {_STAMP('s')} || '-' || {_STAMP('e')} AS name FROM seg",
    "cells": """WITH c AS (SELECT doc_id, n_chars / 2.0::DOUBLE AS s, replace(regexp_replace(coalesce(text, ''), '[\\s\\x0B]+', ' ', 'g'), '|', '\\|') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 79)) || '…' ELSE t END) AS digest, CASE WHEN s < 60 THEN printf('%.1f s', s) WHEN s < 3600 THEN printf('%d m %02d s', CAST(trunc(s) AS BIGINT) // 60, CAST(trunc(s) AS BIGINT) % 60) ELSE printf('%d h %02d m', CAST(trunc(s) AS BIGINT) // 3600, CAST(trunc(s) AS BIGINT) % 3600 // 60) END AS duration FROM c""",
    "page_texts": f"SELECT page_id, md5(trim(regexp_replace({_ENTITIES}, '[\\s\\x0B]+', ' ', 'g'))) AS digest FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS t FROM pages)",
    "prefetch_reasons": """WITH p AS (SELECT page_id AS k, lower(split_part(url || CASE WHEN page_id % 9 = 0 THEN '.SVG' ELSE '' END, '?', 1)) AS u FROM pages)
SELECT CASE WHEN k % 17 = 0 THEN 'duplicate_url' WHEN suffix(u, '.svg') THEN 'svg' WHEN k % 4 <> 0 AND k % 7 = 0 THEN 'robots' WHEN k % 11 = 0 THEN 'transport' WHEN k % 5 = 0 THEN 'bad_content_type' WHEN k % 13 = 0 THEN 'path_escape' END AS reason, count(*) AS n FROM p GROUP BY 1""",
    "provider_failures": """WITH f AS (SELECT DISTINCT l_orderkey AS index, 'provider' || (l_linenumber % 3) || ' failed: timeout' AS note FROM lineitem WHERE l_tax > 0.06::DOUBLE), g AS (SELECT index, string_agg(note, '|' ORDER BY note) AS notes FROM f GROUP BY index)
SELECT o_orderkey AS index, CASE WHEN g.index IS NULL THEN 'ok' ELSE 'degraded' END AS status, 'note' || coalesce('|' || g.notes, '') AS notes FROM orders LEFT JOIN g ON g.index = o_orderkey""",
}

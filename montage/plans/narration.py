"""Queries over narrations (conversations as projects, turns as parts; documents where one text is enough), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segment, words
from .tables import load

ORDER = ["part", "pos"]


def _conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project"), F.col("turn").alias("part"), "text")
    return words.synthesize_words(turns)


def words_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("project"), F.lit(0).alias("part"), "text")
    return words.synthesize_words(docs).select("project", "pos", "word", "start_ms", "end_ms")


def _jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = (F.col("pos") * 7919 % 11 - 5) * 40
    return _conversation_words(spark, sf_dir).withColumn("start_ms", F.col("start_ms") + shift).withColumn("end_ms", F.col("end_ms") - shift)


def words_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.enforce_monotonic(_jittered(spark, sf_dir), ORDER).select("project", "part", "pos", "start_ms", "end_ms")


def boundary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = words.boundaries(_conversation_words(spark, sf_dir), ORDER).where("n > 0")
    return cuts.groupBy("project", "kind").agg(F.count("*").alias("cuts"), F.round(F.sum("penalty"), 6).alias("penalty"), F.sum("cut_ms").alias("cut_ms"))


def segments_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.optimal_segments(_conversation_words(spark, sf_dir), ORDER)


def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.segment_summary(segments_optimal(spark, sf_dir))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.timeline(segments_optimal(spark, sf_dir))


def srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = segments_optimal(spark, sf_dir).select("project", F.col("index").alias("pos"), "start", "end", F.when(F.col("index") % 5 == 0, " ").otherwise(F.col("narration")).alias("text"))
    return words.srt(cues)


def segments_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = _conversation_words(spark, sf_dir).groupBy("project", "part").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project"), F.col("turn").alias("part"), "text")
    parts = spoken.join(turns, ["project", "part"]).select("project", F.col("part").alias("pos"), (F.col("a") / 1000).alias("start"), (F.col("b") / 1000).alias("end"), "text")
    return segment.fallback_segments(parts)


def analysis_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.with_batches(segments_optimal(spark, sf_dir)).groupBy("project", "batch").agg(F.min("index").alias("first"), F.max("index").alias("last"))


QUERIES = {f.__name__: f for f in (words_flatten, words_monotonic, boundary_kinds, segments_optimal, segment_summary, timeline, srt, segments_fallback, analysis_batches)}

_SENTENCE, _CLAUSE = """[.!?…]["'')\\]]*$""", """[,;:–—]["'')\\]]*$"""


def words_sql(table: str, project: str, part: str) -> str:
    return f"""
tok AS (SELECT {project} AS project, {part} AS part, unnest(range(len(ws))) AS pos, unnest(ws) AS word
  FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM {table})),
long AS (SELECT *, 120 + 36 * least(length(word), 12) AS dur, CASE WHEN regexp_matches(word, '{_SENTENCE}') THEN 300 WHEN regexp_matches(word, '{_CLAUSE}') THEN 120 ELSE 0 END
  + CASE WHEN pos % 17 = 16 THEN 260 ELSE 0 END AS gap FROM tok),
begun AS (SELECT *, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY project ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM long),
timed AS (SELECT project, part, CAST(pos AS INTEGER) AS pos, word, start_ms, CAST(start_ms + dur AS BIGINT) AS end_ms FROM begun)"""


_TALK = words_sql("conversations", "conv_id", "turn")
_CUTS = f"""{_TALK},
prior AS (SELECT *, row_number() OVER w - 1 AS n, lag(word) OVER w AS prev, lag(end_ms) OVER w AS prev_end FROM timed WINDOW w AS (PARTITION BY project ORDER BY part, pos)),
gaps AS (SELECT *, (start_ms - prev_end) / 1000.0::DOUBLE AS gap FROM prior),
kinds AS (SELECT *, CASE WHEN prev IS NULL OR regexp_matches(prev, '{_SENTENCE}') THEN 'sentence' WHEN regexp_matches(prev, '{_CLAUSE}') THEN 'clause' WHEN gap >= 0.25::DOUBLE THEN 'silence' ELSE 'word' END AS kind FROM gaps),
cuts AS (SELECT *, CASE kind WHEN 'sentence' THEN 0.0::DOUBLE WHEN 'clause' THEN 0.35::DOUBLE WHEN 'silence' THEN 0.7::DOUBLE ELSE 1.2::DOUBLE - least(0.25::DOUBLE, greatest(0.0::DOUBLE, gap)) END AS penalty,
  CASE WHEN prev IS NULL THEN start_ms::DOUBLE WHEN start_ms < prev_end THEN prev_end::DOUBLE ELSE (prev_end + start_ms) / 2.0::DOUBLE END AS cut_ms FROM kinds)"""

# The dynamic programme as a recursion over words: a step carries the costs and times of the last 70 cuts, more than ten seconds of words.
_SEGMENTS = f"""{_CUTS},
places AS MATERIALIZED (SELECT project, n, cut_ms / 1000.0::DOUBLE AS t, penalty, kind FROM cuts UNION ALL
  SELECT project, max(n) + 1, max(end_ms) / 1000.0::DOUBLE, 0.0::DOUBLE, 'sentence' FROM cuts GROUP BY project),
sizes AS MATERIALIZED (SELECT project, max(n) AS n_words, max(t) - min(t) AS total FROM places GROUP BY project),
dp AS (
  SELECT project, CAST(0 AS BIGINT) AS n, [{{'j': CAST(0 AS BIGINT), 't': t, 'c': 0.0::DOUBLE}}] AS recent, CAST(NULL AS STRUCT(cost DOUBLE, minus_j BIGINT)) AS best, CAST(NULL AS STRUCT(cost DOUBLE, minus_j BIGINT)) AS loose FROM places WHERE n = 0
  UNION ALL
  SELECT project, n, list_append(recent[-69:], {{'j': n, 't': t, 'c': coalesce(best.cost, 'inf'::DOUBLE)}}), best, loose FROM (
    SELECT p.project, p.n, p.t, d.recent,
      list_sort(list_transform(list_filter(d.recent, lambda r: r.c < 'inf'::DOUBLE AND p.t - r.t <= 10.0::DOUBLE AND p.t - r.t >= 6.0::DOUBLE),
        lambda r: {{'cost': r.c + (p.penalty + 0.35::DOUBLE * (((p.t - r.t - 8.0::DOUBLE) / 8.0::DOUBLE) * ((p.t - r.t - 8.0::DOUBLE) / 8.0::DOUBLE))), 'minus_j': -r.j}}))[1] AS best,
      list_sort(list_transform(list_filter(d.recent, lambda r: r.c < 'inf'::DOUBLE AND p.t - r.t <= 10.0::DOUBLE AND p.t - r.t >= 1.0::DOUBLE),
        lambda r: {{'cost': r.c + (p.penalty + 0.35::DOUBLE * (((p.t - r.t - 8.0::DOUBLE) / 8.0::DOUBLE) * ((p.t - r.t - 8.0::DOUBLE) / 8.0::DOUBLE))), 'minus_j': -r.j}}))[1] AS loose
    FROM dp d JOIN places p ON p.project = d.project AND p.n = d.n + 1)),
backs AS MATERIALIZED (SELECT d.project, d.n, CASE WHEN d.n < s.n_words THEN -d.best.minus_j WHEN s.total <= 10.0::DOUBLE THEN 0 WHEN d.best IS NOT NULL THEN -d.best.minus_j WHEN d.loose IS NOT NULL THEN -d.loose.minus_j ELSE 0 END AS j
  FROM dp d JOIN sizes s USING (project) WHERE d.n > 0),
chain AS (SELECT s.project, s.n_words AS stop, b.j AS start FROM sizes s JOIN backs b ON b.project = s.project AND b.n = s.n_words
  UNION ALL SELECT c.project, c.start, b.j FROM chain c JOIN backs b ON b.project = c.project AND b.n = c.start WHERE c.start > 0),
segments AS (SELECT c.project, CAST(row_number() OVER (PARTITION BY c.project ORDER BY c.start) AS INTEGER) AS index, a.t AS start, b.t AS end, b.t - a.t AS duration,
  (SELECT string_agg(word, ' ' ORDER BY n) FROM cuts w WHERE w.project = c.project AND w.n >= c.start AND w.n < c.stop) AS narration, CAST(c.stop - c.start AS INTEGER) AS words, b.kind
  FROM chain c JOIN places a ON a.project = c.project AND a.n = c.start JOIN places b ON b.project = c.project AND b.n = c.stop)"""

_CODE = lambda x: f"CASE WHEN trunc({x}) >= 3600 THEN printf('%d:%02d:%02d', CAST(trunc({x}) AS BIGINT) // 3600, CAST(trunc({x}) AS BIGINT) % 3600 // 60, CAST(trunc({x}) AS BIGINT) % 60) ELSE printf('%d:%02d', CAST(trunc({x}) AS BIGINT) // 60, CAST(trunc({x}) AS BIGINT) % 60) END"
_STAMP = lambda x: f"printf('%02d:%02d:%02d,%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"

ORACLE_SQL = {
    "words_flatten": f"WITH {words_sql('documents', 'doc_id', '0')} SELECT project, pos, word, start_ms, end_ms FROM timed",
    "words_monotonic": f"""WITH {_TALK},
jittered AS (SELECT project, part, pos, start_ms + (pos * 7919 % 11 - 5) * 40 AS s, end_ms - (pos * 7919 % 11 - 5) * 40 AS e FROM timed),
started AS (SELECT *, greatest(s, 0, max(greatest(s, e)) OVER (PARTITION BY project ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS start_ms FROM jittered)
SELECT project, part, pos, start_ms, greatest(e, start_ms) AS end_ms FROM started""",
    "boundary_kinds": f"WITH {_CUTS} SELECT project, kind, count(*) AS cuts, round(sum(penalty), 6) AS penalty, sum(cut_ms) AS cut_ms FROM cuts WHERE n > 0 GROUP BY project, kind",
    "segments_optimal": f"WITH RECURSIVE {_SEGMENTS} SELECT * FROM segments",
    "segment_summary": f"""WITH RECURSIVE {_SEGMENTS} SELECT project, count(*) AS n, min(duration) AS shortest, max(duration) AS longest, round(avg(duration), 6) AS mean,
  count(*) FILTER (WHERE duration < 6 OR duration > 10) AS outside FROM segments GROUP BY project""",
    "timeline": f"""WITH RECURSIVE {_SEGMENTS} SELECT project, lpad(CAST(index AS VARCHAR), CAST(greatest(3, length(CAST(max(index) OVER (PARTITION BY project) AS VARCHAR))) AS INTEGER), '0') AS segment,
  {_CODE('start')} AS "from", {_CODE('"end"')} AS "to", printf('%.3f', duration) AS seconds, words, narration FROM segments""",
    "srt": f"""WITH RECURSIVE {_SEGMENTS}, kept AS (SELECT *, CAST(round_even(start * 1000, 0) AS BIGINT) AS a, CAST(round_even("end" * 1000, 0) AS BIGINT) AS b FROM segments WHERE index % 5 <> 0)
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY index) AS INTEGER) AS number, {_STAMP('a')} || ' --> ' || {_STAMP('b')} AS stamps, narration AS text FROM kept""",
    "analysis_batches": f"""WITH RECURSIVE {_SEGMENTS}, numbered AS (SELECT project, index, CAST((row_number() OVER (PARTITION BY project ORDER BY index) - 1) // 20 AS INTEGER) AS batch FROM segments)
SELECT project, batch, min(index) AS first, max(index) AS last FROM numbered GROUP BY project, batch""",
    "segments_fallback": f"""WITH RECURSIVE {_TALK},
spans AS (SELECT project, part, min(start_ms) / 1000 AS s, max(end_ms) / 1000 AS e FROM timed GROUP BY ALL),
parts AS MATERIALIZED (SELECT s.*, trim(c.text) AS text, row_number() OVER (PARTITION BY project ORDER BY part) AS k FROM spans s JOIN conversations c ON c.conv_id = project AND c.turn = part),
walk AS (SELECT project, k, s, e, text, 1 AS index, s AS bucket FROM parts WHERE k = 1
  UNION ALL SELECT p.project, p.k, p.s, p.e, p.text, CASE WHEN p.e - w.bucket > 10.0::DOUBLE THEN w.index + 1 ELSE w.index END, CASE WHEN p.e - w.bucket > 10.0::DOUBLE THEN p.s ELSE w.bucket END
  FROM walk w JOIN parts p ON p.project = w.project AND p.k = w.k + 1),
grouped AS (SELECT project, CAST(index AS INTEGER) AS index, min(s) AS first, max(e) AS stop, arg_max(e, k) - arg_min(s, k) AS duration, string_agg(text, ' ' ORDER BY k) AS narration FROM walk GROUP BY project, index)
SELECT project, index, coalesce(lag(stop) OVER (PARTITION BY project ORDER BY index), first) AS start, stop AS end, duration, narration FROM grouped""",
}

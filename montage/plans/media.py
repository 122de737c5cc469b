"""Queries over candidates, pictures, videos and clips: vectors, pages, documents, parts and orders in their place; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedupe, gather, locate, pictures, rank
from .tables import load

QUERY_TERMS = ["thner", "ander", "ation", "einver"]


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as hits: the label is the search string, three providers take turns."""
    v = load(spark, sf_dir, "embeddings")
    return v.select(
        F.lit("p").alias("project"), (F.col("vec_id") % 5).cast("int").alias("index"), F.col("label").cast("int").alias("query_index"), (F.col("vec_id") % 3).cast("int").alias("provider_ord"),
        F.col("vec_id").cast("int").alias("hit"), F.concat(F.lit("https://Img.example.org/"), (F.floor(F.col("vec_id") / 7)).cast("string"), F.lit("?v="), F.col("vec_id").cast("string")).alias("url"), "vec_id",
    )


def candidates_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gather.interleave(gather.first_of_url(_candidates(spark, sf_dir))).select("index", "place", "vec_id")


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project"), F.floor(F.col("turn") / 4).cast("int").alias("index"), (F.col("turn") % 4).cast("int").alias("query_index"))
    providers = spark.createDataFrame([("ddgs", 0), ("wikimedia", 1)], "provider string, provider_ord int")
    return gather.fan_out(turns, providers)


def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select(F.lit("p").alias("project"), F.lit(0).alias("index"), F.lit(0).alias("query_index"), F.lit(0).alias("provider_ord"), F.col("page_id").alias("hit"), "url")
    return gather.first_of_url(pages).select(F.col("hit").alias("page_id"), "key")


def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").groupBy(T.domain(F.lit(""), F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as downloads, some with the head of a picture or a drawing put before them."""
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("body"))
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    k = F.col("id") % 6
    png = F.to_binary(F.lit("89504e470d0a1a0a"), F.lit("hex"))
    raw = F.col("body").cast("binary")
    content = F.when(k == 0, F.lit("").cast("binary")).when(k == 1, F.concat(F.lit(" <SVG xmlns=''>").cast("binary"), raw)).when(k == 2, F.concat(F.lit("<?xml?><svg>").cast("binary"), raw)).when(k.isin(3, 4), F.concat(png, raw)).otherwise(raw)
    width = F.when(k == 3, (F.col("id") % 1600).cast("int")).when(k == 4, 1600)
    made = pages.union(docs).select("id", content.alias("content"), width.alias("width"))
    return gather.reasons(made.select(gather.rejection(F.col("content"), F.col("width")).alias("reason")))


def take_n_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") % 3 != 0).alias("ok"))
    return gather.take_accepted(docs, ["source"], ["doc_id"], 8)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pictures: bytes and sizes from the text, SimHash in place of perceptual hashes."""
    docs = load(spark, sf_dir, "documents")
    docs = docs.join(dedupe.simhashes(docs, "doc_id", "text"), "doc_id")
    return docs.select(
        F.col("source").alias("project"), F.lit(0).alias("index"), F.lpad(F.col("doc_id").cast("string"), 9, F.lit("0")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("simhash").alias("phash"), F.substring(F.md5("text"), 1, 16).alias("dhash"),
        F.col("n_chars").alias("pixels"), F.octet_length("text").alias("bytes"), (F.col("doc_id") % 2).cast("int").alias("licensed"), F.col("n_chars").cast("int").alias("width"), (F.col("doc_id") % 1500 + 500).cast("int").alias("height"), "doc_id",
    )


def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.exact_duplicates(_records(spark, sf_dir), []).select("path", "keeper", "duplicate")


def simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.simhashes(load(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("simhash", "phash")


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.near_pairs(simhashes(spark, sf_dir), "doc_id", "phash")


def dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.mark_duplicates(dedupe.greedy_dedupe(_records(spark, sf_dir), ["project"])).select("path", "keeper", "reason", "status")


def picture_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as grey pictures of 64 pixels a row, the last row filled with zeros."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    height = F.ceil(F.octet_length("text") / 64).cast("int")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.rpad(raw, height * 64, F.unhex(F.lit("00"))).alias("grey"), height.alias("height"))
    return pictures.picture_measures(docs, F.col("grey"), F.lit(64), F.col("height")).select("doc_id", "phash", "dhash", F.round("sharpness", 6).alias("sharpness"), F.round("watermark", 6).alias("watermark"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label the five vectors nearest to the label's first vector."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    first = v.groupBy(F.col("label").alias("l")).agg(F.min_by("embedding", "id").alias("query"))
    return rank.cosine_topk(v.join(first, F.col("label") == F.col("l")), ["label"], F.col("query"), 5).select("label", "id", "similarity", "rank")


def _scored(spark: SparkSession, sf_dir: str, meaningful: bool) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    hosts = F.array(*[F.lit(h) for h in ("upload.wikimedia.org", "www.starwars.com", "x.fandom.com", "flickr.com", "i.imgur.com", "example.org")])
    kinds = F.array(*[F.lit(k) for k in ("exact_event", "quest", "narration", "location", "fallback")])
    entities = F.array(*[F.lit(x) for x in QUERY_TERMS], F.lit("x"))
    part = lambda n: (F.col("doc_id") * n % 101 / 100.0)
    rows = docs.select(
        "doc_id", part(7).alias("clip"), rank.entity_bonus(entities, F.col("text")).alias("entity"), rank.event_bonus(F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int"))).alias("exact_event"), rank.source_tier(F.element_at(hosts, (F.col("doc_id") % 6 + 1).cast("int"))).alias("source"),
        rank.resolution_score(F.col("n_chars"), F.lit(900)).alias("resolution"), part(11).alias("sharpness"), part(13).alias("repetition"), part(17).alias("watermark"),
    )
    return rank.score_records(rows, meaningful)


def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, True).select("doc_id", "score", F.element_at("breakdown", "entity").alias("entity"))


def score_no_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, False).select("doc_id", "score")


def shape_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    return parts.groupBy(rank.shape_bucket(F.col("p_retailprice"), F.col("p_size") * 40).alias("shape")).agg(F.count("*").alias("n"))


def _ranked_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pictures of segments of thirty; bits of sign hashes of the vectors stand for looks."""
    v = load(spark, sf_dir, "embeddings")
    bits = lambda n: F.lower(F.lpad(F.conv(F.array_join(F.transform(F.slice("embedding", 1, 64), lambda x, i: F.when(x * (n * 2 - 1) > F.when(i % 3 == 0, 0.1).otherwise(0.0), "1").otherwise("0")), ""), 2, 16), 16, F.lit("0")))
    return v.select(
        (F.col("vec_id") % 4).alias("project"), F.floor(F.col("vec_id") / 120).cast("int").alias("index"), F.col("vec_id").cast("string").alias("path"), F.sha2(F.col("vec_id").cast("string"), 256).alias("sha256"), (F.col("vec_id") * 37 % 1000 / 1000.0).alias("score"),
        bits(1).alias("phash"), bits(0).alias("dhash"), (F.col("vec_id") % 7 * 200 + 400).cast("int").alias("width"), F.lit(800).alias("height"),
    )


def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.mmr_select(_ranked_input(spark, sf_dir), ["project", "index"]).select("project", "index", "path", "score", "rank")


def rank_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.picks(rank.rank_with_history(_ranked_input(spark, sf_dir).withColumnRenamed("score", "base")))


def _terms() -> Column:
    return F.array(*[F.lit(t) for t in QUERY_TERMS])


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as videos: the first words are the title, a description with times, sentences as captions and lines as chapters."""
    marks = F.array(*[F.lit(m) for m in ("", " full scene", " explained", " gameplay part 2", " trailer")])
    docs = load(spark, sf_dir, "documents")
    title = F.concat(F.array_join(F.slice(T.words(F.col("text")), 1, 8), " "), F.element_at(marks, (F.col("doc_id") % 5 + 1).cast("int")))
    sentence = F.split("text", r"\.")
    captions = F.transform(sentence, lambda s, i: F.struct((i * 4.0).alias("start"), (i * 4.0 + 3.0).alias("end"), s.alias("text")))
    chapters = F.transform(F.split("text", "\n"), lambda s, i: F.struct((i * 30.0).alias("start_time"), (i * 30.0 + 30.0).alias("end_time"), F.substring(s, 1, 60).alias("title")))
    return docs.select(
        "doc_id", F.lit("p").alias("project"), F.lit(0).alias("index"), title.alias("title"), F.col("text").alias("body"), (F.col("n_chars") % 900).cast("double").alias("duration"), F.lit(8.0).alias("span"), _terms().alias("terms"),
        F.when(F.col("doc_id") % 3 != 0, captions).otherwise(F.slice(captions, 1, 0)).alias("captions"), F.when(F.col("doc_id") % 4 == 1, chapters).otherwise(F.slice(chapters, 1, 0)).alias("chapters"), _description().alias("description"),
    )


def _description() -> Column:
    w = T.words(F.col("text"))
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    return F.concat(F.lit("Intro notes\n0:00 "), part(1, 3), F.lit("\n1:42 - "), part(4, 3), F.lit("\n(1:02:03) "), part(7, 3), F.lit("\nend at 5:00 maybe\n2:03\nafter it\n1:234 x"))


def relevance_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).withColumn("relevance", locate.relevance(F.col("terms"), F.col("title"), F.col("body")))
    hits = hits.withColumn("class", locate.classify(F.col("relevance"), F.col("title"), F.col("duration")))
    found = hits.select("project", "index", F.col("doc_id").alias("arrival"), (F.col("doc_id") % 500).alias("video_id"), "class", F.round("relevance", 6).alias("relevance"), F.lit(0.5).alias("confidence"))
    return locate.search_videos(found).select("video_id", "arrival", "class", "relevance", "rank")


def description_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(locate.description_stamps(_description())).alias("n", "s"))
    return docs.select("doc_id", "n", "s.start", "s.label")


def locate_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = locate.locate(_hits(spark, sf_dir)).select("doc_id", F.size("moments").alias("ways"), locate.best_moment(F.col("moments")).alias("m"))
    return best.select("doc_id", "ways", "m.start", "m.end", "m.method", "m.confidence")


def method_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.method_histogram(locate.locate(_hits(spark, sf_dir)))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as clips wanted: quantities and prices as seconds."""
    kinds = F.array(*[F.lit(c) for c in locate.CLASSES])
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(kinds, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("class"), (F.col("l_partkey") % 700).cast("double").alias("duration"), (F.col("l_quantity") / 5).alias("span"), (F.col("l_suppkey") % 600).cast("double").alias("at"), F.col("l_discount").alias("d"))
    best = F.when(F.col("d") > 0.01, F.struct(F.col("at").alias("start"), (F.col("at") + 4).alias("end"), (F.col("d") * 10).alias("confidence")))
    return rows.withColumn("best", best)


def clip_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    out = rows.select("l_orderkey", "l_linenumber", "class", locate.span_for(F.col("class"), F.col("best"), F.col("duration"), F.col("span")).alias("s"), locate.clip_confidence(F.col("class"), F.col("best")).alias("confidence"))
    return out.select("l_orderkey", "l_linenumber", "class", "s.start", "s.end", "confidence")


def clip_take_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order has several lines of one number: the first in the file comes first, as in the SQL where its rows come in order."""
    rows = _spans(spark, sf_dir).select(F.col("l_orderkey").alias("index"), F.lit("p").alias("project"), F.col("l_linenumber").alias("rank"), "class", F.when(F.col("best")["start"].isNull(), "low_confidence").otherwise("ok").alias("outcome"), F.lit(1).alias("bytes"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return locate.take_clips(rows, arrival=("file", "row")).select("index", "rank", "class", "outcome")


QUERIES = {
    f.__name__: f
    for f in (
        candidates_interleave, fan_out, url_dedupe, url_domain, reject_reasons, take_n_success, dedupe_exact, simhashes, near_pairs, dedupe_greedy, picture_measures, cosine_topk, score_weighted, score_no_clip, shape_buckets, mmr_select,
        rank_with_history, relevance_classify, description_stamps, locate_best, method_hist, clip_spans, clip_take_n,
    )
}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LIST = "['thner', 'ander', 'ation', 'einver']"
_TOK = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9'']+'), lambda w: length(w) > 2))"
_SIMHASH = f"""tok AS (SELECT doc_id, {_TOK('text')} AS ts FROM documents),
hashed AS (SELECT doc_id, len(ts) AS n, list_transform(ts, lambda t: ('0x' || substr(md5(t), 1, 16))::UBIGINT) AS h FROM tok),
simhash AS (SELECT doc_id, printf('%016x', list_sum(list_transform(range(64), lambda b: CASE WHEN len(list_filter(h, lambda x: ((x >> b::UBIGINT) & 1::UBIGINT) = 1)) * 2 > n THEN (1::HUGEINT << b::INTEGER) ELSE 0::HUGEINT END))::UBIGINT) AS phash FROM hashed)"""
_TITLE = f"array_to_string({_WORDS}[1:8], ' ') || ['', ' full scene', ' explained', ' gameplay part 2', ' trailer'][doc_id % 5 + 1]"
_REL = lambda title, body: f"CASE WHEN len(list_filter({_LIST}, lambda t: contains(lower({title} || ' ' || {body}), t))) > 0 THEN len(list_filter({_LIST}, lambda t: contains(lower({title} || ' ' || {body}), t))) / 4 WHEN len(list_intersect({_LIST}, {_TOK(title)})) > 0 THEN 0.5::DOUBLE * len(list_intersect({_LIST}, {_TOK(title)})) / 4 ELSE 0.0::DOUBLE END"
_OVER = lambda x: f"CASE WHEN len(list_filter({_LIST}, lambda t: contains(lower({x}), t))) > 0 THEN len(list_filter({_LIST}, lambda t: contains(lower({x}), t))) / 4 WHEN len(list_intersect({_LIST}, {_TOK(x)})) >= 2 THEN len(list_intersect({_LIST}, {_TOK(x)})) / 4 * 0.6::DOUBLE ELSE 0.0::DOUBLE END"
_ANY = lambda x, marks: "(" + " OR ".join(f"contains({x}, '{m.replace(chr(39), chr(39) * 2)}')" for m in marks) + ")"
_PARTS = f"array_to_string({_WORDS}[1:3], ' ') AS a, array_to_string({_WORDS}[4:6], ' ') AS b, array_to_string({_WORDS}[7:9], ' ') AS c"

_SCORE = lambda w: f"""WITH parts AS (SELECT doc_id, doc_id * 7 % 101 / 100.0::DOUBLE AS clip, len(list_filter({_LIST}, lambda t: contains(lower(text), t))) / 4 AS entity, [1.0::DOUBLE, 0.6::DOUBLE, 0.0::DOUBLE, 0.35::DOUBLE, 0.0::DOUBLE][doc_id % 5 + 1] AS exact_event,
  [1.0::DOUBLE, 0.85::DOUBLE, 0.7::DOUBLE, 0.55::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE][doc_id % 6 + 1] AS source, least(1.0::DOUBLE, ln(1 + n_chars::DOUBLE * 900 / 1e6::DOUBLE) / ln(9::DOUBLE)) AS resolution,
  doc_id * 11 % 101 / 100.0::DOUBLE AS sharpness, doc_id * 13 % 101 / 100.0::DOUBLE AS repetition, doc_id * 17 % 101 / 100.0::DOUBLE AS watermark FROM documents)
SELECT doc_id, round(greatest(0.0::DOUBLE, {w[0]}::DOUBLE * clip + {w[1]}::DOUBLE * greatest(entity, 0.5::DOUBLE * exact_event) + {w[2]}::DOUBLE * source + {w[3]}::DOUBLE * resolution + {w[4]}::DOUBLE * sharpness + 0.1::DOUBLE * exact_event - 0.15::DOUBLE * repetition - 0.15::DOUBLE * watermark), 6) AS score"""  # noqa: E731



def _weights(meaningful: bool) -> list[float]:
    w = rank.active_weights(meaningful)
    return [w[k] for k in ("clip", "entity", "source", "resolution", "sharpness")]


_STAMPS = f"""found AS (SELECT doc_id, regexp_extract_all(description, '(?m){locate.STAMP}', 1) AS times, regexp_extract_all(description, '(?m){locate.STAMP}', 2) AS labels FROM described),
stamps AS (SELECT doc_id, k, list_reduce(list_transform(string_split(times[k + 1], ':'), lambda x: CAST(x AS BIGINT)), lambda x, y: x * 60 + y)::DOUBLE AS at_s, labels[k + 1] AS s FROM (SELECT *, unnest(range(len(times))) AS k FROM found))"""
_LOCATED = f"""hits AS (SELECT doc_id, {_TITLE} AS title, (n_chars % 900)::DOUBLE AS duration, text, {_PARTS} FROM documents),
described AS (SELECT *, 'Intro notes' || chr(10) || '0:00 ' || a || chr(10) || '1:42 - ' || b || chr(10) || '(1:02:03) ' || c || chr(10) || 'end at 5:00 maybe' || chr(10) || '2:03' || chr(10) || 'after it' || chr(10) || '1:234 x' AS description FROM hits),
{_STAMPS},
caption AS (SELECT doc_id, arg_max(k, score * 1000000000 - k) AS k, max(score) AS score FROM (SELECT doc_id, k, {_OVER('s')} AS score FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s, unnest(range(len(string_split(text, '.')))) AS k FROM documents WHERE doc_id % 3 <> 0)) WHERE score > 0 GROUP BY doc_id),
chapter AS (SELECT doc_id, arg_max(k, score * 1000000000 - k) AS k, max(score) AS score FROM (SELECT doc_id, k, {_OVER('s')} AS score FROM (SELECT doc_id, substr(unnest(string_split(text, chr(10))), 1, 60) AS s, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE doc_id % 4 = 1)) WHERE score > 0 GROUP BY doc_id),
line AS (SELECT doc_id, arg_max(at_s, score * 1000000000 - k) AS at_s, max(score) AS score FROM (SELECT doc_id, k, at_s, {_OVER('s')} AS score FROM (
  SELECT * FROM stamps)) WHERE score > 0 GROUP BY doc_id),
ways AS (
  SELECT c.doc_id, 0 AS way, 'captions' AS method, k * 4.0::DOUBLE AS s, k * 4.0::DOUBLE + 3.0::DOUBLE AS e, round(0.92::DOUBLE * score, 3) AS confidence, duration FROM caption c JOIN hits USING (doc_id)
  UNION ALL SELECT c.doc_id, 1, 'chapters', k * 30.0::DOUBLE, k * 30.0::DOUBLE + 30.0::DOUBLE, round(0.8::DOUBLE * score, 3), duration FROM chapter c JOIN hits USING (doc_id)
  UNION ALL SELECT l.doc_id, 2, 'description', at_s, at_s + 8.0::DOUBLE, round(0.7::DOUBLE * score, 3), duration FROM line l JOIN hits USING (doc_id)
  UNION ALL SELECT doc_id, 3, 'metadata', least(5.0::DOUBLE, duration * 0.05::DOUBLE), least(duration, least(5.0::DOUBLE, duration * 0.05::DOUBLE) + 8.0::DOUBLE), round(0.5::DOUBLE * ({_OVER('title')}), 3), duration FROM hits WHERE {_OVER('title')} > 0 AND duration > 0 AND duration <= 300
  UNION ALL SELECT doc_id, 4, 'similarity', 0.0::DOUBLE, 8.0::DOUBLE, round(0.35::DOUBLE * ({_OVER("(title || ' ' || description)")}), 3), duration FROM described WHERE {_OVER("(title || ' ' || description)")} > 0),
clamped AS (SELECT *, CASE WHEN duration > 0 THEN greatest(0.0::DOUBLE, least(s, duration - 0.1::DOUBLE)) ELSE s END AS start FROM ways),
ended AS (SELECT *, CASE WHEN duration > 0 THEN greatest(start, least(e, duration)) ELSE e END AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, way) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM clamped),
best AS (SELECT h.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS ways, start, stop AS "end", method, confidence FROM hits h LEFT JOIN ended e ON e.doc_id = h.doc_id AND r = 1)"""

_SPANS = """spans AS (SELECT l_orderkey, l_linenumber, ['EXACT_SCENE', 'LIKELY_EXACT_SCENE', 'RELATED_FOOTAGE', 'CONTEXTUAL'][l_linenumber % 4 + 1] AS class, (l_partkey % 700)::DOUBLE AS duration, l_quantity / 5 AS span,
  CASE WHEN l_discount > 0.01::DOUBLE THEN (l_suppkey % 600)::DOUBLE END AS at_s, CASE WHEN l_discount > 0.01::DOUBLE THEN l_discount * 10 END AS sure FROM lineitem)"""

ORACLE_SQL = {
    "candidates_interleave": """WITH c AS (SELECT vec_id % 5 AS index, label AS q, vec_id % 3 AS p, vec_id, vec_id // 7 AS url FROM embeddings),
once AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY index, url ORDER BY q, p, vec_id) = 1),
turns AS (SELECT *, row_number() OVER (PARTITION BY index, q ORDER BY p, vec_id) AS turn FROM once)
SELECT CAST(index AS INTEGER) AS index, CAST(row_number() OVER (PARTITION BY index ORDER BY turn, q) AS INTEGER) AS place, vec_id FROM turns""",
    "fan_out": """WITH q AS (SELECT conv_id AS project, CAST(turn // 4 AS INTEGER) AS index, CAST(turn % 4 AS INTEGER) AS query_index, count(*) OVER (PARTITION BY conv_id, turn // 4) AS n FROM conversations)
SELECT project, index, query_index, provider, provider_ord, CAST(greatest(4, ceil(48.0::DOUBLE / (n * 2))) AS INTEGER) AS per_call FROM q, (VALUES ('ddgs', 0), ('wikimedia', 1)) v(provider, provider_ord) WHERE provider = 'ddgs' OR query_index < 2""",
    "url_dedupe": "SELECT page_id, key FROM (SELECT page_id, lower(split_part(url, '?', 1)) AS key FROM pages) QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1",
    "url_domain": "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain, count(*) AS n FROM pages GROUP BY 1",
    "reject_reasons": """WITH bodies AS (SELECT page_id AS id, html AS body FROM pages UNION ALL SELECT doc_id, text FROM documents),
judged AS (SELECT CASE id % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'svg' WHEN 2 THEN 'svg' WHEN 3 THEN CASE WHEN id % 1600 < 800 THEN 'too_small' END WHEN 5 THEN CASE WHEN body = '' THEN 'empty' ELSE 'undecodable' END END AS reason FROM bodies)
SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason""",
    "take_n_success": """SELECT source, doc_id, ok FROM (SELECT source, doc_id, n_chars % 3 <> 0 AS ok, coalesce(sum(CASE WHEN n_chars % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS got FROM documents) WHERE got < 8""",
    "dedupe_exact": """WITH r AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, first_value(lpad(CAST(doc_id AS VARCHAR), 9, '0')) OVER (PARTITION BY text ORDER BY n_chars DESC, strlen(text) DESC, doc_id % 2 DESC, doc_id DESC) AS keeper FROM documents)
SELECT path, keeper, keeper <> path AS duplicate FROM r""",
    "simhashes": f"WITH {_SIMHASH} SELECT doc_id, phash FROM simhash",
    "near_pairs": f"""WITH {_SIMHASH},
nodes AS (SELECT phash AS h, ('0x' || phash)::UBIGINT AS v, min(doc_id) AS id FROM simhash GROUP BY phash)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.v, b.v)) AS INTEGER) AS distance FROM nodes a JOIN nodes b ON a.id < b.id AND bit_count(xor(a.v, b.v)) <= 6
UNION ALL SELECT n.id, s.doc_id, 0 FROM simhash s JOIN nodes n ON n.h = s.phash WHERE n.id <> s.doc_id""",
    "cosine_topk": """WITH q AS (SELECT label, arg_min(embedding, vec_id) AS query FROM embeddings GROUP BY label),
s AS (SELECT e.label, vec_id AS id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * query[i]::DOUBLE)), lambda x, y: x + y))), 6) AS similarity FROM embeddings e JOIN q USING (label))
SELECT label, id, similarity, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, id) AS r FROM s) WHERE r <= 5""",
    "score_weighted": _SCORE(_weights(True)) + ", round(greatest(entity, 0.5::DOUBLE * exact_event), 6) AS entity FROM parts",
    "score_no_clip": _SCORE(_weights(False)) + " FROM parts",
    "shape_buckets": """SELECT CASE WHEN r >= 1.9::DOUBLE THEN 'ultrawide' WHEN r >= 1.4::DOUBLE THEN 'widescreen' WHEN r >= 1.1::DOUBLE THEN 'landscape' WHEN r >= 0.9::DOUBLE THEN 'square' ELSE 'portrait' END AS shape, count(*) AS n
FROM (SELECT CASE WHEN p_size <> 0 THEN p_retailprice / (p_size * 40) ELSE 1.0::DOUBLE END AS r FROM part) GROUP BY 1""",
    "relevance_classify": f"""WITH hits AS (SELECT doc_id, {_TITLE} AS title, text AS body, (n_chars % 900)::DOUBLE AS duration FROM documents),
scored AS (SELECT *, lower(title) AS low, {_REL('title', 'body')} AS rel FROM hits),
classed AS (SELECT *, CASE WHEN rel <= 0 THEN 'CONTEXTUAL' WHEN {_ANY('low', locate.COMMENTARY)} THEN 'CONTEXTUAL' WHEN {_ANY('low', locate.EXACT)} AND rel >= 0.5 AND duration > 0 AND duration <= 600 THEN 'EXACT_SCENE' WHEN {_ANY('low', locate.EXACT)} AND rel >= 0.5 THEN 'LIKELY_EXACT_SCENE'
  WHEN {_ANY('low', locate.PLAYTHROUGH)} THEN 'RELATED_FOOTAGE' WHEN rel >= 0.5 THEN 'LIKELY_EXACT_SCENE' ELSE 'RELATED_FOOTAGE' END AS class FROM scored),
once AS (SELECT *, doc_id % 500 AS video_id, round(rel, 6) AS relevance FROM classed QUALIFY row_number() OVER (PARTITION BY doc_id % 500 ORDER BY doc_id) = 1)
SELECT video_id, doc_id AS arrival, class, relevance, CAST(row_number() OVER (ORDER BY list_position(['EXACT_SCENE', 'LIKELY_EXACT_SCENE', 'RELATED_FOOTAGE', 'CONTEXTUAL'], class), relevance DESC, video_id) AS INTEGER) AS rank FROM once""",
    "description_stamps": f"""WITH {_LOCATED} SELECT doc_id, CAST(k AS INTEGER) AS n, at_s AS start, s AS label FROM stamps""",
    "locate_best": f"WITH {_LOCATED} SELECT * FROM best",
    "method_hist": f"WITH {_LOCATED} SELECT coalesce(method, 'none') AS method, count(*) AS n FROM best GROUP BY 1",
    "clip_spans": f"""WITH {_SPANS},
one AS (SELECT *, greatest(0.0::DOUBLE, at_s - 3) AS s0, CASE WHEN at_s + 4 + 3 - greatest(0.0::DOUBLE, at_s - 3) < span THEN greatest(0.0::DOUBLE, at_s - 3) + span + 3 ELSE at_s + 7 END AS e0, greatest(span, 1.0::DOUBLE) + 6 AS want, least(duration * 0.1::DOUBLE, 30.0::DOUBLE) AS r0 FROM spans),
two AS (SELECT *, CASE WHEN duration > 0 THEN least(e0, duration) ELSE e0 END AS e1, CASE WHEN r0 + want > duration THEN greatest(0.0::DOUBLE, duration - want) ELSE r0 END AS r1 FROM one),
three AS (SELECT *, CASE WHEN duration > 0 THEN least(s0, greatest(0.0::DOUBLE, e1 - 0.5::DOUBLE)) ELSE s0 END AS s1, least(duration, r1 + want) AS r2 FROM two)
SELECT l_orderkey, l_linenumber, class,
  CASE WHEN sure >= 0.45::DOUBLE THEN CASE WHEN e1 > s1 THEN round(s1, 3) END WHEN class IN ('EXACT_SCENE', 'LIKELY_EXACT_SCENE') THEN NULL WHEN duration > 0 AND r2 - r1 >= 0.5::DOUBLE THEN round(r1, 3) END AS start,
  CASE WHEN sure >= 0.45::DOUBLE THEN CASE WHEN e1 > s1 THEN round(e1, 3) END WHEN class IN ('EXACT_SCENE', 'LIKELY_EXACT_SCENE') THEN NULL WHEN duration > 0 AND r2 - r1 >= 0.5::DOUBLE THEN round(r2, 3) END AS "end",
  round(CASE class WHEN 'EXACT_SCENE' THEN 0.9::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, coalesce(sure, 0.0::DOUBLE))) WHEN 'LIKELY_EXACT_SCENE' THEN 0.75::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, coalesce(sure, 0.0::DOUBLE))) WHEN 'RELATED_FOOTAGE' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END, 3) AS confidence FROM three""",
    "clip_take_n": f"""WITH {_SPANS} SELECT l_orderkey AS index, l_linenumber AS rank, class, CASE WHEN at_s IS NULL THEN 'low_confidence' ELSE 'ok' END AS outcome FROM spans WHERE class <> 'CONTEXTUAL' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 1""",
}

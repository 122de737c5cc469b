"""Queries over names and context: documents as narrations, part names as a lexicon, turns as segments; and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.phonetics import metaphone
from ..operators import analysis, lexicon, search
from ..params import DEFAULTS
from .tables import load

PACKS = [("en", 0, 2, ["the", "of", "with that", "there"], "tag-en"), ("de", 1, 2, ["der", "und", "nicht"], "tag-de"), ("es", 2, 2, ["que", "los", "una"], "tag-es"), ("fr", 3, 2, ["les", "des", "une", "elle"], "tag-fr")]
#: original, resolved, applied
FIXES = [("the", "DET", True), ("of the", "GEN", True), ("and", "ET", False), ("que", "QVE", False), ("der", "DIE", True)]
CHARACTERS, PLACES, TERMS = ["Thner", "Ander", "ciónes"], ["Thing", "Einver"], ["ation", "ement"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("project"), "text")


def _packs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PACKS, lexicon.PACKS)


def pack_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.select_packs(_documents(spark, sf_dir), _packs(spark))


def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.extract_candidates(_documents(spark, sf_dir))


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as canonical names, their words turned round as spellings."""
    names = load(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").cast("int").alias("entity_ord"))
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    return names.select(F.lit("parts").alias("pack"), F.lit(0).alias("pack_ord"), "entity_ord", F.lit(0).alias("spelling_ord"), turned.alias("spelling"), F.col("p_name").alias("canonical"), F.lit("object").alias("type"), (0.7 + F.col("entity_ord") % 4 * 0.1).alias("confidence"), F.lit("turned").alias("reason"), F.array(F.lit("part")).alias("evidence"))


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a listener may have written them: turned, doubled in a letter, with other vowels, as they are, or nothing like them."""
    p, k = F.col("p_name"), F.col("p_partkey") % 5
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    name = F.when(k == 0, F.upper(turned)).when(k == 1, F.concat(turned, F.lit("s"))).when(k == 2, F.translate(turned, "aeiou", "eioua")).when(k == 3, p).otherwise(F.concat(F.lit("Unknown "), F.col("p_brand")))
    return load(spark, sf_dir, "part").select(F.col("p_type").alias("project"), name.alias("name")).distinct()


def _overrides(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([("unknown brand#1", "Brand One"), ("unknown brand#2", "unknown brand#2")], "key string, resolved string"), spark.createDataFrame([("unknown brand#3",)], "key string")


def alias_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    over, never = _overrides(spark)
    return lexicon.resolve(_heard(spark, sf_dir), _spellings(spark, sf_dir), over, never, replace(DEFAULTS, fuzzy_threshold=2.0), phonetic=False)


def alias_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    over, never = _overrides(spark)
    return lexicon.resolve(_heard(spark, sf_dir), _spellings(spark, sf_dir), over, never)


def alias_phonetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", metaphone("name").alias("sound")).groupBy("sound").agg(F.count("*").alias("n"), F.min("name").alias("name"))


def _fixes() -> Column:
    return F.array(*[F.struct(F.lit(a).alias("original"), F.lit(b).alias("resolved"), F.lit(c).alias("applied")) for a, b, c in FIXES])


def apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("project", F.md5(lexicon.apply_corrections(F.col("text"), _fixes())).alias("digest"))


def both_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = _documents(spark, sf_dir).select("project", F.posexplode(lexicon.both_spellings(F.col("text"), _fixes())).alias("n", "variant"))
    return variants.select("project", "n", F.md5("variant").alias("digest"))


def context_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    extra = spark.createDataFrame([("en", "", "English things", ["the", "thing", "ation"]), ("de", "Reich", "", ["und", "ung"]), ("es", "", "", ["ción", "que"]), ("fr", "Pays", "Langue", ["ment", "que"])], "pack string, franchise string, subject string, terminology array<string>")
    chosen = lexicon.select_packs(docs, _packs(spark)).join(extra, "pack").join(_packs(spark).select("pack", "search_tag"), "pack")
    rows = [("en", 0, "ander", "Ander", "character"), ("en", 1, "thing", "Thing", "place"), ("en", 2, "reer", "Reer", ""), ("de", 0, "ein", "Ein", "place"), ("de", 1, "ver", "Ver", "character"), ("es", 0, "os", "Os", "event"), ("fr", 0, "eau", "Eau", "place"), ("fr", 1, "ou", "Ou", "odd")]
    spellings = spark.createDataFrame(rows, "pack string, entity_ord int, spelling string, canonical string, type string")
    merged = analysis.merge_pack_context(docs, chosen, spellings)
    return merged.select("project", "franchise", "subject", "search_tag", *[F.array_join(c, "|").alias(c) for c in ("terminology", "characters", "places", "events")])


def heuristic_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = [F.array(*[F.lit(x) for x in v]).alias(k) for k, v in (("characters", CHARACTERS), ("places", PLACES), ("terminology", TERMS))]
    fixed = [F.lit("").alias("topic"), F.lit("").alias("interpretation"), F.when(F.col("project") % 7 == 0, "COMIC").otherwise("B_ROLL").alias("visual_intent"), F.lit(0.0).alias("confidence")]
    out = analysis.heuristic_analysis(_documents(spark, sf_dir).select("project", F.col("text").alias("narration"), *fixed, *arrays))
    return out.select("project", F.array_join("entities", "|").alias("entities"), "location", "topic", "interpretation", "visual_intent", "confidence")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.transform(F.slice(T.words(F.col("text")), 1, 2), lambda w: T.strip_punctuation(w))
    entities = F.when(F.col("turn") % 3 == 0, two).otherwise(F.array().cast("array<string>"))
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project"), F.col("turn").cast("int").alias("index"), F.col("text").alias("narration"), entities.alias("entities"))


def backfill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.backfill_entities(_turns(spark, sf_dir)).select("project", "index", F.array_join("entities", "|").alias("entities"))


def query_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = analysis.backfill_entities(_turns(spark, sf_dir))
    seg = seg.select(
        "project", "index", "narration", F.array_join(F.slice(T.words(F.col("narration")), 1, 6), " ").alias("topic"), F.lit("").alias("event"), F.when(F.col("index") % 2 == 0, "Thing").otherwise("").alias("location"),
        F.element_at(F.array(*[F.lit(k) for k in search.PLAN]), (F.col("index") % 8 + 1).cast("int")).alias("visual_intent"), "entities", F.array(*[F.lit(v) for v in ("the Thing", "Ander Reer", "Ander")]).alias("vocabulary"), F.lit("Old Tale").alias("tag"), _fixes().alias("corrections"),
    )
    return search.build_queries(seg)


QUERIES = {f.__name__: f for f in (pack_activation, entity_candidates, alias_exact, alias_cascade, alias_phonetic, apply_corrections, both_spellings, context_merge, heuristic_intent, backfill_forward, query_build)}

_L = "[^\\p{L}\\p{N}_]"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


_HITS_SQL = " UNION ALL ".join(f"SELECT doc_id AS project, '{p}' AS pack, {o} AS pack_ord, {m} AS min_triggers FROM documents WHERE regexp_matches(text, '(?i)(^|{_L}){t}({_L}|$)')" for p, o, m, triggers, _ in PACKS for t in triggers)
_SELECTED_SQL = f"""hits AS (SELECT project, pack, pack_ord, min_triggers, count(*) AS hits FROM ({_HITS_SQL}) GROUP BY ALL),
selected AS (SELECT project, pack, hits, CAST(row_number() OVER (PARTITION BY project ORDER BY hits DESC, pack_ord) AS INTEGER) AS rank FROM hits WHERE hits >= min_triggers)"""


def _swap(text: str, original: str, resolved: str) -> str:
    """Whole words replaced twice, as a match takes the character on either side along."""
    one = lambda x: f"regexp_replace({x}, '(?i)(^|{_L}){original}({_L}|$)', '\\1{resolved}\\2', 'g')"
    return one(one(text))


def _corrected_sql(text: str) -> str:
    for original, resolved, applied in sorted(FIXES, key=lambda f: (-len(f[0]), f[0])):
        text = _swap(text, original, resolved) if applied else text
    return text


_SENTENCES = "string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1␞', 'g'), '␞')"
_STOP, _NOT_NAMES, _CONT = _list(lexicon.STOPWORDS), _list(analysis.NOT_NAMES), _list(analysis.CONTINUATION)
_FLAT = "regexp_replace(text, '[A-Za-z0-9_]*[^\\x00-\\x7F][\\p{L}\\p{N}_]*', '~', 'g')"
_SEARCHABLE = lambda x: f"(length(trim({x})) >= 3 AND NOT (upper(trim({x})) = trim({x}) AND lower(trim({x})) <> trim({x}) AND NOT regexp_matches(trim({x}), '\\s')) AND NOT regexp_matches(trim({x}), '\\p{{Nd}}'))"
_BASE_INPUTS = """heard AS (SELECT DISTINCT p_type AS project, CASE p_partkey % 5 WHEN 0 THEN upper(turned) WHEN 1 THEN turned || 's' WHEN 2 THEN translate(turned, 'aeiou', 'eioua') WHEN 3 THEN p_name ELSE 'Unknown ' || p_brand END AS original
  FROM (SELECT *, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS turned FROM part)),
keyed AS (SELECT project, original, lower(trim(regexp_replace(original, '\\s+', ' ', 'g'))) AS key FROM heard),
spelled AS (SELECT p_name AS canonical, CAST(min(p_partkey) AS INTEGER) AS ord, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS key FROM part GROUP BY p_name),
once AS (SELECT key, arg_min(canonical, ord) AS canonical, 0.7::DOUBLE + min(ord) % 4 * 0.1::DOUBLE AS confidence FROM spelled GROUP BY key)"""

ORACLE_SQL = {
    "pack_activation": f"WITH {_SELECTED_SQL} SELECT project, pack, hits, rank FROM selected",
    "entity_candidates": f"""WITH flat AS (SELECT doc_id AS project, {_FLAT} AS text FROM documents),
phrases AS (SELECT project, unnest(regexp_extract_all(s, '\\b[A-Z][A-Za-z''’-]{{2,}}(?:\\s+[A-Z][A-Za-z''’-]{{2,}})?\\b')) AS phrase FROM (SELECT project, unnest({_SENTENCES}) AS s FROM flat)),
words AS (SELECT project, string_split_regex(phrase, '\\s+') AS w FROM phrases),
names AS (SELECT project, CASE WHEN NOT list_contains({_STOP}, lower(w[1])) THEN array_to_string(w, ' ') WHEN len(w) > 1 AND NOT list_contains({_STOP}, lower(w[2])) THEN w[2] END AS name FROM words)
SELECT project, name, count(*) AS n FROM names WHERE name IS NOT NULL AND length(name) >= 3 GROUP BY project, name""",
    "alias_exact": f"""WITH {_BASE_INPUTS},
open AS (SELECT * FROM keyed WHERE key <> 'unknown brand#3' AND key <> 'unknown brand#2'),
joined AS (SELECT o.*, c.canonical AS same, e.canonical AS resolved, e.confidence FROM open o LEFT JOIN (SELECT DISTINCT canonical FROM spelled) c ON c.canonical = o.key LEFT JOIN once e ON e.key = o.key)
SELECT project, original, CASE WHEN key = 'unknown brand#1' THEN 'Brand One' ELSE resolved END AS resolved, CASE WHEN key = 'unknown brand#1' THEN 1.0::DOUBLE WHEN resolved IS NOT NULL THEN round(least(1.0::DOUBLE, confidence), 3) END AS confidence,
  CASE WHEN key = 'unknown brand#1' THEN 'override' WHEN resolved IS NOT NULL THEN 'exact' END AS method, CASE WHEN key = 'unknown brand#1' THEN true WHEN resolved IS NOT NULL THEN confidence >= 0.75::DOUBLE END AS applied,
  CASE WHEN key = 'unknown brand#1' THEN 'override' WHEN resolved IS NOT NULL THEN 'turned' END AS reason
FROM joined WHERE key = 'unknown brand#1' OR same IS NULL""",
    "apply_corrections": f"SELECT doc_id AS project, md5({_corrected_sql('text')}) AS digest FROM documents",
    "both_spellings": f"""WITH variants AS (SELECT doc_id AS project, list_concat([text], {", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|{_L}){a}({_L}|$)') THEN [{_swap('text', a, b)}] ELSE [] END" for a, b, c in FIXES if not c)}) AS v FROM documents)
SELECT project, CAST(n AS INTEGER) AS n, md5(variant) AS digest FROM (SELECT project, unnest(range(len(v))) AS n, unnest(v) AS variant FROM variants)""",
    "context_merge": f"""WITH {_SELECTED_SQL},
extra(pack, franchise, subject, terminology, search_tag) AS (VALUES ('en', '', 'English things', ['the', 'thing', 'ation'], 'tag-en'), ('de', 'Reich', '', ['und', 'ung'], 'tag-de'), ('es', '', '', ['ción', 'que'], 'tag-es'), ('fr', 'Pays', 'Langue', ['ment', 'que'], 'tag-fr')),
chosen AS (SELECT s.project, s.pack, s.rank, x.*, lower(d.text) AS low FROM selected s JOIN extra x USING (pack) JOIN documents d ON d.doc_id = s.project),
terms AS (SELECT project, term, min(rank * 100 + k) AS "at" FROM (SELECT project, rank, low, unnest(terminology) AS term, unnest(range(len(terminology))) AS k FROM chosen) WHERE contains(low, term) GROUP BY ALL),
term_lists AS (SELECT project, list(term ORDER BY "at") AS terminology FROM terms GROUP BY project),
scalars AS (SELECT project, first(nullif(franchise, '') ORDER BY rank) FILTER (WHERE franchise <> '') AS franchise, first(subject ORDER BY rank) FILTER (WHERE subject <> '') AS subject, first(search_tag ORDER BY rank) FILTER (WHERE search_tag <> '') AS search_tag FROM chosen GROUP BY project),
spellings(pack, entity_ord, spelling, canonical, type) AS (VALUES ('en', 0, 'ander', 'Ander', 'character'), ('en', 1, 'thing', 'Thing', 'place'), ('en', 2, 'reer', 'Reer', ''), ('de', 0, 'ein', 'Ein', 'place'), ('de', 1, 'ver', 'Ver', 'character'), ('es', 0, 'os', 'Os', 'event'), ('fr', 0, 'eau', 'Eau', 'place'), ('fr', 1, 'ou', 'Ou', 'odd')),
found AS (SELECT c.project, s.canonical, CASE s.type WHEN 'place' THEN 'places' WHEN 'event' THEN 'events' ELSE 'characters' END AS kind, min(c.rank * 100 + s.entity_ord) AS "at" FROM chosen c JOIN spellings s ON s.pack = c.pack AND (contains(c.low, s.spelling) OR contains(c.low, lower(s.canonical))) GROUP BY ALL),
lists AS (SELECT project, coalesce(list(canonical ORDER BY "at") FILTER (WHERE kind = 'characters'), []) AS characters, coalesce(list(canonical ORDER BY "at") FILTER (WHERE kind = 'places'), []) AS places, coalesce(list(canonical ORDER BY "at") FILTER (WHERE kind = 'events'), []) AS events FROM found GROUP BY project)
SELECT project, franchise, subject, search_tag, array_to_string(coalesce(terminology, []), '|') AS terminology, array_to_string(characters, '|') AS characters, array_to_string(places, '|') AS places, array_to_string(events, '|') AS events FROM scalars LEFT JOIN term_lists USING (project) LEFT JOIN lists USING (project)""",
    "heuristic_intent": f"""WITH found AS (SELECT doc_id AS project, text, list_filter({_list(CHARACTERS)}, lambda x: contains(lower(text), lower(x))) AS c, list_filter({_list(PLACES)}, lambda x: contains(lower(text), lower(x))) AS p, list_filter({_list(TERMS)}, lambda x: contains(lower(text), lower(x))) AS t FROM documents)
SELECT project, array_to_string(list_concat(c, t), '|') AS entities, coalesce(p[1], '') AS location, array_to_string(regexp_extract_all(split_part(text, '.', 1), '[^\\x20\\x09-\\x0D]+')[1:12], ' ') AS topic,
  CASE WHEN len(c) > 0 AND len(p) > 0 THEN c[1] || ' at ' || p[1] || '. Fall back to a portrait of ' || c[1] || ' or a wide shot of ' || p[1] || '.' WHEN len(c) > 0 THEN c[1] || ' in this moment. Fall back to a portrait or a known scene featuring them.'
    WHEN len(p) > 0 THEN 'Establishing shot of ' || p[1] || '. Fall back to a wide environment shot.' ELSE 'No named subject in this line; use broad B-roll for the surrounding topic.' END AS interpretation,
  CASE WHEN project % 7 = 0 THEN 'COMIC' WHEN len(c) > 0 AND len(p) > 0 THEN 'GAME_SCENE' WHEN len(c) > 0 THEN 'CHARACTER' WHEN len(p) > 0 THEN 'LOCATION' ELSE 'B_ROLL' END AS visual_intent,
  round(least(0.55::DOUBLE, 0.2::DOUBLE + 0.1::DOUBLE * (len(c) + len(p) + len(t))), 3) AS confidence FROM found""",
    "backfill_forward": f"""WITH seg AS (SELECT conv_id AS project, CAST(turn AS INTEGER) AS index, text, CASE WHEN turn % 3 = 0 THEN list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:2], lambda w: trim(w, '.,;:!?"''()[]')) ELSE [] END AS entities,
    list_transform({_SENTENCES}, lambda s: list_transform(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+'), lambda w: trim(w, '.,;:!?"''()[]'))) AS sentences FROM conversations),
evidence AS (SELECT project, list(DISTINCT lower(w)) AS evidence FROM (SELECT project, unnest(flatten(list_transform(sentences, lambda ws: ws[2:]))) AS w FROM seg) WHERE length(w) >= 3 AND regexp_matches(w, '^\\p{{Lu}}') GROUP BY project),
marked AS (SELECT s.*, list_transform(sentences, lambda ws: array_to_string(list_transform(ws, lambda w, i: CASE WHEN length(w) >= 3 AND regexp_matches(w, '^\\p{{Lu}}') AND NOT list_contains({_NOT_NAMES}, lower(w)) AND (i > 1 OR list_contains(coalesce(evidence, []), lower(w))) THEN w ELSE '|' END), ' ')) AS m FROM seg s LEFT JOIN evidence USING (project)),
runs AS (SELECT *, list_filter(list_transform(string_split(array_to_string(m, ' | '), '|'), lambda r: trim(r)), lambda r: r <> '') AS runs FROM marked),
firsts AS (SELECT *, list_filter(runs, lambda r, i: list_position(list_transform(runs, lambda x: lower(x)), lower(r)) = i) AS names FROM runs),
own AS (SELECT *, CASE WHEN len(entities) > 0 THEN entities ELSE list_filter(names, lambda n: {_SEARCHABLE('n')})[1:3] END AS own FROM firsts),
recent AS (SELECT *, CASE WHEN len(own) > 0 THEN list_filter(own, lambda n: {_SEARCHABLE('n')})[1:2] END AS recent FROM own),
carried AS (SELECT *, last_value(recent IGNORE NULLS) OVER (PARTITION BY project ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM recent)
SELECT project, index, array_to_string(CASE WHEN len(own) > 0 THEN own WHEN carried IS NOT NULL AND list_has_any(list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:12], lambda w: lower(trim(w, '.,;:!?"'''))), {_CONT}) THEN carried ELSE [] END, '|') AS entities FROM carried""",
}

"""Entity resolution: packs of names, candidate names in a text, and the cascade that corrects misheard ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.phonetics import metaphone, similarity
from ..params import DEFAULTS, Params

PACKS = "pack string, pack_ord int, min_triggers int, triggers array<string>, search_tag string"
SPELLINGS = "pack string, pack_ord int, entity_ord int, spelling_ord int, spelling string, canonical string, type string, confidence double, reason string, evidence array<string>"

# Words that begin a capitalised phrase without being part of a name.
STOPWORDS = (
    "the a an and but or when what where who whom whose that this these those he she they it his her their its there here every none "
    "nobody everyone someone anything nothing for from with without before after during if because while as at by in into on of to up "
    "down then now so yet still even one two three four five first second last next also however although though since until unless "
    "whether both each other another such same just only very much many most more less least well back over under about above below "
    "between through against within across behind beyond i you we us me him them my your our mine yours ours is are was were be been "
    "being have has had do does did will would can could should may might must shall"
).split()
NAME = r"\b[A-Z][A-Za-z'’-]{2,}(?:\s+[A-Z][A-Za-z'’-]{2,})?\b"


def quoted(term: Column) -> Column:
    """A whole-word, case-insensitive pattern of the term."""
    return F.concat(F.lit("(?i)\\b\\Q"), term, F.lit("\\E\\b"))


def trigger_hits(texts: DataFrame, packs: DataFrame) -> DataFrame:
    """project, text and packs -> project, pack, pack_ord, min_triggers, hits: distinct triggers of a pack that stand in the text.

    Packs are configuration: each is a file that somebody wrote. Their table is sent to every task only while it is small.
    """
    triggers = packs.select("pack", "pack_ord", "min_triggers", F.explode(F.array_distinct("triggers")).alias("trigger"))
    hit = texts.join(triggers, F.rlike("text", quoted(F.col("trigger"))))
    return hit.groupBy("project", "pack", "pack_ord", "min_triggers").agg(F.count("*").alias("hits"))


def select_packs(texts: DataFrame, packs: DataFrame) -> DataFrame:
    """Packs with enough hits, numbered from the one with the most; ties in load order."""
    hits = trigger_hits(texts, packs).where("hits >= min_triggers")
    order = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("hits"), "pack_ord"))
    return hits.select("project", "pack", "hits", order.alias("rank"))


def extract_candidates(texts: DataFrame) -> DataFrame:
    """project, text -> project, name, n: capitalised phrases of up to two words, leading stopwords dropped, with their counts."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    phrases = texts.select("project", F.explode(T.sentences(F.coalesce("text", F.lit("")))).alias("s")).select("project", F.explode(F.regexp_extract_all("s", F.lit(NAME), F.lit(0))).alias("phrase"))
    words = F.split("phrase", r"\s+")
    first, second = F.element_at(words, 1), F.try_element_at(words, F.lit(2))
    is_stop = lambda w: F.array_contains(stop, F.lower(w))
    kept = F.when(~is_stop(first), F.array_join(words, " ")).when(second.isNotNull() & ~is_stop(second), second)
    return phrases.select("project", kept.alias("name")).where(F.col("name").isNotNull() & (F.length("name") >= 3)).groupBy("project", "name").agg(F.count("*").alias("n"))


def first_spellings(spellings: DataFrame) -> DataFrame:
    """One row for each normalised spelling: the first in order of pack, entity and spelling."""
    keyed = spellings.withColumn("key", T.normalize_name(F.col("spelling")))
    order = Window.partitionBy("key").orderBy("pack_ord", "entity_ord", "spelling_ord")
    return keyed.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def _correction(method: str, confidence: Column, scale: Column, params: Params) -> Column:
    raw = confidence * params.method_weights[method] * scale
    applied = F.lit(True) if method == "override" else raw >= params.apply_threshold
    return F.struct(F.col("canonical").alias("resolved"), F.round(F.least(F.lit(1.0), raw), 3).alias("confidence"), F.lit(method).alias("method"), applied.alias("applied"), F.col("reason").alias("reason"))


def similar_keys(names: DataFrame, spelled: DataFrame, threshold: float) -> DataFrame:
    """key and spelled (columns of distinct, non-null values) -> key, spelled, ratio of all pairs that reach the threshold, above 0.

    Matching blocks are a common subsequence, so a pair that reaches the threshold differs by k = (1 - threshold) * (sum of the lengths)
    inserted and deleted characters at most. Of k + 1 pieces of a spelling one is whole in the name, moved by no more than these allow.
    So candidates are an equi-join on both lengths' k, the piece and its text; it loses no pair. The ratio is worked out once a pair.
    """
    whole = lambda c: F.floor(c).cast("int")
    most = min(threshold, 1.0)
    lengths = lambda n: F.sequence(F.ceil(n * most / (2 - most) - 1e-9).cast("int"), whole(n * (2 - most) / most + 1e-9))
    edits = lambda n, m: whole((1 - most) * (n + m) + 1e-9)
    start, stop = (whole((F.col("piece") + i) * F.col("m") / (F.col("k") + 1)) for i in (0, 1))
    text = lambda c, at: F.substring(F.col(c), at + 1, F.col("stop") - F.col("start"))

    at = spelled.withColumn("m", F.length("spelled"))
    at = at.select("spelled", "m", F.explode(F.array_distinct(F.transform(lengths(F.col("m")), lambda n: edits(n, F.col("m"))))).alias("k"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), "k")).alias("piece")).select("*", start.alias("start"), stop.alias("stop"))
    at = at.select("spelled", "m", "k", "piece", text("spelled", F.col("start")).alias("held"))

    own = names.withColumn("n", F.length("key"))
    own = own.select("key", "n", F.explode(lengths(F.col("n"))).alias("m")).withColumn("k", edits(F.col("n"), F.col("m")))
    own = own.select("*", F.explode(F.sequence(F.lit(0), "k")).alias("piece")).select("*", start.alias("start"), stop.alias("stop"))
    first = F.greatest(F.lit(0), F.col("start") - whole((F.col("k") + F.col("m") - F.col("n")) / 2))
    last = F.least(F.col("n") - (F.col("stop") - F.col("start")), F.col("start") + whole((F.col("k") + F.col("n") - F.col("m")) / 2))
    own = own.select("*", first.alias("first"), last.alias("last")).where("first <= last")
    own = own.select("*", F.explode(F.sequence("first", "last")).alias("place"))
    own = own.select("key", "m", "k", "piece", text("key", F.col("place")).alias("held")).distinct()

    pairs = own.join(at, ["m", "k", "piece", "held"]).select("key", "spelled").distinct()
    return pairs.withColumn("ratio", similarity("key", "spelled")).where(F.col("ratio") >= threshold)


def resolve(candidates: DataFrame, spellings: DataFrame, overrides: DataFrame, never: DataFrame, params: Params = DEFAULTS, phonetic: bool = True) -> DataFrame:
    """project, name -> project, original, resolved, confidence, method, applied, reason; resolved is null where the name stays open.

    overrides: key, resolved. never: key. A name on `never`, one that an override maps to itself, and one that is a canonical name already
    are left out. Override, exact, fuzzy and phonetic matches are tried in turn on what is left, each by a join, so that the dear ones
    see few names. Whether a correction is applied is decided on its confidence before rounding.
    """
    named = candidates.select("project", F.col("name").alias("original"), T.normalize_name(F.col("name")).alias("key"))
    named = named.join(never, "key", "left_anti")
    fixed = overrides.select("key", F.col("resolved").alias("canonical"), F.lit("override").alias("reason"))
    one = F.lit(1.0)
    by_override = named.join(fixed, "key")
    done = by_override.where(T.normalize_name(F.col("canonical")) != F.col("key")).select("project", "original", _correction("override", one, one, params).alias("c"))
    rest = named.join(fixed, "key", "left_anti")
    first = first_spellings(spellings).select("key", "canonical", "confidence", "reason", "pack_ord", "entity_ord", "spelling_ord")
    canonical = spellings.select(T.normalize_name(F.col("canonical")).alias("key")).distinct()
    rest = rest.join(canonical, "key", "left_anti")
    done = done.union(rest.join(first, "key").select("project", "original", _correction("exact", F.col("confidence"), one, params).alias("c")))
    rest = rest.join(first, "key", "left_anti")
    spelled = first.withColumnRenamed("key", "spelled")
    pairs = similar_keys(rest.select("key").distinct(), spelled.select("spelled"), params.fuzzy_threshold)
    near = rest.join(pairs, "key").join(spelled, "spelled")
    best = near.groupBy("project", "original", "key").agg(F.max_by(F.struct("canonical", "confidence", "reason", "ratio"), F.struct("ratio", -F.col("pack_ord"), -F.col("entity_ord"), -F.col("spelling_ord"))).alias("b"))
    done = done.union(best.select("project", "original", "b.*").select("project", "original", _correction("fuzzy", F.col("confidence"), F.col("ratio"), params).alias("c")))
    rest = rest.join(best, ["project", "original", "key"], "left_anti")
    if phonetic:
        order = Window.partitionBy("sound").orderBy("pack_ord", "entity_ord", "spelling_ord")
        sounds = first.withColumn("sound", metaphone("key")).where("sound <> ''").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "key")
        heard = rest.withColumn("sound", metaphone("key")).join(sounds, "sound")
        done = done.union(heard.select("project", "original", _correction("phonetic", F.col("confidence"), one, params).alias("c")))
        rest = rest.join(heard, ["project", "original"], "left_anti")
    left = rest.select("project", "original", F.lit(None).cast(done.schema["c"].dataType).alias("c"))
    return done.union(left).select("project", "original", "c.*")


def resolve_answers(answers: DataFrame, open_names: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """A model's answers for open names: project, original, resolved, confidence, reason. It cannot overrule the cascade, as only open names join.

    Malformed answers (no name, nothing resolved, no number) are skipped; confidence is clamped, but applied is decided before that.
    """
    good = answers.where((F.trim(F.coalesce("original", F.lit(""))) != "") & (F.trim(F.coalesce("resolved", F.lit(""))) != "") & F.col("confidence").isNotNull())
    joined = good.join(open_names.select("project", "original").distinct(), ["project", "original"])
    return joined.select("project", "original", "resolved", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")), 3).alias("confidence"), F.lit("llm").alias("method"), (F.col("confidence") >= params.apply_threshold).alias("applied"), "reason")


def _replaced(text: Column, original: Column, resolved: Column) -> Column:
    return F.regexp_replace(text, quoted(original), F.regexp_replace(resolved, r"([\\$])", r"\\$1"))


def apply_corrections(text: Column, corrections: Column) -> Column:
    """The text with applied corrections (array of struct original, resolved, applied) put in, the longest original first, one after another."""
    used = F.filter(corrections, lambda c: c["applied"])
    order = F.array_sort(F.transform(used, lambda c: F.struct((-F.length(c["original"])).alias("k"), c["original"].alias("original"), c["resolved"].alias("resolved"))))
    return F.aggregate(order, text, lambda acc, c: _replaced(acc, c["original"], c["resolved"]))


def both_spellings(text: Column, corrections: Column) -> Column:
    """The text, and for each correction not applied whose name it has, the text with that one put in; distinct, in order."""
    held = F.filter(corrections, lambda c: ~c["applied"] & F.rlike(text, quoted(c["original"])))
    return F.array_distinct(F.concat(F.array(text), F.transform(held, lambda c: _replaced(text, c["original"], c["resolved"]))))


def packs_from_yaml(spark: SparkSession, documents: list[tuple[str, dict]]) -> tuple[DataFrame, DataFrame]:
    """(name, parsed document) of each pack file in order -> tables PACKS and SPELLINGS; documents without a name or entities are skipped."""
    packs, spellings = [], []
    for order, (name, doc) in enumerate(documents):
        if not isinstance(doc, dict) or not isinstance(doc.get("entities"), list):
            continue
        pack = str(doc.get("name") or name)
        packs.append((pack, order, int(doc.get("min_triggers", 2)), [str(t) for t in doc.get("triggers") or []], doc.get("search_tag") or ""))
        for e, entity in enumerate(doc["entities"]):
            if not isinstance(entity, dict) or not entity.get("canonical"):
                continue
            for k, spelling in enumerate(entity.get("aliases") or []):
                spellings.append((pack, order, e, k, str(spelling), str(entity["canonical"]), str(entity.get("type") or ""), float(entity.get("confidence", 0.8)), str(entity.get("reason") or ""), [str(x) for x in entity.get("evidence") or []]))
    return spark.createDataFrame(packs, PACKS), spark.createDataFrame(spellings, SPELLINGS)


def overrides_from_mapping(spark: SparkSession, document: dict | None) -> tuple[DataFrame, DataFrame]:
    """A parsed overrides file (corrections: items with original and resolved; never_correct: names) -> tables (key, resolved) and (key).

    Of several items for one name the last counts; broken items, and a file that is no mapping, are left out.
    """
    key = lambda name: " ".join(str(name).lower().split())
    document = document if isinstance(document, dict) else {}
    items = [i for i in document.get("corrections") or [] if isinstance(i, dict) and i.get("original") and i.get("resolved")]
    fixed = {key(i["original"]): str(i["resolved"]) for i in items}
    never = {key(n) for n in document.get("never_correct") or []}
    return spark.createDataFrame(sorted(fixed.items()), "key string, resolved string"), spark.createDataFrame([(n,) for n in sorted(never)], "key string")

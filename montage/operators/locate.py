"""Videos: what kind of footage a hit is, where in it a moment lies, and which span to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import DEFAULTS, Params

# Title words by what they tell of a video.
EXACT = ("cutscene", "cut scene", "full scene", "scene", "cinematic", "trailer", "all cutscenes", "movie", "story", "ending", "finale", "confrontation")
COMMENTARY = ("reaction", "review", "explained", "analysis", "breakdown", "theory", "commentary", "discussion", "podcast", "top 10", "ranking", "tier list", "vs ", "versus", "guide", "tips", "build", "how to")
PLAYTHROUGH = ("let's play", "lets play", "playthrough", "walkthrough", "gameplay", "part ", "episode ", "ep.", "stream", "vod", "full game", "longplay")
CLASSES = ("EXACT_SCENE", "LIKELY_EXACT_SCENE", "RELATED_FOOTAGE", "CONTEXTUAL")
METHODS = ("captions", "chapters", "description", "metadata", "similarity")
# Fixed value: a time of the form [H:]MM:SS at a line's start, and what follows it, which may be the next line.
STAMP = r"^\s*\(?((?:\d{1,2}:)?\d{1,2}:\d{2})\)?\s*[-–—:.)\]]*\s*(.+?)\s*$"
#: With Java's flags for lines that \n alone ends, ^ and $ at lines, and white space of all scripts.
STAMP_LINE = "(?dmU)" + STAMP
SHORT_S, METADATA_S, INTRO_SHARE, INTRO_S = 600, 300, 0.10, 30.0


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _has_any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def _in(terms: Column, text: Column) -> Column:
    return F.filter(terms, lambda t: F.contains(F.lower(_text(text)), F.lower(t)))


def relevance_terms(entities: Column, event: Column, location: Column, topic: Column) -> Column:
    """Entities, event and place of over two characters; without any, the first four long words of the topic."""
    terms = F.filter(F.concat(entities, F.array(event, location)), lambda t: F.length(_text(t)) > 2)
    return F.when(F.size(terms) > 0, terms).otherwise(F.slice(F.filter(T.words(topic), lambda w: F.length(w) > 3), 1, 4))


def relevance(terms: Column, title: Column, description: Column) -> Column:
    """Share of the terms in title and description; without any, half the share of their tokens in the title."""
    matched = _in(terms, F.concat_ws(" ", _text(title), _text(description)))
    own = T.tokens(F.array_join(terms, " "))
    shared = F.array_intersect(own, T.tokens(title))
    return F.when(F.size(terms) == 0, 0.0).when(F.size(matched) > 0, F.size(matched) / F.size(terms)).when(F.size(shared) > 0, 0.5 * F.size(shared) / F.greatest(F.lit(1), F.size(own))).otherwise(0.0)


def classify(rel: Column, title: Column, duration: Column) -> Column:
    """The first that holds: irrelevant, commentary, the scene itself (short, or not), a playthrough, a strong match, related."""
    name = F.lower(_text(title))
    exact = _has_any(name, EXACT) & (rel >= 0.5)
    return (
        F.when(rel <= 0, "CONTEXTUAL").when(_has_any(name, COMMENTARY), "CONTEXTUAL").when(exact & (duration > 0) & (duration <= SHORT_S), "EXACT_SCENE").when(exact, "LIKELY_EXACT_SCENE")
        .when(_has_any(name, PLAYTHROUGH), "RELATED_FOOTAGE").when(rel >= 0.5, "LIKELY_EXACT_SCENE").otherwise("RELATED_FOOTAGE")
    )


def class_rank(name: Column) -> Column:
    out = F.lit(len(CLASSES))
    for i, c in enumerate(CLASSES):
        out = F.when(name == c, i).otherwise(out)
    return out


def search_videos(hits: DataFrame) -> DataFrame:
    """project, index, order of arrival, video_id, class, relevance, confidence -> each video once (the first), ranked by class, relevance, confidence, id."""
    once = hits.withColumn("r", F.row_number().over(Window.partitionBy("project", "index", "video_id").orderBy("arrival"))).where("r = 1").drop("r")
    order = Window.partitionBy("project", "index").orderBy(class_rank(F.col("class")), F.desc("relevance"), F.desc("confidence"), "video_id")
    return once.withColumn("rank", F.row_number().over(order))


def moment_terms(entities: Column, event: Column, location: Column, topic: Column) -> Column:
    return F.filter(F.concat(entities, F.array(event, location, topic)), lambda t: F.length(_text(t)) > 2)


def overlap(text: Column, terms: Column) -> Column:
    """Share of the terms in the text; without any, 0.6 of the share of their tokens, if it has two of them at least."""
    matched, own = _in(terms, text), T.tokens(F.array_join(terms, " "))
    shared = F.size(F.array_intersect(own, T.tokens(text)))
    return F.when(F.size(terms) == 0, 0.0).when(F.size(matched) > 0, F.size(matched) / F.size(terms)).when(shared >= 2, shared / F.size(own) * 0.6).otherwise(0.0)


def description_stamps(description: Column) -> Column:
    """array<struct<start,label>> of the lines that begin with a time; a time alone takes the next line as its label."""
    text = _text(description)
    times, labels = (F.regexp_extract_all(text, F.lit(STAMP_LINE), F.lit(k)) for k in (1, 2))
    return F.zip_with(times, labels, lambda t, label: F.struct(T.parse_timecode(t).alias("start"), label.alias("label")))


def _best(items: Column, text_field: str, terms: Column) -> Column:
    """The item that overlaps the terms most, the first of equals, with its score; null if none does."""
    scored = F.transform(items, lambda x, i: F.struct(overlap(x[text_field], terms).alias("score"), (-i).alias("minus"), x.alias("item")))
    best = F.array_max(F.filter(F.transform(scored, lambda s: F.struct(s["score"].alias("score"), s["minus"].alias("minus"))), lambda s: s["score"] > 0))
    return F.when(best.isNotNull(), F.struct(best["score"].alias("score"), F.get(items, -best["minus"]).alias("item")))


def locate(hits: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds moments: array<struct<start,end,method,confidence>>, the surest first, of the five ways to find one.

    hits has terms, duration, span (the segment's length), title, description, captions (array<struct<start,end,text>>), chapters (array<struct<start_time,end_time,title>>).
    Ends and starts are clamped to the video where its length is known; of equal confidences the better way comes first.
    """
    c, span, duration = params.method_confidence, F.col("span"), F.col("duration")
    # the best item of each list is found once
    found = hits.withColumn("_caption", _best(F.col("captions"), "text", F.col("terms"))).withColumn("_chapter", _best(F.col("chapters"), "title", F.col("terms")))
    found = found.withColumn("_line", _best(description_stamps(F.col("description")), "label", F.col("terms")))
    titled, both = overlap(F.col("title"), F.col("terms")), overlap(F.concat_ws(" ", _text(F.col("title")), _text(F.col("description"))), F.col("terms"))
    found = found.withColumn("_title", titled).withColumn("_both", both)

    def moment(i: int, start: Column, end: Column, score: Column, when: Column) -> Column:
        name = METHODS[i]
        known = F.coalesce(duration, F.lit(0.0)) > 0
        a = F.when(known, F.greatest(F.lit(0.0), F.least(start, duration - 0.1))).otherwise(start)
        b = F.when(known, F.greatest(a, F.least(end, duration))).otherwise(end)
        sure = F.round(c[name] * score, 3)
        return F.when(when, F.struct((-sure).alias("minus"), F.lit(i).alias("way"), a.cast("double").alias("start"), b.cast("double").alias("end"), F.lit(name).alias("method"), sure.alias("confidence")))

    cap, chap, line = F.col("_caption"), F.col("_chapter"), F.col("_line")
    intro = F.least(F.lit(5.0), F.greatest(F.lit(0.0), duration * 0.05))
    ways = F.array(
        moment(0, cap["item"]["start"], F.coalesce(cap["item"]["end"], cap["item"]["start"] + span), cap["score"], cap.isNotNull()),
        moment(1, chap["item"]["start_time"], F.coalesce(chap["item"]["end_time"], chap["item"]["start_time"] + span), chap["score"], chap.isNotNull()),
        moment(2, line["item"]["start"], line["item"]["start"] + span, line["score"], line.isNotNull()),
        moment(3, intro, F.least(duration, intro + span), F.col("_title"), (F.col("_title") > 0) & (duration > 0) & (duration <= METADATA_S)),
        moment(4, F.lit(0.0), span, F.col("_both"), F.col("_both") > 0),
    )
    ordered = F.array_sort(F.filter(ways, lambda m: m.isNotNull()))
    out = F.transform(ordered, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["method"].alias("method"), m["confidence"].alias("confidence")))
    return found.withColumn("moments", out).drop("_caption", "_chapter", "_line", "_title", "_both")


def best_moment(moments: Column) -> Column:
    return F.try_element_at(moments, F.lit(1))


def method_histogram(located: DataFrame) -> DataFrame:
    return located.select(F.coalesce(best_moment(F.col("moments"))["method"], F.lit("none")).alias("method")).groupBy("method").agg(F.count("*").alias("n"))


def representative_span(duration: Column, span: Column, params: Params = DEFAULTS) -> Column:
    """A span of footage that shows no single moment: past the intro, long enough, pulled back at the end; null if under half a second."""
    want = F.greatest(span, F.lit(1.0)) + 2 * params.padding_s
    start = F.least(duration * INTRO_SHARE, F.lit(INTRO_S))
    start = F.when(start + want > duration, F.greatest(F.lit(0.0), duration - want)).otherwise(start)
    end = F.least(duration, start + want)
    return F.when((F.coalesce(duration, F.lit(0.0)) > 0) & (end - start >= 0.5), F.struct(F.round(start, 3).alias("start"), F.round(end, 3).alias("end")))


def span_for(kind: Column, best: Column, duration: Column, span: Column, params: Params = DEFAULTS) -> Column:
    """The padded span to take: around a moment found surely enough; else null for a class that claims one, else representative."""
    located = F.coalesce(best["confidence"] >= params.clip_min_confidence, F.lit(False))
    start, end = F.greatest(F.lit(0.0), best["start"] - params.padding_s), best["end"] + params.padding_s
    end = F.when(end - start < span, start + span + params.padding_s).otherwise(end)
    known = F.coalesce(duration, F.lit(0.0)) > 0
    end = F.when(known, F.least(end, duration)).otherwise(end)
    start = F.when(known, F.least(start, F.greatest(F.lit(0.0), end - 0.5))).otherwise(start)
    exact = F.when(end > start, F.struct(F.round(start, 3).alias("start"), F.round(end, 3).alias("end")))
    return F.when(located, exact).when(kind.isin("EXACT_SCENE", "LIKELY_EXACT_SCENE"), F.lit(None)).otherwise(representative_span(duration, span, params))


def clip_confidence(kind: Column, best: Column, params: Params = DEFAULTS) -> Column:
    """The class's confidence, for classes that claim a moment discounted by how surely it was found."""
    base = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in params.class_confidence.items() for x in (F.lit(k), F.lit(v))]), kind), F.lit(0.0))
    sure = F.least(F.lit(1.0), F.coalesce(best["confidence"], F.lit(0.0)))
    return F.round(F.when(kind.isin("EXACT_SCENE", "LIKELY_EXACT_SCENE"), base * (0.5 + 0.5 * sure)).otherwise(base), 3)


def take_clips(records: DataFrame, params: Params = DEFAULTS, budget_bytes: int | None = None, arrival: tuple[str, ...] = ()) -> DataFrame:
    """project, index, rank, class, outcome, bytes -> the outcomes that count: contextual records skipped, failures included, so many a segment;
    a project stops once the bytes before would reach the budget. Records of equal rank come in the order of the columns of arrival, which are left out."""
    w = Window.partitionBy("project", "index").orderBy("rank", *arrival)
    out = records.where(F.col("class") != "CONTEXTUAL").withColumn("n", F.row_number().over(w)).where(F.col("n") <= params.clips_per_segment)
    if budget_bytes is not None:
        before = Window.partitionBy("project").orderBy("index", "rank", *arrival).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("spent", F.coalesce(F.sum("bytes").over(before), F.lit(0))).where(F.col("spent") < budget_bytes).drop("spent")
    return out.drop("n", *arrival)


def clip_cache_key(video_id: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("|", video_id, F.format_string("%.1f", F.round(start, 1)), F.format_string("%.1f", F.round(end, 1)))


def clip_picks(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(picks of clips that were taken, reasons of segments without one)."""
    ok = outcomes.where("outcome = 'ok'").select("project", "index", F.lit("clip").alias("kind"), "path", F.row_number().over(Window.partitionBy("project", "index").orderBy("rank")).alias("rank"), "confidence")
    failed = outcomes.join(ok.select("project", "index").distinct(), ["project", "index"], "left_anti")
    return ok, failed.groupBy("project", "index").agg(F.min(F.struct("rank", "outcome"))["outcome"].alias("reason"))

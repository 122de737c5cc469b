"""Timed words: flattening, repair, boundaries between words, and renderings of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import DEFAULTS, Params

SENTENCE_END, CLAUSE_END = r"[.!?…][\"')\]]*$", r"[,;:–—][\"')\]]*$"


def flatten_words(transcripts: DataFrame) -> DataFrame:
    """project, segments (array of struct with words) -> project, pos, word, start, end; segment order, then word order."""
    outer = transcripts.select("project", F.posexplode("segments").alias("i", "s"))
    return outer.select("project", "i", F.posexplode("s.words").alias("j", "w")).select("project", F.struct("i", "j").alias("pos"), "w.word", "w.start", "w.end")


def synthesize_words(texts: DataFrame, pause_ms: tuple[int, int] = (300, 120)) -> DataFrame:
    """project, part, text -> project, part, pos, word, start_ms, end_ms: words timed by their length, with pauses after marks.

    A word lasts 120 ms and 36 for each of its first 12 characters; 300 ms follow a sentence's end, 120 a clause's, 260 every 17th word
    of a part. Times are whole milliseconds, so that sums are exact in any order of partitions.
    """
    flat = texts.select("project", "part", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))
    long = (120 + 36 * F.least(F.length("word"), F.lit(12))).cast("long")
    gap = F.when(F.col("word").rlike(SENTENCE_END), pause_ms[0]).when(F.col("word").rlike(CLAUSE_END), pause_ms[1]).otherwise(0) + F.when(F.col("pos") % 17 == 16, 260).otherwise(0)
    timed = flat.withColumn("long", long).withColumn("gap", gap.cast("long"))
    before = Window.partitionBy("project").orderBy("part", "pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("long") + F.col("gap")).over(before), F.lit(0))
    return timed.select("project", "part", "pos", "word", start.alias("start_ms"), (start + F.col("long")).alias("end_ms"))


def enforce_monotonic(words: DataFrame, order: list[str]) -> DataFrame:
    """No word starts before an earlier one has ended, nor ends before it starts; one cursor for each project.

    The cursor after a word is the greatest time seen so far, so a running maximum replaces the loop.
    """
    before = Window.partitionBy("project").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest("start_ms", F.lit(0), F.max(F.greatest("start_ms", "end_ms")).over(before))
    return words.withColumn("new_start", start).withColumn("end_ms", F.greatest("end_ms", "new_start")).withColumn("start_ms", F.col("new_start")).drop("new_start")


def boundaries(words: DataFrame, order: list[str], params: Params = DEFAULTS) -> DataFrame:
    """Adds for the cut before each word: n (words before it), kind, penalty, cut_ms. The cut before the first word is the audio's start."""
    w = Window.partitionBy("project").orderBy(*order)
    prev, prev_end = F.lag("word").over(w), F.lag("end_ms").over(w)
    out = words.withColumn("n", F.row_number().over(w) - 1).withColumn("prev", prev).withColumn("prev_end", prev_end)
    gap = (F.col("start_ms") - F.col("prev_end")) / 1000.0
    kind = (
        F.when(F.col("prev").isNull() | F.col("prev").rlike(SENTENCE_END), "sentence")
        .when(F.col("prev").rlike(CLAUSE_END), "clause")
        .when(gap >= params.silence_gap_s, "silence")
        .otherwise("word")
    )
    cut = F.when(F.col("prev").isNull(), F.col("start_ms").cast("double")).when(F.col("start_ms") < F.col("prev_end"), F.col("prev_end").cast("double")).otherwise((F.col("prev_end") + F.col("start_ms")) / 2.0)
    return out.withColumn("kind", kind).withColumn("penalty", penalty_of(F.col("kind"), gap, params)).withColumn("cut_ms", cut).drop("prev", "prev_end")


def penalty_of(kind: Column, gap: Column, params: Params = DEFAULTS) -> Column:
    p = params.penalties
    eased = p["word"] - F.least(F.lit(params.silence_gap_s), F.greatest(F.lit(0.0), gap))
    return F.when(kind == "sentence", p["sentence"]).when(kind == "clause", p["clause"]).when(kind == "silence", p["silence"]).otherwise(eased)


def segment_summary(segments: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Per project: count, least, greatest and mean duration, and the segments outside the bounds."""
    d = F.col("duration")
    return segments.groupBy("project").agg(F.count("*").alias("n"), F.min(d).alias("shortest"), F.max(d).alias("longest"), F.round(F.avg(d), 6).alias("mean"), F.count_if((d < params.min_s) | (d > params.max_s)).alias("outside"))


def timeline(segments: DataFrame) -> DataFrame:
    """The timeline's columns, numbers zero-padded to the project's widest."""
    width = T.pad_width(F.max("index").over(Window.partitionBy("project")))
    return segments.select("project", F.lpad(F.col("index").cast("string"), width, F.lit("0")).alias("segment"), T.timecode(F.col("start")).alias("from"), T.timecode(F.col("end")).alias("to"), F.format_string("%.3f", F.col("duration")).alias("seconds"), F.size(T.words(F.col("narration"))).alias("words"), "narration")


def srt(cues: DataFrame) -> DataFrame:
    """project, pos, start, end, text -> numbered cues; blank texts are skipped, a cue without length lasts half a second."""
    kept = cues.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    number = F.row_number().over(Window.partitionBy("project").orderBy("pos"))
    end = F.when(F.col("end") <= F.col("start"), F.col("start") + 0.5).otherwise(F.col("end"))
    return kept.select("project", number.alias("number"), F.concat(T.srt_stamp(F.col("start")), F.lit(" --> "), T.srt_stamp(end)).alias("stamps"), F.trim("text").alias("text"))

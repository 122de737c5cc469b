"""Delivery: which picks become files, what changes on disk, and where each file came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import DEFAULTS, Params


def confidence_band(confidence: Column, params: Params = DEFAULTS) -> Column:
    return F.when(confidence >= params.high, "high").when(confidence >= params.medium, "medium").otherwise("low")


def plan_selected(segments: DataFrame, picks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """segments (project, index, confidence, label) and picks -> project, index, position, kind, path, confidence, band, name.

    A pick is delivered if it is used, and chosen by a person or sure enough; a confidence of 0 falls back to the segment's. Clips come first.
    """
    joined = picks.where("use").join(segments.select("project", "index", F.col("confidence").alias("of_segment"), "label"), ["project", "index"])
    sure = F.coalesce(F.nullif("confidence", F.lit(0.0)), "of_segment", F.lit(0.0))
    kept = joined.withColumn("confidence", sure).where(F.col("user_set") | (F.col("confidence") >= params.medium))
    order = Window.partitionBy("project", "index").orderBy(F.when(F.col("kind") == "clip", 0).otherwise(1), "rank", "path")
    widest = segments.groupBy("project").agg(T.pad_width(F.max("index")).alias("width"))
    out = kept.withColumn("position", F.row_number().over(order)).join(widest, "project")
    slug = F.coalesce(F.nullif("slug", F.lit("")), T.slugify("label")) if "slug" in picks.columns else T.slugify("label")
    name = F.concat(F.lpad(F.col("index").cast("string"), F.col("width"), F.lit("0")), F.lit("_"), F.col("position").cast("string"), F.lit("_"), slug, F.lit("."), F.lower(F.substring_index("path", ".", -1)))
    return out.select("project", "index", "position", "kind", "path", "confidence", confidence_band(F.col("confidence"), params).alias("band"), name.alias("name"))


def gaps(segments: DataFrame, planned: DataFrame) -> DataFrame:
    """Segments that nothing is delivered for."""
    return segments.join(planned.select("project", "index"), ["project", "index"], "left_anti")


def snapshot_diff(wanted: DataFrame, on_disk: DataFrame, ours: DataFrame) -> DataFrame:
    """wanted (project, name, bytes; null where the source is missing), on_disk (project, name, bytes), ours (project, name) -> an action a name.

    written, unchanged (on disk with the same size), missing_source, removed (not wanted any more, ours), foreign (not ours: left alone).
    """
    w = wanted.select("project", "name", F.col("bytes").alias("w_bytes"), F.lit(True).alias("w"))
    d = on_disk.select("project", "name", F.col("bytes").alias("d_bytes"), F.lit(True).alias("d"))
    o = ours.select("project", "name").distinct().withColumn("o", F.lit(True))
    both = w.join(d, ["project", "name"], "full").join(o, ["project", "name"], "left")
    action = (
        F.when(F.col("w").isNotNull() & F.col("w_bytes").isNull(), "missing_source").when(F.col("w").isNotNull() & (F.col("w_bytes") == F.col("d_bytes")), "unchanged")
        .when(F.col("w").isNotNull(), "written").when(F.col("o").isNotNull(), "removed").otherwise("foreign")
    )
    return both.select("project", "name", action.alias("action"))


def all_candidates(segments: DataFrame, ranked: DataFrame, planned: DataFrame) -> DataFrame:
    """Every ranked record of every segment as a file name that sorts by segment and rank; those delivered are marked."""
    chosen = planned.where("kind = 'image'").select("project", F.lower("path").alias("low")).distinct().withColumn("selected", F.lit(True))
    widest = segments.groupBy("project").agg(T.pad_width(F.max("index")).alias("width"))
    rank_width = T.pad_width(F.max("rank").over(Window.partitionBy("project", "index")), 2)
    rows = ranked.where("rank >= 1").withColumn("rank_width", rank_width).withColumn("low", F.lower("path")).join(chosen, ["project", "low"], "left")
    rows = rows.join(segments.select("project", "index", "start", F.col("label").alias("topic")), ["project", "index"]).join(widest, "project")
    stem = F.concat_ws("_", F.lpad(F.col("index").cast("string"), F.col("width"), F.lit("0")), T.folder_stamp(F.col("start")), F.lpad(F.col("rank").cast("string"), F.col("rank_width"), F.lit("0")), T.slugify(F.coalesce(F.nullif("query", F.lit("")), "topic")))
    hit = F.coalesce("selected", F.lit(False))
    name = F.concat(stem, F.when(hit, "_SELECTED").otherwise(""), F.lit("."), F.lower(F.substring_index("path", ".", -1)))
    return rows.select("project", "index", "rank", "path", name.alias("name"), hit.alias("selected"))


def rename_diff(wanted: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Names that differ in the mark alone are renamed rather than written and removed: project, name, old, action."""
    key = F.regexp_replace("name", "_SELECTED(?=\\.[^.]*$)", "")
    w = wanted.select("project", key.alias("key"), "name")
    d = on_disk.select("project", key.alias("key"), F.col("name").alias("old"))
    action = F.when(F.col("old").isNull(), "written").when(F.col("name").isNull(), "removed").when(F.col("name") == F.col("old"), "unchanged").otherwise("renamed")
    return w.join(d, ["project", "key"], "full").select("project", "name", "old", action.alias("action"))


def credits(planned: DataFrame, images: DataFrame, videos: DataFrame) -> DataFrame:
    """One row for each delivered file: where it came from, by base name among a segment's images (of several the last) or its clips.

    What is not known is left empty, a license "unknown"; a clip's is never known.
    """
    base = lambda c: F.substring_index(c, "/", -1)
    blank = lambda c: F.coalesce(c, F.lit(""))
    last = images.withColumn("base", base("path")).groupBy("project", "index", "base").agg(F.max_by(F.struct("image_url", "source_page", "creator", "license", "license_url", "query"), "ord").alias("i"))
    clip = videos.withColumn("base", base("clip_path")).groupBy("project", "index", "base").agg(F.max_by(F.struct("url", "channel", "start", "query"), "ord").alias("v"))
    rows = planned.withColumn("base", base("path")).join(last, ["project", "index", "base"], "left").join(clip, ["project", "index", "base"], "left")
    is_clip = F.col("kind") == "clip"
    return rows.select(
        "project", "name", "index", "kind", "band",
        blank(F.when(is_clip, F.col("v.url")).otherwise(F.col("i.image_url"))).alias("source_url"),
        blank(F.when(is_clip, F.substring_index("v.url", "&t=", 1)).otherwise(F.col("i.source_page"))).alias("source_page"),
        blank(F.when(is_clip, F.col("v.channel")).otherwise(F.col("i.creator"))).alias("creator"),
        blank(F.when(is_clip, T.timecode(F.col("v.start")))).alias("timestamp"),
        F.when(is_clip, F.lit("unknown")).otherwise(F.coalesce(F.nullif("i.license", F.lit("")), F.lit("unknown"))).alias("license"),
        blank(F.when(is_clip, F.lit("")).otherwise(F.col("i.license_url"))).alias("license_url"),
        blank(F.when(is_clip, F.col("v.query")).otherwise(F.col("i.query"))).alias("query"),
    )


def credits_match(planned: DataFrame, credited: DataFrame) -> DataFrame:
    """One row: files, credit rows, and whether they are as many."""
    counts = planned.select(F.lit(1).alias("f"), F.lit(0).alias("c")).union(credited.select(F.lit(0), F.lit(1)))
    return counts.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("files"), F.coalesce(F.sum("c"), F.lit(0)).alias("credits")).withColumn("match", F.col("files") == F.col("credits"))


def gap_reason(notes: Column) -> Column:
    """The last note that speaks of a clip, or of having none."""
    return F.try_element_at(F.filter(notes, lambda n: F.contains(F.lower(n), F.lit("clip")) | F.contains(F.lower(n), F.lit("no "))), F.lit(-1))


def shotlist(segments: DataFrame, planned: DataFrame) -> DataFrame:
    """A line for each segment: its files in order, or why it has none."""
    files = planned.groupBy("project", "index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]), ", ").alias("files"))
    rows = segments.join(files, ["project", "index"], "left")
    stamp = F.concat(T.timecode(F.col("start")), F.lit("-"), T.timecode(F.col("end")))
    return rows.select("project", "index", F.concat(F.lit("| "), stamp, F.lit(" | "), cell(F.col("label")), F.lit(" | "), F.coalesce("files", F.concat(F.lit("gap: "), F.coalesce(gap_reason(F.col("notes")), F.lit("nothing confident")))), F.lit(" |")).alias("line"))


def cell(text: Column, most: int = 80) -> Column:
    """A text for a table cell: bars escaped, lines joined, cut with an ellipsis."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"\|", r"\\|")
    return F.when(F.length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most - 1)), F.lit("…"))).otherwise(one)


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(seconds < 60, F.format_string("%.1f s", seconds)).when(s < 3600, F.format_string("%d m %02d s", F.floor(s / 60).cast("long"), s % 60)).otherwise(F.format_string("%d h %02d m", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")))


def stage_share(timings: DataFrame) -> DataFrame:
    """stage, seconds -> with its share of the project's run in percent."""
    total = F.sum("seconds").over(Window.partitionBy("project"))
    return timings.withColumn("share", F.round(F.when(total > 0, 100 * F.col("seconds") / total).otherwise(0.0), 1))


def model_calls(segments: DataFrame, batch: int = DEFAULTS.batch_size) -> DataFrame:
    """How many calls a model gets for a project: one, and one for each batch of segments."""
    return segments.groupBy("project").agg((1 + F.ceil(F.count("*") / batch)).cast("long").alias("calls"))


def project_page(segments: DataFrame, picks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Each segment with its best used confidence, band and number of picks."""
    best = picks.groupBy("project", "index").agg(F.max(F.when(F.col("use"), F.col("confidence"))).alias("best"), F.count("*").alias("picks"))
    out = segments.join(best, ["project", "index"], "left").withColumn("best", F.coalesce("best", F.lit(0.0))).withColumn("picks", F.coalesce("picks", F.lit(0)))
    return out.withColumn("band", confidence_band(F.col("best"), params))


def image_grid(records: DataFrame, picks: DataFrame, most: int = 24) -> DataFrame:
    """A segment's pictures for review: by rank (unranked ones last), then score; so many, with what was picked of them."""
    order = Window.partitionBy("project", "index").orderBy(F.coalesce(F.nullif("rank", F.lit(0)), F.lit(999)), F.desc("score"), "path")
    shown = records.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return shown.join(picks.select("project", "index", "path", "use", "rejected"), ["project", "index", "path"], "left")


def apply_actions(picks: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions (project, index, path, use, rejected, favorite; nulls leave as is) upserted into picks; a rejected pick is not used."""
    keys = ["project", "index", "path"]
    p, a = picks.alias("p"), actions.alias("a")
    joined = p.join(a, keys, "full")
    rejected = F.coalesce("a.rejected", "p.rejected", F.lit(False))
    use = F.when(rejected, False).otherwise(F.coalesce("a.use", "p.use", F.lit(False)))
    touched = F.col("a.use").isNotNull() | F.col("a.rejected").isNotNull()
    return joined.select(*keys, F.coalesce("p.kind", F.lit("image")).alias("kind"), F.coalesce("p.rank", F.lit(0)).alias("rank"), F.coalesce("p.confidence", F.lit(0.0)).alias("confidence"), use.alias("use"), (F.coalesce("p.user_set", F.lit(False)) | touched).alias("user_set"), F.coalesce("a.favorite", "p.favorite", F.lit(False)).alias("favorite"), rejected.alias("rejected"))


def directory_bytes(files: DataFrame) -> DataFrame:
    """files of the binaryFile source (content is not read) -> directory, bytes, files."""
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def project_report(segments: DataFrame, planned: DataFrame, batch: int = DEFAULTS.batch_size) -> DataFrame:
    """One row a project: segments, how many are degraded or gaps, files by kind and band, and a model's calls."""
    delivered = planned.groupBy("project").agg(
        F.count("*").alias("files"), F.count_if(F.col("kind") == "clip").alias("clips"), F.count_if(F.col("band") == "high").alias("high"), F.count_if(F.col("band") == "medium").alias("flagged"), F.count_distinct("index").alias("covered")
    )
    own = segments.groupBy("project").agg(F.count("*").alias("segments"), F.count_if(F.col("status") != "ok").alias("degraded"), (1 + F.ceil(F.count("*") / batch)).cast("long").alias("calls"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "clips", "high", "flagged")]
    return own.join(delivered, "project", "left").select("project", "segments", "degraded", *counts, (F.col("segments") - F.coalesce("covered", F.lit(0))).alias("gaps"), "calls")


def segment_names(segments: DataFrame) -> DataFrame:
    """Folder name of each segment: padded number and the stamps of its start and end; sorts in order of time."""
    width = T.pad_width(F.max("index").over(Window.partitionBy("project")))
    return segments.select("project", "index", F.concat(F.lpad(F.col("index").cast("string"), width, F.lit("0")), F.lit("_"), T.folder_stamp(F.col("start")), F.lit("-"), T.folder_stamp(F.col("end"))).alias("name"))

"""Gathering candidates from providers, and deciding which downloads are accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import DEFAULTS, Params


def fan_out(queries: DataFrame, providers: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """queries (project, index, query_index, query) x providers (provider, provider_ord) -> calls with their budget.

    A call asks for max(4, ceil(1.6 candidates / (queries x providers))) results; a provider with a cap gets the first queries only. Every
    provider counts; Spark broadcasts them if their table is under its threshold.
    """
    n_queries = F.count("*").over(Window.partitionBy("project", "index", "provider"))
    listed = providers.withColumn("n_providers", F.count("*").over(Window.partitionBy(F.lit(0))))
    caps = F.create_map(*[x for k, v in params.provider_caps.items() for x in (F.lit(k), F.lit(v))])
    calls = queries.crossJoin(listed).withColumn("queries", n_queries)
    budget = F.greatest(F.lit(4), F.ceil(F.lit(params.candidates * 1.6) / (F.col("queries") * F.col("n_providers"))))
    return calls.where(F.col("query_index") < F.coalesce(F.try_element_at(caps, F.col("provider")), F.lit(2**31 - 1))).withColumn("per_call", budget.cast("int")).drop("queries", "n_providers")


def first_of_url(candidates: DataFrame) -> DataFrame:
    """One candidate for each url without its query part, in a segment: the first by query, provider and hit."""
    keyed = candidates.withColumn("key", T.dedupe_key(F.col("url")))
    order = Window.partitionBy("project", "index", "key").orderBy("query_index", "provider_ord", "hit")
    return keyed.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def interleave(candidates: DataFrame) -> DataFrame:
    """Adds place: the first hit of every query, then the second of every query, and so on."""
    own = Window.partitionBy("project", "index", "query_index").orderBy("provider_ord", "hit")
    turn = candidates.withColumn("turn", F.row_number().over(own))
    return turn.withColumn("place", F.row_number().over(Window.partitionBy("project", "index").orderBy("turn", "query_index"))).drop("turn")


def with_failures(segments: DataFrame, failures: DataFrame) -> DataFrame:
    """Segments with status degraded and a note for each provider that failed; the others as they are."""
    notes = failures.groupBy("project", "index").agg(F.array_sort(F.collect_set(F.concat("provider", F.lit(" failed: "), "error"))).alias("failed"))
    joined = segments.join(notes, ["project", "index"], "left")
    return joined.withColumn("status", F.when(F.col("failed").isNotNull(), "degraded").otherwise(F.col("status"))).withColumn("notes", F.concat("notes", F.coalesce("failed", F.array().cast("array<string>")))).drop("failed")


def _magic(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "PNG").when(F.startswith(head, F.lit("FFD8FF")), "JPEG").when(F.startswith(head, F.lit("47494638")), "GIF")
        .when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "WEBP").when(F.startswith(head, F.lit("424D")), "BMP")
        .when(head.rlike("^(49492A00|4D4D002A)"), "TIFF")
    )


def dimensions(content: Column) -> Column:
    """(width, height) that a PNG or GIF header states; null for others, whose decoding is left to a provider's table."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    kind = _magic(content)
    return F.when(kind == "PNG", F.struct(number(17, 4).alias("width"), number(21, 4).alias("height"))).when(kind == "GIF", F.struct((number(8, 1) * 256 + number(7, 1)).alias("width"), (number(10, 1) * 256 + number(9, 1)).alias("height")))


def rejection(content: Column, width: Column, params: Params = DEFAULTS) -> Column:
    """Why a download is refused, the first rule that holds; null if it is accepted. width is that of the decoded picture, null if undecodable."""
    head = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    more = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    svg = F.startswith(head, F.lit("<svg")) | (F.startswith(head, F.lit("<?xml")) & F.contains(more, F.lit("<svg")))
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "empty")
        .when(F.octet_length(content) > params.max_bytes, "too_large")
        .when(svg, "svg")
        .when(_magic(content).isNull() | width.isNull(), "undecodable")
        .when(~_magic(content).isin("PNG", "JPEG", "WEBP", "GIF", "BMP", "TIFF"), "bad_content_type")
        .when(width < params.min_width, "too_small")
    )


def prefetch_rejection(url: Column, robots: Column, error: Column, content_type: Column, path: Column, again: Column) -> Column:
    """Why a candidate is refused before its bytes are looked at: a url seen before, an SVG by name, robots, transport, type, path."""
    return (
        F.when(again, "duplicate_url").when(F.endswith(F.lower(F.substring_index(url, "?", 1)), F.lit(".svg")), "svg").when(~F.coalesce(robots, F.lit(True)), "robots").when(error.isNotNull(), "transport")
        .when(content_type.isNotNull() & ~F.startswith(F.lower(content_type), F.lit("image/")), "bad_content_type").when(path.rlike(r"(^|/)\.\.(/|$)|^/"), "path_escape")
    )


def take_accepted(candidates: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The candidates tried (with `ok`) until `limit` of a key's have been accepted; refusals do not count."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return candidates.withColumn("accepted", F.coalesce(F.sum(F.col("ok").cast("int")).over(before), F.lit(0))).where(F.col("accepted") < limit).drop("accepted")


def reasons(rejected: DataFrame) -> DataFrame:
    return rejected.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))

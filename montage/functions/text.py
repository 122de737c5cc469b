"""Scalar functions on strings, times, hashes and vectors, as column expressions; Arrow functions only where Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, split at ASCII white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def strip_punctuation(word: Column, marks: str = ".,;:!?\"'()[]") -> Column:
    return F.btrim(word, F.lit(marks))


def normalize_name(name: Column) -> Column:
    """Stripped, in lower case, white space as single blanks."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


@F.pandas_udf(StringType())
def slugify(text: pd.Series) -> pd.Series:
    """ASCII letters and digits joined by _, at most 40 characters, cut at a word where one ends past the half; `untitled` without any."""

    def one(value: str | None) -> str:
        plain = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode().lower()
        slug = "_".join(x for x in "".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())
        if len(slug) <= 40:
            return slug or "untitled"
        cut = slug[:40]
        at = cut.rfind("_")
        return (cut[:at] if at >= 20 else cut).strip("_") or cut

    return text.map(one)


def pad_width(largest: Column, least: int = 3) -> Column:
    return F.greatest(F.lit(least), F.length(largest.cast("string")))


def folder_stamp(seconds: Column) -> Column:
    """MMmSSs, truncated; minutes do not wrap."""
    s = seconds.cast("long")
    return F.when(s.isNotNull(), F.format_string("%02dm%02ds", F.floor(s / 60).cast("long"), (s % 60).cast("long")))


def timecode(seconds: Column) -> Column:
    """H:MM:SS from an hour on, else M:SS, truncated."""
    s = seconds.cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)).when(s.isNotNull(), F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60))


def srt_stamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm, rounded half-even to milliseconds."""
    ms = F.bround(seconds * 1000).cast("long")
    part = lambda d, m: (F.floor(ms / d) % m).cast("long")
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), ms % 1000))


def parse_timecode(text: Column) -> Column:
    """Seconds of [H:]M:SS, folded to base 60."""
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda acc, x: acc * 60 + x.cast("long")).cast("double")


def domain(page: Column, url: Column) -> Column:
    """Authority of the page, else of the url, in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.nullif(page, F.lit("")), url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def dedupe_key(url: Column) -> Column:
    return F.lower(F.substring_index(url, "?", 1))


def url_with_t(url: Column, seconds: Column) -> Column:
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("t="), seconds.cast("int").cast("string"), F.lit("s"))


def cache_key(provider: Column, endpoint: Column, params: Column) -> Column:
    """SHA-256 of provider, endpoint and canonical JSON, with zero characters between."""
    return F.sha2(F.concat_ws("\x00", provider, endpoint, params), 256)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; 999 where one is missing, not hex, or of another length."""
    fits = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$") & (F.length(a) == F.length(b))
    bits = lambda x: F.conv(x, 16, -10).cast("long")
    return F.when(fits, F.bit_count(bits(a).bitwiseXOR(bits(b)))).otherwise(999)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, between 0 and 1; 0 where one is empty or lengths differ. A fold in order, so that sums agree everywhere."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))).otherwise(0.0)


def strip_tags(html: Column) -> Column:
    """Tags out, the common entities as characters, white space as single blanks."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def sanitize_filename(name: Column) -> Column:
    """A file name without separators, control and reserved characters, or dots and blanks at its ends; `file` if nothing is left."""
    out = F.btrim(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r'[\x00-\x1f<>:"|?*]', "_"), F.lit(". "))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("file"))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of over two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0)), lambda w: F.length(w) > 2))


def sentences(text: Column) -> Column:
    """The text cut after . ! or ? where white space follows."""
    return F.split(text, r"(?<=[.!?])\s+")

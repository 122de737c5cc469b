"""A corpus pipeline over documents: quality rules, near duplicates, repeated substrings, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet before the next one reads it.
All stages but the last return the columns of documents.

What holds for all stages: columns are found by exact name, so that a table may have others with clashing ones; a null text counts as an
empty one; an empty table gives an empty result; long texts are whole; rows that tie or repeat are told in each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from montage.llm import minhash_join, mixing, packing, quality, substring_dedup
from montage.llm.common import WORD, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep, as they are; null and empty texts go, repeated rows are judged each."""
    return quality.quality_rules(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that with the least doc_id (the first row where ids repeat); texts without words stay."""
    return minhash_join.one_of_each_class(docs, COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated substrings out; a document of which nothing is left goes, so equal texts of 200 bytes go all; short, null and empty texts stay."""
    kept = substring_dedup.remove_repeats(docs, carry=COLUMNS)
    out = kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", "n_chars", "n_removed").where("n_removed = 0 or text <> ''")
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def _words(first: str, count: str) -> Column:
    """The text's words from the first on, so many, with the white space between them."""
    runs = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    return F.rtrim(F.array_join(F.slice(runs, F.col(first).cast("int") + 1, F.col(count).cast("int")), ""))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: whole copies, then the words of its part; documents without words are not taken."""
    mixed = mixing.mix_sources(docs, carry=COLUMNS)
    whole = F.transform(F.sequence(F.lit(1), F.col("copies")), lambda i: F.col("text"))
    copies = F.when(F.col("copies") > 0, whole).otherwise(F.array().cast("array<string>"))
    head = F.when(F.col("head_words") > 0, F.array(_words("head_start", "head_words"))).otherwise(F.array().cast("array<string>"))
    tail = F.when(F.col("tail_words") > 0, F.array(_words("tail_start", "tail_words"))).otherwise(F.array().cast("array<string>"))
    part = lambda a, k: F.transform(a, lambda t: F.struct(t.alias("text"), F.lit(k).alias("part")))
    rows = mixed.select("doc_id", "lang", "source", "n_chars", F.explode(F.concat(part(copies, False), part(head, True), part(tail, True))).alias("x"))
    return rows.select("doc_id", F.col("x.text").alias("text"), "lang", "source", F.when(F.col("x.part"), F.length("x.text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; copies are packed each, a null text as its end id."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the estimates, the suffix order and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

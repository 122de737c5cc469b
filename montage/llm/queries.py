"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import license_index, media_tiff, minhash_join, mixing, packing, quality, substring_dedup, toxicity, url_templates, warc_zip
from .common import table


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_tiff.tiff_media(table(spark, sf_dir, "documents"))


def op2_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.warc_round_trip(table(spark, sf_dir, "pages"))


def op4_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_minhash_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages"))


def op8_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan_licenses(table(spark, sf_dir, "documents"))


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_toxic_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.tag_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_tiff_media, op2_minimum_bin_slack, op3_warc_zip, op4_induced_sorting, op5_sainte_lague, op6_minhash_banding, op7_path_templates, op8_rare_token_index, op9_robust_outliers, op10_toxic_field)
}
ORACLE_SQL: dict[str, str] = {"op5_sainte_lague": mixing.MIX_SQL, "op7_path_templates": url_templates.judge_sql(), "op8_rare_token_index": license_index.scan_sql()}

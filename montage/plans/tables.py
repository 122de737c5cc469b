"""Reading the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of long texts, whose work lies in the rows and not in their number.
TEXTS = ("documents", "pages", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; texts that come in fewer splits than there are cores are dealt out first. Large tables have more and stay as they are."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and table._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return table.repartition(cores)
    return table

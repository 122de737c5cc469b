"""Files in and out: transcripts, packs, listings, tables, cues and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "project string, language string, duration double, segments array<struct<id:int,start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double,probability:double>>>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts as JSON documents, by a fixed schema."""
    return spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path)


def read_entities(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document an entity; a malformed one gives a row of nulls, which is left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).na.drop("all")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, bytes, modified of a folder's files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def relative_paths(table: DataFrame, column: str, root: str) -> DataFrame:
    """Paths under the root as relative ones."""
    return table.withColumn(column, F.regexp_replace(column, F.concat(F.lit("^(file:)?\\Q"), F.lit(root.rstrip("/")), F.lit("/\\E")), F.lit("")))


def write_stage(table: DataFrame, path: str, partition_by: tuple[str, ...] = ("project",)) -> None:
    """A stage's table; only the partitions that it holds are replaced."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    """A final report for people: one file with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """The column `line` in order, as one text file for each project."""
    lines.repartition("project").sortWithinPartitions("project", *order).select("project", "line").write.mode("overwrite").partitionBy("project").text(path)


def srt_lines(cues: DataFrame) -> DataFrame:
    return cues.select("project", "number", F.concat_ws("\n", F.col("number").cast("string"), "stamps", "text", F.lit("")).alias("line"))


def table_to_json(table: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return table.select(F.to_json(F.struct("*")).alias("value"))

"""Helpers that all corpus operators share: column picking, shared tables, word patterns."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name; other columns, even clashing ones, are ignored.

    A name that is missing becomes a null string column, so that a table without an optional column still works.
    """
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])
    columns = list(df.columns)
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"c{columns.index(n)}").alias(n) if n in columns else F.lit(None).cast("string").alias(n) for n in names])


#: Bytes of an Arrow batch: what a task holds of its input does not depend on how long texts are, but for a single one.
BATCH_BYTES, BATCH_SETTING = "4MB", "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow over batches of at most BATCH_BYTES, unless the session sets a bound of its own. The setting stays in the session, as
    the rows may be asked for at any later time."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def text_of(column: str = "text") -> Column:
    """The text, a null being the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="montage-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where that is unset (tests in one process), one of this process."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or _own_folder()}/corpus-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a Parquet table in the shared folder and read back: lineage ends there, and a lost executor loses nothing.

    The folder is named by the application and can be removed when the application has ended (see remove_tables).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.montage_path = path
    return out


def remove(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote and that nothing reads any more."""
    path = getattr(df, "montage_path", None)
    if path:
        _delete(df.sparkSession, path)


def remove_tables(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators wrote; results that still read them become unusable."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards_for(rows: int, per_shard: int) -> int:
    return max(1, -(-rows // per_shard))

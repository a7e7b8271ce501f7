"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.session import ensure_checkpoint_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder named by `spark.checkpoint.dir`, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{tag}"


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs the tasks that ran on it, not the jobs before. Rows keep
    what non-deterministic columns (row ids) got when they were written."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by `shared_table` that no later step reads."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """A-Z only; letters outside ASCII stay as they are."""
    return F.translate(c, UPPER, LOWER)


def count_words(c: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for `rows` rows of `per_task` rows each, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))

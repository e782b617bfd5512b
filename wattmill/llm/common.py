"""Helpers shared by the corpus operators: shared folders, checked broadcasts and global positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20  # of an Arrow batch


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from `spark.checkpoint.dir`; local sessions without one get a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; Spark removes the files once nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding what a Python worker is sent at once: whole texts in default batches fill its memory."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int((conf.get(key, None) or "0").rstrip("b"))  # sizes read back with their unit
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df


def fits(df: DataFrame, most: int) -> bool:
    """True when df has at most `most` rows; looks at no more than that."""
    return df.limit(most + 1).count() <= most


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_bucket(df: DataFrame, column: str, parts: int, narrow: DataFrame | None = None) -> DataFrame:
    """df with `bucket` from 0 to parts - 1: ranges of a numeric column with about equal counts, nulls in the first.

    The cuts are quantiles of the column alone, so finding them reads one narrow column (`narrow`: the same column of
    what df is made from, where df is dear) and not the whole rows twice.
    """
    at = [i / parts for i in range(1, parts)]
    cuts = (df if narrow is None else narrow).agg(
        F.percentile_approx(column, at, 100 * parts).alias("cuts")).first().cuts if at else None
    if not cuts:
        return df.withColumn("bucket", F.lit(0))
    known = F.array(*[F.lit(c) for c in cuts])
    above = F.size(F.filter(known, lambda c: c < F.col(column)))
    return df.withColumn("bucket", F.when(F.col(column).isNull(), 0).otherwise(above))


def dealt_by_range(df: DataFrame, column: str, parts: int, narrow: DataFrame | None = None) -> DataFrame:
    """range_bucket, with each bucket as one partition."""
    return range_bucket(df, column, parts, narrow).repartitionById(parts, F.col("bucket"))

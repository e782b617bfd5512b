"""Tables that grow by numbered runs: a run's files count once its row stands in the manifest, and a run replayed after
that changes nothing.

Below a folder each table has a directory per run (`version=`), written whole and overwritten if the run is repeated. The
manifest has one small file per run with the parts the run wrote; it is written last, by a single task, so it is there or
not. Of each part the newest version in the manifest is read. Files of runs that never ended are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class VersionedTables:
    """Tables below `folder`, cut into parts by the columns `parts` (name and type), which every table has."""

    def __init__(self, spark: SparkSession, folder: str, parts: dict[str, str]):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self.schema = ", ".join(f"`{name}` {kind}" for name, kind in parts.items())
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.folder}/manifest/version=-1")

    def manifest(self) -> DataFrame:
        """(parts, version) of all runs that ended; as many rows as runs wrote parts."""
        return self.spark.read.schema(f"{self.schema}, version long").parquet(f"{self.folder}/manifest")

    def last_run(self) -> int:
        last = self.manifest().agg(F.max("version")).first()[0]
        return -1 if last is None else last

    def write(self, df: DataFrame, table: str, run: int) -> DataFrame:
        """The run's rows of a table, written and read again; not seen by others before `commit`."""
        path = f"{self.folder}/{table}/version={run}"
        df.write.mode("overwrite").partitionBy(*self.parts).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, table: str, run: int) -> None:
        """Make the run's parts, as a table of it has them, the current ones."""
        parts = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{table}/version={run}")
        parts.select(*self.parts).distinct().coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/manifest/version={run}")

    def current(self, table: str, schema: StructType, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The newest version of each part, of runs before `before`, of the parts in `only`; other files are pruned."""
        runs = self.manifest() if before is None else self.manifest().filter(F.col("version") < before)
        if runs.isEmpty():
            return self.spark.createDataFrame([], schema)
        newest = runs.groupBy(*self.parts).agg(F.max("version").alias("version"))
        if only is not None:
            newest = newest.join(only.select(*self.parts).distinct(), list(self.parts), "left_semi")
        whole = StructType([*schema.fields, StructField("version", LongType())])
        rows = self.spark.read.schema(whole).parquet(f"{self.folder}/{table}")
        return rows.join(newest, [*self.parts, "version"], "left_semi").select(*schema.names)

    def written(self, table: str, schema: StructType, run: int) -> DataFrame:
        """What one run wrote of a table."""
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/version={run}")

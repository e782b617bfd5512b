"""A lasting ledger of upload contents: each content is taken once, in whichever run it comes first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattmill.sources.meter_files import first_uploads
from wattmill.sources.versions import VersionedTables

PREFIX = 2  # hexadecimal digits of a hash that name its part of the ledger: 256 parts


def take_new(files: DataFrame, folder: str, run: int) -> DataFrame:
    """(content_hash, file_id, arrival, copies) of the contents of files(file_id, arrival, content) that no earlier run took.

    Only the parts of the ledger whose prefixes occur are read. Runs are numbered upwards by the caller; a run that is
    repeated, after it ended or before, gives the same rows and leaves the same ledger.
    """
    spark: SparkSession = files.sparkSession
    tables = VersionedTables(spark, folder, {"prefix": "string", "taken_in": "long"})
    firsts = first_uploads(files).withColumns({
        "prefix": F.substring("content_hash", 1, PREFIX), "taken_in": F.lit(run).cast("long")})
    if run <= tables.last_run():
        return tables.written("hashes", firsts.schema, run).drop("prefix", "taken_in")
    # Parts are never written again, so each is its own newest version.
    known = tables.current("hashes", firsts.schema, before=run).select("prefix", "content_hash")
    new = tables.write(firsts.join(known, ["prefix", "content_hash"], "left_anti").select(*firsts.columns), "hashes", run)
    tables.commit("hashes", run)
    return new.drop("prefix", "taken_in")

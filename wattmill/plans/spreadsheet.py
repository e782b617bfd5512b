"""Spreadsheets to clean, profiled readings in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattmill.operators import cleaning, mapping, quality
from wattmill.operators.readings import with_gated_features

SERIES = ("file_id", "mprn")


@dataclass(frozen=True)
class ParsedSheets:
    readings: DataFrame
    report: DataFrame
    issues: DataFrame
    mapping: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give back what was kept for the branches; call it once the results are written."""
        for table in self.kept:
            table.unpersist()


def parse_sheets(
    rows: DataFrame,
    headers: DataFrame,
    edited_mapping: DataFrame | None = None,
    overrides: DataFrame | None = None,
) -> ParsedSheets:
    """Detect or take the mapping, clean, check and add features; all results are lazy DataFrames.

    `edited_mapping` has the `*_col` names per file and replaces detection. The mapping and the clean rows are kept
    (in memory and on disk, rebuilt where an executor is lost), as all branches read them, until `release`.
    """
    if edited_mapping is None:
        chosen = mapping.build_mapping(mapping.detect_columns(rows, headers))
    else:
        chosen = mapping.locate_columns(edited_mapping, headers)
    # One small row per file, used by every branch below.
    validated = mapping.validate_mapping(chosen, headers).persist()
    parsed = cleaning.parse_rows(cleaning.rename_columns(rows, validated))
    deduped = cleaning.drop_duplicates(parsed).persist()
    counts = cleaning.row_counts(parsed, deduped)
    # Files with a bad mapping have raw rows but no parsed ones.
    rejected = (
        rows.join(validated.filter(F.size("errors") > 0).select("file_id"), "file_id", "left_semi")
        .groupBy("file_id")
        .agg(F.count("*").alias("rows_raw"), F.lit(0).cast("bigint").alias("rows_clean"))
    )
    totals = counts.select("file_id", "rows_raw", "rows_clean").unionByName(rejected)

    clean = deduped.drop("copies")
    if overrides is not None:
        clean = cleaning.override_mprn(clean, overrides)
    checks = quality.series_checks(clean, SERIES)
    issues = (
        mapping.mapping_issues(validated)
        .unionByName(cleaning.cleaning_issues(counts))
        .withColumn("mprn", F.lit(None).cast("string"))
        .unionByName(quality.series_issues(checks, SERIES))
    )
    coded = clean.join(checks.select(*SERIES, "granularity"), list(SERIES))
    return ParsedSheets(
        readings=with_gated_features(coded),
        report=quality.quality_report(totals, checks, issues),
        issues=issues,
        mapping=validated,
        kept=(validated, deduped),
    )

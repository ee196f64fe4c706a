"""The entry function: read exports, compute the report, write it when asked."""

from __future__ import annotations

from pyspark.sql import SparkSession

from usagelens.plans.report import UsageReport, compute_report, write_report
from usagelens.sources.lines import MalformedInput
from usagelens.sources.readers import file_groups, lines_left_out, read_groups, read_sources
from usagelens.storage import written

VERSION = "0.1.0"


def analyze(
    spark: SparkSession,
    path: str | list[str],
    fmt: str | None = None,
    out: str | None = None,
    strict: bool = False,
    by_file: bool = False,
    **options,
) -> UsageReport:
    """Report of all exports under ``path``; with ``out`` it is also written there.

    There is one report a format, or one a file with ``by_file``; files without rows are reported too.

    The normalized rows are stored once, without text, and every metric reads that table. Lines that
    could not be read are listed in the report's ``malformed`` table; with ``strict`` they raise.
    """
    groups = file_groups(spark, [path] if isinstance(path, str) else list(path), fmt)
    left_out = written(lines_left_out(spark, groups), "malformed")
    if strict and not left_out.isEmpty():
        row = left_out.orderBy("source_file", "line_no").first()
        raise MalformedInput(f"{row.reason} on line {row.line_no} of '{row.source_file}'")
    usage = written(read_groups(spark, groups, **options), "usage")
    report = compute_report(usage, left_out, read_sources(spark, groups), by_file)
    if out is not None:
        write_report(report, out, VERSION)
    return report

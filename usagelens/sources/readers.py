"""Reading exports: detect each file's format, route it to its reader, union the rows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.coerce import UNDECODABLE
from usagelens.schema import USAGE_SCHEMA
from usagelens.sources import normalize as N
from usagelens.sources.csv_records import read_cells
from usagelens.sources.detect import detect_formats, first_lines
from usagelens.sources.lines import literal_paths, malformed_lines, parse_entries, parse_objects, read_lines, require_clean


class UnknownFormat(ValueError):
    """A file, or a forced format name, that no reader knows."""


def read_litellm(spark: SparkSession, paths: list[str], multiline: bool = True, **options):
    """Request log lines; ``multiline`` has no meaning here, a line is a record."""
    return N.normalize_litellm(parse_objects(read_lines(spark, paths)), **options)


def read_csv(spark: SparkSession, paths: list[str], multiline: bool = True, header: str | None = None) -> DataFrame:
    """CSV cells as text. Files must share one ``header``, which is looked up if it is not given.

    Large files are read in splits. ``multiline`` accepts line feeds in quoted cells, for which the text is
    scanned twice; turn it off for files known to hold none.
    """
    if multiline:
        return read_cells(spark, paths, first_lines(spark, paths[:1]).first()["head"] if header is None else header)
    rows = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(literal_paths(paths))
    )
    # The CSV reader decodes to text and marks what is no UTF-8; the marks are dropped.
    cells = [(c, F.col(f"`{c.replace('`', '``')}`")) for c in rows.columns]
    clean = [F.replace(cell, F.lit(UNDECODABLE), F.lit("")).alias(c) for c, cell in cells]
    return rows.select(*clean, F.col("_metadata.file_path").alias("source_file"))


def read_helicone(spark: SparkSession, paths: list[str], multiline: bool = True, header: str | None = None, **options):
    return N.normalize_helicone(read_csv(spark, paths, multiline, header), **options)


def read_helicone_log(spark: SparkSession, paths: list[str], multiline: bool = True, **options):
    return N.normalize_helicone_log(parse_entries(read_lines(spark, paths)), **options)


def read_openai(spark: SparkSession, paths: list[str], multiline: bool = True, header: str | None = None, **_options):
    return N.normalize_openai(read_csv(spark, paths, multiline, header))


def read_anthropic(spark: SparkSession, paths: list[str], multiline: bool = True, header: str | None = None, **_options):
    return N.normalize_anthropic(read_csv(spark, paths, multiline, header))


CSV_READERS: dict[str, Callable[..., DataFrame]] = {
    "helicone": read_helicone,
    "openai_csv": read_openai,
    "anthropic_csv": read_anthropic,
}
READERS = ("litellm_jsonl", *CSV_READERS)


def supported_formats() -> list[str]:
    return list(READERS)


class WrongFormat(ValueError):
    """A file whose content cannot be of the format it is read as."""


# Readers of files whose lines are JSON objects; the others read CSV.
LINE_READERS: dict[str, Callable[..., DataFrame]] = {
    "litellm_jsonl": read_litellm,
    "helicone": read_helicone_log,
}


def file_groups(spark: SparkSession, paths: list[str], fmt: str | None) -> dict[tuple[str, bool, str], list[str]]:
    """Files by (format, whether lines are JSON, CSV header). Files without content are left out."""
    names = ", ".join(supported_formats())
    if fmt is not None and fmt not in READERS:
        raise UnknownFormat(f"Unknown format '{fmt}'. Supported formats: {names}.")
    # One row per file; CSV files that share format and header are read together.
    is_csv = ~F.startswith(F.col("head"), F.lit("{"))
    found = detect_formats(spark, paths).select(
        "path", "format", F.when(is_csv, F.col("head")).alias("header"), is_csv.alias("is_csv")
    )
    groups: dict[tuple[str, bool, str], list[str]] = defaultdict(list)
    for row in found.collect():
        if row.is_csv is None:  # a file of blanks
            continue
        kind = fmt or row.format
        if kind is None:
            raise UnknownFormat(
                f"Could not detect the format of '{row.path}'. Supported formats: {names}."
            )
        readers = CSV_READERS if row.is_csv else LINE_READERS
        if kind not in readers:
            raise WrongFormat(f"'{row.path}' holds {'CSV' if row.is_csv else 'JSON lines'} and is no '{kind}' export.")
        groups[(kind, not row.is_csv, row.header or "")].append(row.path)
    if not groups and fmt is None:
        raise UnknownFormat(f"No file with content under {paths}. Supported formats: {names}.")
    return groups


def read_groups(spark: SparkSession, groups: dict, **options) -> DataFrame:
    frames = [
        LINE_READERS[kind](spark, sorted(files), **options) if lines
        else CSV_READERS[kind](spark, sorted(files), header=header, **options)
        for (kind, lines, header), files in sorted(groups.items())
    ]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], USAGE_SCHEMA)


def read_sources(spark: SparkSession, groups: dict) -> DataFrame:
    """(source_format, source_file) of all files read, named as their rows name them."""
    files = [(kind, file) for (kind, _, _), own in sorted(groups.items()) for file in sorted(own)]
    listed = spark.createDataFrame(files, "source_format string, path string")
    # Rows carry the path in URL form.
    paths = sorted(f for _, f in files)
    names = spark.read.format("binaryFile").load(literal_paths(paths)) if files else None
    if names is None:
        return listed.withColumnRenamed("path", "source_file")
    names = names.select("path", F.col("_metadata.file_path").alias("source_file"))
    return listed.join(names, "path").select("source_format", "source_file")


def lines_left_out(spark: SparkSession, groups: dict) -> DataFrame:
    """(source_format, source_file, line_no, reason): lines of JSON files that no row was made of."""
    frames = [
        malformed_lines(spark, sorted(files)).select(F.lit(kind).alias("source_format"), "source_file", "line_no", "reason")
        for (kind, lines, _), files in sorted(groups.items())
        if lines
    ]
    if frames:
        return reduce(DataFrame.unionByName, frames)
    return spark.createDataFrame([], "source_format string, source_file string, line_no bigint, reason string")


def read_usage(
    spark: SparkSession,
    path: str | list[str],
    fmt: str | None = None,
    strict: bool = False,
    **options,
) -> DataFrame:
    """Normalized usage rows of all files under ``path``.

    ``fmt`` sets the format of all files; one whose content cannot be of it raises. With ``strict`` a
    malformed JSON line raises; otherwise it is left out here and listed by ``lines_left_out``.
    """
    groups = file_groups(spark, [path] if isinstance(path, str) else list(path), fmt)
    line_files = sorted(f for (_, lines, _), files in groups.items() if lines for f in files)
    if strict and line_files:
        require_clean(spark, line_files)
    return read_groups(spark, groups, **options)

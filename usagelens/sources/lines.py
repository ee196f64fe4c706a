"""JSON-lines input: splittable text scan, parsed once to VARIANT."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.functions.coerce import drop_undecodable, strip


class MalformedInput(ValueError):
    """A recognized file has a line that cannot be read."""


def literal_paths(paths: list[str]) -> list[str]:
    """Paths of files as patterns that match only themselves."""
    return [re.sub(r"([\\\\{}\[\]*?])", r"\\\1", p) for p in paths]


def keep_last_key(spark: SparkSession) -> None:
    """Read an object that repeats a key, with the last value counting, as a setting of the session."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


# Characters of one string that the plain JSON parser takes, and bytes that a VARIANT holds.
STRING_LIMIT = 20_000_000
VARIANT_BYTES = 128 << 20
LONG_STRINGS = {"maxStringLen": str((1 << 31) - 1), "allowNonNumericNumbers": "false"}


def parse_json(line: Column) -> Column:
    """VARIANT of a JSON text, null if it is none. Texts with longer strings take a parser with a raised limit."""
    long = F.when(F.length(line) > STRING_LIMIT, F.from_json(line, "variant", LONG_STRINGS))
    return F.coalesce(F.try_parse_json(line), long)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every line as ``line``, with the file it comes from."""
    return read_text(spark.read.text(literal_paths(paths)).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file")
    ))


def read_text(lines: DataFrame) -> DataFrame:
    """Raw lines without broken bytes and white space around them."""
    keep_last_key(lines.sparkSession)
    return lines.withColumn("line", strip(drop_undecodable(F.col("line"))))


def parse_objects(lines: DataFrame) -> DataFrame:
    """VARIANT column ``v`` for every line that is a JSON object; other lines are left out."""
    parsed = F.when(F.startswith("line", F.lit("{")), parse_json(F.col("line")))
    # Exploding an optional value drops the nulls and parses once; a filter on the parsed
    # column would be pushed below it and parse a second time.
    found = F.filter(F.array(parsed), lambda v: v.isNotNull())
    others = [c for c in lines.columns if c != "line"]
    return lines.select(*others, F.explode(found).alias("v"))


def parse_entries(lines: DataFrame) -> DataFrame:
    """``entries`` of every line that is a JSON object: its top-level keys in lower case, in the line's order, with VARIANT values."""
    line = F.col("line")
    entries = F.transform(
        F.map_entries(F.from_json(line, "map<string,variant>", LONG_STRINGS)),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    parsed = F.when(F.startswith("line", F.lit("{")) & parse_json(line).isNotNull(), entries)
    found = F.filter(F.array(parsed), lambda v: v.isNotNull())
    others = [c for c in lines.columns if c != "line"]
    return lines.select(*others, F.explode(found).alias("entries"))


def fault(line: Column) -> Column:
    """Why a line cannot be read, without its text; null for a good or blank line."""
    return (
        F.when(line == "", F.lit(None).cast("string"))
        .when(
            parse_json(line).isNull(),
            F.when(F.octet_length(line) > VARIANT_BYTES, F.lit("longer than 128 MB")).otherwise(F.lit("malformed JSON")),
        )
        .when(~F.startswith(line, F.lit("{")), F.lit("expected a JSON object"))
    )


def malformed_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Bad lines as (source_file, line_no, reason); line numbers count blank lines.

    Rows of one input split keep their order, so a line's number is its place in the split
    plus the rows of the splits before it. Only per-split counts are ordered per file.
    """
    split = ["source_file", "split_start"]
    keep_last_key(spark)
    rows = spark.read.text(literal_paths(paths)).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
        fault(strip(drop_undecodable(F.col("value")))).alias("reason"),
    )
    earlier = Window.partitionBy("source_file").orderBy("split_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Counting lines needs no parsing; the reason column is pruned from this scan.
    splits = (
        rows.groupBy(*split)
        .agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_id"))
        .withColumn("rows_before", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)))
        .drop("n_rows")
    )
    return (
        rows.where("reason is not null")
        .join(splits, split)
        .select(
            "source_file",
            (F.col("rows_before") + F.col("row_id") - F.col("first_id") + 1).alias("line_no"),
            "reason",
        )
    )


def require_clean(spark: SparkSession, paths: list[str]) -> None:
    """Raise for the first bad line, naming file and line but not its text."""
    bad = malformed_lines(spark, paths).orderBy("source_file", "line_no").take(1)
    if bad:
        row = bad[0]
        raise MalformedInput(f"{row.reason} on line {row.line_no} of '{row.source_file}'")

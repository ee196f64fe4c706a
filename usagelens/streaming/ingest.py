"""The same projections and roll-ups on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelens.functions.coerce import drop_undecodable, strip
from usagelens.functions.tiers import UNKNOWN, model_name
from usagelens.sources.lines import parse_objects
from usagelens.sources.normalize import normalize_litellm


def stream_request_log(spark: SparkSession, path: str, **options) -> DataFrame:
    """Normalized rows of a request log directory that grows; text ends in the scan stage."""
    lines = spark.readStream.text(path).select(
        strip(drop_undecodable(F.col("value"))).alias("line")
    )
    return normalize_litellm(parse_objects(lines), **options)


def append_usage(usage: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append a normalized stream to a Parquet table, taking what is there now."""
    return (
        usage.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _spend_sums() -> list:
    return [
        F.sum("n_requests").alias("n_requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    ]


def spend_windows(usage: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Running spend per model and wall-clock day; a day closes when the watermark passes it.

    The wall clock is placed on the UTC time line for the watermark only, so the session's time zone
    has no part in it. Rows without a time have no day to close: ``undated_spend`` counts them.
    """
    since = F.expr("timestamp - timestamp_ntz'1970-01-01 00:00:00'")
    seconds = sum(F.extract(F.lit(p), since) * n for p, n in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60)))
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("window.start")) / 86400).cast("int"))
    return (
        usage.where("timestamp is not null")
        .withColumn("at", F.timestamp_seconds(seconds + F.extract(F.lit("SECOND"), since)))
        .withWatermark("at", lateness)
        .groupBy("source_format", model_name(F.col("model")).alias("model"), F.window("at", "1 day"))
        .agg(*_spend_sums())
        .withColumn("day", F.date_format(day, "yyyy-MM-dd"))
        .drop("window")
    )


def undated_spend(usage: DataFrame) -> DataFrame:
    """Running spend per model of rows without a time; for sinks that take updates."""
    rows = usage.where("timestamp is null")
    spend = rows.groupBy("source_format", model_name(F.col("model")).alias("model")).agg(*_spend_sums())
    return spend.withColumn("day", F.lit(UNKNOWN))

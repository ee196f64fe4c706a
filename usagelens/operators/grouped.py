"""Grouped metrics, each a small roll-up of the usage cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.tiers import UNKNOWN, price_tier
from usagelens.operators.cube import COUNT, exact_sum, total_cost
from usagelens.schema import REQUEST_FORMATS

# Decimal places of shares and rates, and of the total cost.
RATE_PLACES = 4
COST_PLACES = 6


def rate(part: Column, whole: Column) -> Column:
    """Rounded share, 0 when there is nothing to share."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), whole.cast("double")), RATE_PLACES), F.lit(0.0))


BY_FILE = "by_file"  # marks a column of sources that names a format and a file, with a colon between


def is_request_log(df: DataFrame) -> Column:
    """Whether a source of ``df`` holds one row a request."""
    name = F.col("source_format")
    if df.schema["source_format"].metadata.get(BY_FILE):
        name = F.substring_index(name, ":", 1)
    return name.isin(*REQUEST_FORMATS)


def per_request(df: DataFrame) -> DataFrame:
    return df.where(is_request_log(df))


def totals(cube: DataFrame) -> DataFrame:
    return cube.groupBy("source_format").agg(
        exact_sum("n_requests").alias("requests"),
        exact_sum("input_tokens").alias("input_tokens"),
        exact_sum("output_tokens").alias("output_tokens"),
        F.bround(total_cost(), COST_PLACES).alias("cost_usd"),
    )


FLAGS = ("has_rows", "has_prompt_text", "has_cost", "has_tokens", "has_timestamp", "has_input_tokens")


def with_all_sources(metric: DataFrame, sources: DataFrame, **otherwise: Column) -> DataFrame:
    """``metric`` with a row for each of ``sources`` (source_format), also those without rows."""
    every = metric.join(sources, "source_format", "full")
    return every.withColumns({c: F.coalesce(c, v) for c, v in otherwise.items()})


def capabilities_of(cube: DataFrame, sources: DataFrame) -> DataFrame:
    """``capabilities`` of all ``sources``; one without rows can tell nothing but its kind."""
    none = {c: F.lit(False) for c in FLAGS}
    flags = capabilities(cube).withColumn("has_rows", F.lit(True))
    return with_all_sources(flags, sources, per_request=is_request_log(cube), **none)


def capabilities(cube: DataFrame) -> DataFrame:
    """What each source can tell: six flags per format."""
    return cube.groupBy("source_format").agg(
        F.max(is_request_log(cube)).alias("per_request"),
        F.max(is_request_log(cube) & F.col("has_prompt")).alias("has_prompt_text"),
        F.max(F.col("cost").isNotNull()).alias("has_cost"),
        F.max((F.col("input_records") > 0) | (F.col("output_records") > 0)).alias("has_tokens"),
        F.max(F.col("day") != UNKNOWN).alias("has_timestamp"),
        F.max(F.col("input_records") > 0).alias("has_input_tokens"),
    )


def spend_by_model_day(cube: DataFrame) -> DataFrame:
    return (
        cube.groupBy("source_format", "model", "day")
        .agg(
            exact_sum("n_requests").alias("n_requests"),
            exact_sum("input_tokens").alias("input_tokens"),
            exact_sum("output_tokens").alias("output_tokens"),
            total_cost().alias("cost_usd"),
        )
        .orderBy("source_format", "day", "model")
    )


def model_mix(cube: DataFrame) -> DataFrame:
    """Requests and input tokens by price tier; names are classified once per cube row."""
    formats = Window.partitionBy("source_format")
    return (
        cube.groupBy("source_format", "model")
        .agg(exact_sum("n_requests").alias("n_requests"), exact_sum("input_tokens").alias("input_tokens"))
        .withColumn("tier", price_tier(F.col("model")))
        .groupBy("source_format", "tier")
        .agg(
            F.count("*").alias("n_models"),
            exact_sum("n_requests").alias("n_requests"),
            exact_sum("input_tokens").alias("input_tokens"),
        )
        .withColumn("total_requests", F.sum("n_requests").over(formats).cast(COUNT))
        .withColumn("share_of_requests", rate(F.col("n_requests"), F.col("total_requests")))
        .orderBy("source_format", "tier")
    )


def tier_models(cube: DataFrame) -> DataFrame:
    """The models of each tier, one row per model name."""
    return (
        cube.groupBy("source_format", "model")
        .agg(exact_sum("n_requests").alias("n_requests"))
        .select("source_format", price_tier(F.col("model")).alias("tier"), "model", "n_requests")
        .orderBy("source_format", "tier", "model")
    )


def error_rate(cube: DataFrame) -> DataFrame:
    return (
        per_request(cube)
        .groupBy("source_format")
        .agg(
            exact_sum("n_requests").alias("total_requests"),
            exact_sum("error_requests").alias("error_requests"),
        )
        .withColumn("error_rate", rate(F.col("error_requests"), F.col("total_requests")))
    )


def requests_by_day(cube: DataFrame) -> DataFrame:
    return (
        cube.where(F.col("day") != UNKNOWN)
        .groupBy("source_format", "day")
        .agg(exact_sum("n_requests").alias("n_requests"), total_cost().alias("cost_usd"))
        .orderBy("source_format", "day")
    )


def requests_by_hour(cube: DataFrame) -> DataFrame:
    return (
        per_request(cube)
        .where(F.col("hour").isNotNull())
        .groupBy("source_format", "hour")
        .agg(exact_sum("n_requests").alias("n_requests"))
        .orderBy("source_format", "hour")
    )

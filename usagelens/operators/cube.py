"""The usage cube: one pass over the usage table that the grouped metrics share.

Grouping by model, day and hour shrinks any volume of requests to a table whose size follows
the number of models and hours. Every sum is pre-aggregated before the shuffle, so one model
or source holding most rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.tiers import UNKNOWN, model_name

# Totals are decimal, so none overflows and none depends on the order of rows. Costs are added with
# twelve places.
COUNT = "decimal(38,0)"
COST = "decimal(38,12)"
LOW_BITS, MIDDLE_BITS = 20, 22


def exact_sum(column: str) -> Column:
    return F.sum(F.col(column).cast(COUNT)).cast(COUNT)


def exact_long_sum(column: str) -> Column:
    """``exact_sum`` of a BIGINT column, without a decimal a row.

    A number is cut into parts of 20, 22 and 22 bits. Sums of parts are BIGINT and hold trillions of
    rows; the total is put together from them once a group.
    """
    x = F.col(column).cast("bigint")
    part = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    low, middle = part(x, LOW_BITS), part(F.shiftright(x, LOW_BITS), MIDDLE_BITS)
    high = F.shiftright(x, LOW_BITS + MIDDLE_BITS)  # keeps the sign
    whole = lambda c, bits: F.sum(c).cast(COUNT) * F.lit(1 << bits).cast("decimal(13,0)")
    return (whole(high, LOW_BITS + MIDDLE_BITS) + whole(middle, LOW_BITS) + F.sum(low).cast(COUNT)).cast(COUNT)


def total_cost() -> Column:
    """Cost of a group of cube rows; null when none of them has a cost."""
    return F.sum("cost").cast("double")


def usage_cube(usage: DataFrame) -> DataFrame:
    return (
        usage.select(
            "source_format",
            model_name(F.col("model")).alias("model"),
            F.to_date("timestamp").alias("date"),
            F.hour("timestamp").alias("hour"),
            "n_requests",
            "input_tokens",
            "output_tokens",
            "cost_usd",
            F.when(F.col("is_error"), F.col("n_requests")).otherwise(0).alias("error_requests"),
            F.col("prompt_hash").isNotNull().alias("has_prompt"),
        )
        .groupBy("source_format", "model", "date", "hour")
        .agg(
            F.count("*").alias("records"),
            exact_long_sum("n_requests").alias("n_requests"),
            exact_long_sum("error_requests").alias("error_requests"),
            F.coalesce(exact_long_sum("input_tokens"), F.lit(0).cast(COUNT)).alias("input_tokens"),
            F.coalesce(exact_long_sum("output_tokens"), F.lit(0).cast(COUNT)).alias("output_tokens"),
            F.sum(F.col("cost_usd").try_cast(COST)).cast(COST).alias("cost"),
            F.count("input_tokens").alias("input_records"),
            F.count("output_tokens").alias("output_records"),
            F.bool_or("has_prompt").alias("has_prompt"),
        )
        .withColumn("day", F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit(UNKNOWN)))
        .drop("date")
    )

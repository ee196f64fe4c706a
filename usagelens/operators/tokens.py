"""Token distributions from a value histogram.

The histogram (how many records have this token count) is the only pass over the records.
Ranks come from running counts in two levels: over at most 1024 buckets per power of two, and
over the distinct values inside one bucket, so no task orders all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.operators.cube import COUNT
from usagelens.operators.grouped import per_request, rate

# The long-context limit and the share of requests counted as the top.
LONG_CONTEXT_TOKENS = 32_000
TOP_SHARE_DIVISOR = 100
MEAN_PLACES = 1

_BUCKET_BITS = 10


def token_values(usage: DataFrame) -> DataFrame:
    """(source_format, kind, tokens, records): how often each token count occurs."""
    kinds = F.array(
        F.struct(F.lit("input").alias("kind"), F.col("input_tokens").alias("tokens")),
        F.struct(F.lit("output").alias("kind"), F.col("output_tokens").alias("tokens")),
    )
    return (
        per_request(usage.select("source_format", "input_tokens", "output_tokens"))
        .select("source_format", F.inline(kinds))
        .where("tokens is not null")
        .groupBy("source_format", "kind", "tokens")
        .agg(F.count("*").alias("records"))
    )


def _bucket(tokens: Column) -> Column:
    """Monotone bucket number: 1024 equal steps for every power of two."""
    size = F.abs(tokens)
    drop = F.greatest(F.length(F.bin(size)) - (_BUCKET_BITS + 1), F.lit(0))
    step = F.call_function("shiftright", size, drop.cast("int"))
    return F.signum(tokens).cast("bigint") * (drop * (1 << _BUCKET_BITS) + step)


def ranked_values(values: DataFrame) -> DataFrame:
    """Adds ``at_most`` (records with this count or less) and ``n`` (all records)."""
    group = ["source_format", "kind"]
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inside = Window.partitionBy(*group, "bucket").orderBy("tokens").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    values = values.withColumn("bucket", _bucket(F.col("tokens")))
    buckets = (
        values.groupBy(*group, "bucket")
        .agg(F.sum("records").alias("in_bucket"))
        .withColumn("below", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
        .withColumn("n", F.sum("in_bucket").over(Window.partitionBy(*group)))
        .drop("in_bucket")
    )
    return (
        values.withColumn("seen", F.sum("records").over(inside))
        .join(buckets, [*group, "bucket"])
        .withColumn("at_most", F.col("below") + F.col("seen"))
        .select(*group, "tokens", "records", "at_most", "n")
    )


def nearest_rank(percent: int) -> Column:
    """Smallest value whose rank reaches ceil(percent / 100 * n)."""
    rank = F.greatest(F.ceil(F.lit(percent / 100) * F.col("n")), F.lit(1))
    return F.min(F.when(F.col("at_most") >= rank, F.col("tokens")))


def _exact_total(times: Column) -> Column:
    """Sum of tokens, each so many times, without overflow."""
    product = F.col("tokens").cast("decimal(19,0)") * times.cast("decimal(18,0)")
    return F.sum(product).cast(COUNT)


def token_histograms(ranked: DataFrame) -> DataFrame:
    """Count, range, percentiles and mean of input and output tokens; zeros for an empty kind."""
    all_tokens = _exact_total(F.col("records"))
    stats = ranked.groupBy("source_format", "kind").agg(
        F.sum("records").alias("count"),
        F.min("tokens").alias("min"),
        nearest_rank(50).alias("p50"),
        nearest_rank(90).alias("p90"),
        nearest_rank(99).alias("p99"),
        F.max("tokens").alias("max"),
        F.bround(
            all_tokens.cast("double") / F.sum("records"), MEAN_PLACES
        ).alias("mean"),
    )
    # A format with tokens of one kind only still shows the other, as zeros.
    both = stats.groupBy("source_format").agg(
        *[
            F.first(F.when(F.col("kind") == k, F.struct(*stats.columns[2:])), ignorenulls=True)
            .alias(k)
            for k in ("input", "output")
        ]
    )
    rows = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(k).alias("s")) for k in ("input", "output")]
    )
    return (
        both.select("source_format", F.inline(rows))
        .select(
            "source_format",
            "kind",
            *[F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c) for c in stats.columns[2:]],
        )
        .orderBy("source_format", "kind")
    )


def long_context_tail(ranked: DataFrame) -> DataFrame:
    """Upper input percentiles, records over the limit, and the share of the largest 1 %."""
    top = F.greatest(F.floor(F.col("n") / TOP_SHARE_DIVISOR), F.lit(1))
    larger = F.col("n") - F.col("at_most")
    taken = F.least(F.col("records"), F.greatest(top - larger, F.lit(0)))
    return (
        ranked.where("kind = 'input'")
        .groupBy("source_format")
        .agg(
            nearest_rank(95).alias("p95_input_tokens"),
            nearest_rank(99).alias("p99_input_tokens"),
            F.max("tokens").alias("max_input_tokens"),
            F.sum(
                F.when(F.col("tokens") > LONG_CONTEXT_TOKENS, F.col("records")).otherwise(0)
            ).alias("requests_over_32k_input"),
            _exact_total(taken).alias("top_1pct_input_tokens"),
            _exact_total(F.col("records")).alias("all_input_tokens"),
        )
        .withColumn(
            "share_of_input_tokens_in_top_1pct_requests",
            rate(F.col("top_1pct_input_tokens"), F.nullif("all_input_tokens", F.lit(0))),
        )
    )

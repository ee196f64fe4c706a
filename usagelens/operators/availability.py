"""Which metrics each source format can give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metric names in report order, and the reason given for a missing one.
METRICS = (
    "spend_by_model_day",
    "token_histograms",
    "duplicate_prompts",
    "model_mix",
    "error_rate",
    "temporal_patterns",
    "long_context_tail",
)
REASON = "unavailable from this export format"

# The capability each metric needs, over the columns of ``capabilities``.
NEEDS = {
    "spend_by_model_day": "has_tokens or has_cost",
    "token_histograms": "per_request and has_tokens",
    "duplicate_prompts": "has_prompt_text",
    "model_mix": "has_rows",
    "error_rate": "per_request",
    "temporal_patterns": "has_timestamp",
    "long_context_tail": "per_request and has_tokens and has_input_tokens",
}


def availability(capabilities: DataFrame) -> DataFrame:
    """(source_format, metric, status, reason), seven rows per format."""
    if "has_rows" not in capabilities.columns:  # flags of rows that are there
        capabilities = capabilities.withColumn("has_rows", F.lit(True))
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.expr(NEEDS[m]).alias("ok")) for m in METRICS]
    )
    return (
        capabilities.select("source_format", F.inline(rows))
        .select(
            "source_format",
            "metric",
            F.when(F.col("ok"), "computed").otherwise("unavailable").alias("status"),
            F.when(~F.col("ok"), REASON).alias("reason"),
        )
        .orderBy("source_format", "metric")
    )

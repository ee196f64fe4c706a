"""The normalized usage table: one row shape for every source format."""

from __future__ import annotations

from pyspark.sql import types as T

# Format names and whether a row stands for one request.
REQUEST_FORMATS = ("litellm_jsonl", "helicone")
BILLING_FORMATS = ("openai_csv", "anthropic_csv")

# The normalized columns.
USAGE_SCHEMA = T.StructType(
    [
        T.StructField("source_format", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("model", T.StringType()),
        T.StructField("route", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("is_error", T.BooleanType(), False),
        T.StructField("status", T.StringType()),
        T.StructField("n_requests", T.LongType(), False),
        T.StructField("prompt_hash", T.StringType()),
        T.StructField("prompt_sketch", T.ArrayType(T.LongType(), False)),
        T.StructField("source_file", T.StringType()),
    ]
)

USAGE_COLUMNS = tuple(USAGE_SCHEMA.fieldNames())

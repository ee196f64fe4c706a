"""Which export format a file's first non-blank line belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelens.functions.coerce import strip

# Keys that mark a request log line.
LOG_KEYS = ("call_type", "usage", "response_cost", "litellm_call_id", "messages")


def header_cells(line: Column) -> Column:
    """Lower-case header names; empty for a JSON line. Quoted cells may hold commas."""
    cells = F.regexp_extract_all(line, F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1))
    clean = F.transform(cells, lambda c: F.lower(strip(F.btrim(strip(c), F.lit('"')))))
    return F.when(F.ltrim(line).startswith("{"), F.array().cast("array<string>")).otherwise(clean)


def format_of_line(line: Column) -> Column:
    """Format name by the first matching rule; null when no rule matches."""
    cols = header_cells(line)

    def has(name: str) -> Column:
        return F.array_contains(cols, name)

    keys = F.json_object_keys(line)
    lower = F.transform(keys, F.lower)
    return (
        F.when(F.arrays_overlap(keys, F.array(*map(F.lit, LOG_KEYS))), F.lit("litellm_jsonl"))
        .when(
            has("request_id") & (has("request_body") | has("prompt_tokens")), F.lit("helicone")
        )
        .when(
            F.array_contains(lower, "request_id")
            & (F.array_contains(lower, "request_body") | F.array_contains(lower, "prompt_tokens")),
            F.lit("helicone"),
        )
        .when(
            F.exists(cols, lambda c: F.contains(c, F.lit("n_context_tokens")))
            | (has("n_requests") & has("n_generated_tokens_total")),
            F.lit("openai_csv"),
        )
        .when(
            has("usage_date_utc") | (has("input_tokens") & has("output_tokens")),
            F.lit("anthropic_csv"),
        )
    )

"""Raw rows of each export format to the normalized usage table.

Each function is one narrow projection. ``normalize`` is the only place that builds the
normalized row, and the prompt text ends there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions import chat, coerce
from usagelens.functions.prompts import DEFAULT_SALT, redact, shingle_hash
from usagelens.schema import USAGE_SCHEMA

# Column names of each field, in order of preference.
HELICONE_COLUMNS = {
    "timestamp": ["created_at", "created", "request_created_at", "timestamp"],
    "model": ["model"],
    "route": ["path", "route"],
    "input_tokens": ["prompt_tokens", "input_tokens"],
    "output_tokens": ["completion_tokens", "output_tokens"],
    "cost_usd": ["cost", "cost_usd", "total_cost"],
    "status": ["status", "response_status", "status_code"],
    "body": ["request_body", "body"],
    "prompt": ["prompt"],
}
OPENAI_COLUMNS = {
    "timestamp": ["timestamp", "date", "start_time"],
    "model": ["model"],
    "route": ["operation"],
    "input_tokens": [
        "n_context_tokens_total",
        "n_context_tokens",
        "context_tokens",
        "input_tokens",
    ],
    "output_tokens": [
        "n_generated_tokens_total",
        "n_generated_tokens",
        "generated_tokens",
        "output_tokens",
    ],
    "cost_usd": ["cost", "cost_usd", "amount", "amount_in_usd"],
    "n_requests": ["num_requests", "n_requests", "num_model_requests", "requests"],
}
ANTHROPIC_COLUMNS = {
    "timestamp": ["usage_date_utc", "date", "usage_date", "timestamp"],
    "model": ["model_version", "model"],
    "route": ["workspace"],
    "input_tokens": ["input_tokens", "uncached_input_tokens", "input"],
    "output_tokens": ["usage_output_tokens", "output_tokens", "output"],
    "cost_usd": ["cost_usd", "cost", "amount_usd", "amount"],
    "n_requests": ["requests", "n_requests"],
}
CACHE_INPUT_COLUMNS = [
    "usage_input_tokens_no_cache",
    "usage_input_tokens_cache_write_5m",
    "usage_input_tokens_cache_write_1h",
    "usage_input_tokens_cache_read",
]


def columns_by_alias(df: DataFrame) -> dict[str, Column]:
    """Columns of ``df`` under their lower-case, stripped names."""
    return {name.strip().lower(): F.col(f"`{name.replace('`', '``')}`") for name in df.columns}


def source_file(df: DataFrame) -> Column:
    return F.col("source_file") if "source_file" in df.columns else F.lit(None)


def pick(cells: dict[str, Column], aliases: list[str]) -> Column:
    """First filled cell among the aliases the header has; null when it has none."""
    found = [cells[a] for a in aliases if a in cells]
    return coerce.first_filled(found)


# Fields whose text is stripped before it is read as a number or a time.
STRIPPED = ("timestamp", "input_tokens", "output_tokens", "cost_usd", "n_requests")


def picked(df: DataFrame, columns: dict[str, list[str]], *more: Column) -> DataFrame:
    """One text column per field, in a projection of its own so each cell is picked once."""
    cells = columns_by_alias(df)
    fields = {name: pick(cells, aliases) for name, aliases in columns.items()}
    return df.select(
        *[(coerce.strip(c) if f in STRIPPED else c).alias(f) for f, c in fields.items()],
        *more,
        source_file(df).alias("source_file"),
    )


def normalize(
    df: DataFrame, source_format: str, fields: dict[str, Column],
    prompt: Column | None = None, salt: str = DEFAULT_SALT, hasher=shingle_hash,
) -> DataFrame:
    """Project ``fields`` to the normalized columns and reduce the prompt to hash and sketch."""
    values = {
        "source_format": F.lit(source_format),
        "is_error": F.lit(False),
        "n_requests": F.lit(1),
        **fields,
    }
    names = [f for f in USAGE_SCHEMA if f.name not in ("prompt_hash", "prompt_sketch")]
    row = df.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in names],
        *([prompt.alias("_text")] if prompt is not None else []),
    )
    if prompt is None:
        row = row.withColumns(
            {
                "prompt_hash": F.lit(None).cast("string"),
                "prompt_sketch": F.lit(None).cast("array<bigint>"),
            }
        )
    else:
        row = redact(row, F.col("_text"), salt, hasher)
    return row.select(*USAGE_SCHEMA.fieldNames())


def prompt_of_body(body: Column, prompt: Column) -> Column:
    """Chat text of a JSON request body, else the plain prompt. A bad body counts as none."""
    return F.coalesce(chat.message_text(F.try_parse_json(body)), prompt)


def normalize_helicone(df: DataFrame, **options) -> DataFrame:
    return normalize(
        picked(df, HELICONE_COLUMNS),
        "helicone",
        {
            "timestamp": coerce.timestamp_of(F.col("timestamp")),
            "model": F.col("model"),
            "route": F.col("route"),
            "input_tokens": coerce.long_of(F.col("input_tokens")),
            "output_tokens": coerce.long_of(F.col("output_tokens")),
            "cost_usd": coerce.double_of(F.col("cost_usd")),
            "is_error": coerce.failed_over_http(F.col("status")),
            "status": F.col("status"),
            "source_file": F.col("source_file"),
        },
        prompt=prompt_of_body(F.col("body"), F.col("prompt")),
        **options,
    )


def _billing_fields() -> dict[str, Column]:
    return {
        "timestamp": coerce.timestamp_of(F.col("timestamp")),
        "model": F.col("model"),
        "route": F.col("route"),
        "input_tokens": coerce.long_of(F.col("input_tokens")),
        "output_tokens": coerce.long_of(F.col("output_tokens")),
        "cost_usd": coerce.double_of(F.col("cost_usd")),
        "n_requests": coerce.at_least_one(coerce.long_of(F.col("n_requests"))),
        "source_file": F.col("source_file"),
    }


def normalize_openai(df: DataFrame, **_options) -> DataFrame:
    return normalize(picked(df, OPENAI_COLUMNS), "openai_csv", _billing_fields())


def cache_split_input(parts: list[Column], otherwise: Column) -> Column:
    """Sum of the cache columns, nulls as 0, when any is filled; else the plain column."""
    if not parts:
        return otherwise
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    return F.when(F.coalesce(*parts).isNotNull(), total).otherwise(otherwise)


def normalize_anthropic(df: DataFrame, **_options) -> DataFrame:
    cells = columns_by_alias(df)
    split = [c for c in CACHE_INPUT_COLUMNS if c in cells]
    rows = picked(df, ANTHROPIC_COLUMNS, *[coerce.strip(cells[c]).alias(f"_{c}") for c in split])
    fields = _billing_fields()
    parts = [coerce.long_of(F.col(f"_{c}")) for c in split]
    fields["input_tokens"] = cache_split_input(parts, fields["input_tokens"])
    return normalize(rows, "anthropic_csv", fields)


def normalize_litellm(df: DataFrame, **options) -> DataFrame:
    """Request log objects: ``df`` has the VARIANT column ``v``."""
    v = F.col("v")

    def text(*paths: str) -> Column:
        return coerce.strip(F.coalesce(*[chat.as_text(v, p) for p in paths]))

    when = chat.first_truthy(v, "$.startTime", "$.timestamp", "$.start_time")
    rows = df.select(
        coerce.strip(when).alias("timestamp"),
        chat.as_text(v, "$.model").alias("model"),
        chat.first_truthy(v, "$.call_type", "$.endpoint").alias("route"),
        text("$.usage.prompt_tokens", "$.prompt_tokens").alias("input_tokens"),
        text("$.usage.completion_tokens", "$.completion_tokens").alias("output_tokens"),
        text("$.response_cost", "$.cost").alias("cost_usd"),
        chat.as_text(v, "$.status").alias("status"),
        chat.is_truthy(v, "$.exception").alias("has_exception"),
        chat.message_text(v).alias("chat"),
        # A prompt that is no string hides ``input``.
        F.when(chat.is_truthy(v, "$.prompt"), chat.string_only(v, "$.prompt"))
        .otherwise(chat.string_only(v, "$.input"))
        .alias("prompt"),
        source_file(df).alias("source_file"),
    )
    return normalize(
        rows,
        "litellm_jsonl",
        {
            "timestamp": coerce.timestamp_of(F.col("timestamp")),
            "model": F.col("model"),
            "route": F.col("route"),
            "input_tokens": coerce.long_of(F.col("input_tokens")),
            "output_tokens": coerce.long_of(F.col("output_tokens")),
            "cost_usd": coerce.double_of(F.col("cost_usd")),
            "is_error": F.col("has_exception") | coerce.failed_in_words(F.col("status")),
            "status": F.col("status"),
            "source_file": F.col("source_file"),
        },
        prompt=F.coalesce(F.col("chat"), F.col("prompt")),
        **options,
    )


def normalize_helicone_log(df: DataFrame, **options) -> DataFrame:
    """The same export as JSON lines: keys in any case, of which the last counts; bodies as JSON."""
    names = sorted({n for aliases in HELICONE_COLUMNS.values() for n in aliases})

    def text(name: str) -> Column:
        last = F.try_element_at(F.filter("entries", lambda e: e["key"] == name), F.lit(-1))
        return chat.as_text(last["value"], "$")

    return normalize_helicone(df.select(*[text(n).alias(n) for n in names], source_file(df).alias("source_file")), **options)

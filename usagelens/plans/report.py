"""The full report: three passes over the usage table, then small tables only.

The passes are the usage cube, the token value histogram and the prompt groups. Each reads
only the columns it needs, so sketches are not touched by the first two.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.operators import grouped, tokens
from usagelens.operators.availability import METRICS, availability
from usagelens.operators.cube import COUNT, usage_cube
from usagelens.operators.duplicates import duplicate_stats, prompt_groups
from usagelens.plans.document import write_documents
from usagelens.storage import written


@dataclass(frozen=True)
class UsageReport:
    """One DataFrame per part of the report, each keyed by source format."""

    availability: DataFrame
    totals: DataFrame
    spend_by_model_day: DataFrame
    token_histograms: DataFrame
    duplicate_prompts: DataFrame
    model_mix: DataFrame
    tier_models: DataFrame
    error_rate: DataFrame
    by_day: DataFrame
    by_hour: DataFrame
    long_context_tail: DataFrame
    malformed: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


MALFORMED = "source_format string, source_file string, line_no bigint, reason string"


FILE_OF_SOURCE = "^[^:]*:"


def compute_report(
    usage: DataFrame, malformed: DataFrame | None = None, sources: DataFrame | None = None, by_file: bool = False
) -> UsageReport:
    """All metrics of a usage table. Give a stored table: it is read more than once.

    ``malformed`` lists input lines that no row was made of. ``sources`` (source_format, source_file)
    lists the files read, so that those without rows are reported too. With ``by_file`` each file has a
    report of its own, and every table has the column ``source_file``; duplicates are then sought inside a file.
    """
    spark = usage.sparkSession
    sources = spark.createDataFrame([], "source_format string, source_file string") if sources is None else sources
    if by_file:
        source = F.concat_ws(":", "source_format", F.coalesce("source_file", F.lit("")))
        source = source.alias("source_format", metadata={grouped.BY_FILE: True})
        usage = usage.select(source, *(c for c in usage.columns if c != "source_format"))
        sources = sources.select(source)
        left_out = spark.createDataFrame([], MALFORMED) if malformed is None else malformed
        whole = _report_by_source(usage, left_out, sources.distinct())
        tables = {n: df if n == "malformed" else _with_file(df) for n, df in whole.tables().items()}
        return UsageReport(**tables)
    return _report_by_source(usage, malformed, sources.select("source_format").distinct())


def _with_file(df: DataFrame) -> DataFrame:
    """The format and the file that a source's name is made of, in the columns' place."""
    name = F.col("source_format")
    parts = [F.substring_index(name, ":", 1).alias("source_format"), F.regexp_replace(name, FILE_OF_SOURCE, "").alias("source_file")]
    return df.select(*parts, *(c for c in df.columns if c != "source_format"))


def _report_by_source(usage: DataFrame, malformed: DataFrame | None, sources: DataFrame) -> UsageReport:
    cube = written(usage_cube(usage), "cube")
    flags = written(grouped.capabilities_of(cube, sources), "capabilities")
    values = written(tokens.token_values(usage), "token-values")  # read twice by the ranks
    ranked = written(tokens.ranked_values(values), "ranked")
    able = flags.where("has_prompt_text").select("source_format")
    if able.isEmpty():
        # No format carries prompts: leave the duplicate search out of the plan.
        spark = usage.sparkSession
        stats = spark.createDataFrame([], duplicate_stats(_no_groups(usage)).schema)
    else:
        stats = written(duplicate_stats(prompt_groups(usage)), "duplicate-stats")
    return UsageReport(
        availability=availability(flags),
        totals=grouped.with_all_sources(
            grouped.totals(cube), sources, **{c: F.lit(0).cast(COUNT) for c in ("requests", "input_tokens", "output_tokens")}
        ),
        spend_by_model_day=_where_able(grouped.spend_by_model_day(cube), flags, "has_tokens or has_cost"),
        token_histograms=tokens.token_histograms(ranked),
        duplicate_prompts=stats,
        model_mix=grouped.model_mix(cube),
        tier_models=grouped.tier_models(cube),
        # Without requests the rate is taken of one.
        error_rate=grouped.with_all_sources(
            grouped.error_rate(cube), grouped.per_request(sources), total_requests=F.lit(1).cast(COUNT),
            error_requests=F.lit(0).cast(COUNT), error_rate=F.lit(0.0),
        ),
        by_day=grouped.requests_by_day(cube),
        by_hour=grouped.requests_by_hour(cube),
        long_context_tail=tokens.long_context_tail(ranked),
        malformed=usage.sparkSession.createDataFrame([], MALFORMED) if malformed is None else malformed,
    )


def _no_groups(usage: DataFrame) -> DataFrame:
    return usage.sparkSession.createDataFrame(
        [], "source_format string, prompt_hash string, n_records bigint, is_near boolean"
    )


def _where_able(metric: DataFrame, flags: DataFrame, condition: str) -> DataFrame:
    """Drop formats that cannot give a metric; ``flags`` has one row per format."""
    able = flags.where(condition).select("source_format")
    return metric.join(able, "source_format", "left_semi")


def _json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _keys(report: UsageReport) -> list[str]:
    return [c for c in ("source_format", "source_file") if c in report.totals.columns]


def _lines(df: DataFrame, keys: list[str], metric: str, key: Column, *columns: str) -> DataFrame:
    return df.select(*keys, F.lit(metric).alias("metric"), key.alias("key"), _json(*columns).alias("value"))


def report_lines(report: UsageReport) -> DataFrame:
    """(source_format, metric, key, value): the report as one JSON object a row.

    Each format has a ``report`` line with its totals and the state of each metric, and one line for
    each row of a computed metric. Within a metric, ``key`` puts the rows in report order. Nothing is
    gathered, so a report of any size is written whole.
    """
    none, keys = F.lit(""), _keys(report)
    state = F.struct("status", "reason")
    states = report.availability.groupBy(*keys).agg(
        *[F.first(F.when(F.col("metric") == m, state), ignorenulls=True).alias(m) for m in METRICS]
    )
    head = report.totals.join(states, keys).select(
        *keys, F.struct("requests", "input_tokens", "output_tokens", "cost_usd").alias("totals"),
        F.struct(*METRICS).alias("metrics"),
    )
    spend = ["model", "day", "n_requests", "input_tokens", "output_tokens", "cost_usd"]
    mix = ["tier", "n_models", "n_requests", "share_of_requests", "input_tokens"]
    duplicates = [c for c in report.duplicate_prompts.columns if c not in keys]
    tail = [
        "p95_input_tokens", "p99_input_tokens", "max_input_tokens", "requests_over_32k_input",
        "share_of_input_tokens_in_top_1pct_requests",
    ]
    histogram = ["kind", "count", "min", "p50", "p90", "p99", "max", "mean"]
    parts = [
        ("spend_by_model_day", "spend_by_model_day", report.spend_by_model_day, F.concat_ws(" ", "day", "model"), spend),
        ("token_histograms", "token_histograms", report.token_histograms, F.col("kind"), histogram),
        ("duplicate_prompts", "duplicate_prompts", report.duplicate_prompts, none, duplicates),
        ("model_mix", "model_mix", report.model_mix, F.col("tier"), mix),
        ("model_mix", "tier_models", report.tier_models, F.concat_ws(" ", "tier", "model"), ["tier", "model", "n_requests"]),
        ("error_rate", "error_rate", report.error_rate, none, ["total_requests", "error_requests", "error_rate"]),
        ("temporal_patterns", "by_day", report.by_day, F.col("day"), ["day", "n_requests", "cost_usd"]),
        ("temporal_patterns", "by_hour", report.by_hour, F.lpad(F.col("hour").cast("string"), 2, "0"), ["hour", "n_requests"]),
        ("long_context_tail", "long_context_tail", report.long_context_tail, none, tail),
    ]
    out = _lines(head, keys, "report", none, "totals", "metrics")
    for metric, name, df, key, columns in parts:
        able = report.availability.where((F.col("metric") == metric) & (F.col("status") == "computed"))
        rows = df.join(able.select(*keys), keys, "left_semi")
        out = out.unionByName(_lines(rows, keys, name, key, *columns))
    bad = report.malformed.groupBy(*keys, "reason").agg(
        F.count("*").alias("lines"), F.count_distinct("source_file").alias("files")
    )
    return out.unionByName(_lines(bad, keys, "malformed_lines", F.col("reason"), "reason", "lines", "files"))


def report_text(lines: DataFrame, version: str) -> DataFrame:
    """Report lines as JSON text (value), each with its source, metric and key."""
    keys = [c for c in lines.columns if c != "value"]
    line = F.concat(
        F.lit('{"tool":"usagelens","version":"'), F.lit(version), F.lit('","at":'),
        _json(*keys), F.lit(',"value":'), F.col("value"), F.lit("}"),
    )
    return lines.select(*keys, line.alias("value"))


def write_report(report: UsageReport, out: str, version: str, mode: str = "errorifexists") -> None:
    """Tables as Parquet under ``out/tables``, JSON lines in report order under ``out/report``, documents under ``out/documents``."""
    for name, df in report.tables().items():
        df.write.mode(mode).parquet(f"{out}/tables/{name}")
    lines = report_lines(report)
    text = report_text(lines, version).orderBy(*_keys(report), "metric", "key")
    text.select("value").write.mode(mode).text(f"{out}/report")
    write_documents(report, f"{out}/documents", version, mode)

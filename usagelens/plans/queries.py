"""Registered queries: every operator, run over whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.functions import chat, coerce, formats, prompts, tiers
from usagelens.operators import audit, duplicates, fragments, grouped, tokens, vectors
from usagelens.operators.availability import availability
from usagelens.operators.cube import COUNT, usage_cube
from usagelens.plans import raw, views
from usagelens.plans.analyze import analyze
from usagelens.plans.document import document_pieces
from usagelens.plans.report import compute_report, report_lines, report_text, write_report
from usagelens.sources import lines, normalize
from usagelens.sources.readers import read_usage
from usagelens.storage import scratch_path, written
from usagelens.streaming.ingest import append_usage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query. Exact decimal totals are shown as BIGINT; one beyond that fails."""

    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        totals = {x.name: F.col(x.name).cast("bigint") for x in df.schema if x.dataType.simpleString() == COUNT}
        return df.withColumns(totals) if totals else df

    QUERIES[f.__name__] = shown
    return f


def _money(df: DataFrame) -> DataFrame:
    """Costs to six places, as sums of doubles depend on their order."""
    return df.withColumn("cost_usd", F.round("cost_usd", 6))


def _log_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_cube(views.request_log(spark, sf_dir))


def _billing_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_cube(views.billing(spark, sf_dir))


def _all_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [views.request_log(spark, sf_dir), views.billing(spark, sf_dir)]
    return reduce(DataFrame.unionByName, parts)


# Grouped metrics


@query
def spend_by_model_day(spark, sf_dir):
    return _money(grouped.spend_by_model_day(_log_cube(spark, sf_dir)))


@query
def billing_spend_by_model_day(spark, sf_dir):
    return _money(grouped.spend_by_model_day(_billing_cube(spark, sf_dir)))


@query
def totals(spark, sf_dir):
    return _money(grouped.totals(usage_cube(_all_usage(spark, sf_dir))))


@query
def large_totals(spark, sf_dir):
    """Totals beyond 64 bits and beyond 1e12 dollars, as text."""
    big = {
        "input_tokens": F.lit(10**15) * F.col("n_requests") + F.lit(9 * 10**17) - F.coalesce("input_tokens", F.lit(0)),
        "cost_usd": F.col("cost_usd") * 0 + 1e9,
    }
    t = grouped.totals(usage_cube(views.billing(spark, sf_dir).withColumns(big)))
    return t.select("source_format", *(F.col(c).cast("string").alias(c) for c in ("requests", "input_tokens")),
                    F.floor("cost_usd").cast("string").alias("cost_usd"))


@query
def capabilities(spark, sf_dir):
    return grouped.capabilities(usage_cube(_all_usage(spark, sf_dir)))


@query
def metric_availability(spark, sf_dir):
    return availability(grouped.capabilities(usage_cube(_all_usage(spark, sf_dir))))


@query
def model_mix(spark, sf_dir):
    return grouped.model_mix(_log_cube(spark, sf_dir))


@query
def billing_model_mix(spark, sf_dir):
    return grouped.model_mix(_billing_cube(spark, sf_dir))


@query
def tier_models(spark, sf_dir):
    return grouped.tier_models(_log_cube(spark, sf_dir))


@query
def error_rate(spark, sf_dir):
    return grouped.error_rate(usage_cube(_all_usage(spark, sf_dir)))


@query
def requests_by_day(spark, sf_dir):
    return _money(grouped.requests_by_day(_log_cube(spark, sf_dir)))


@query
def billing_requests_by_day(spark, sf_dir):
    return _money(grouped.requests_by_day(_billing_cube(spark, sf_dir)))


@query
def requests_by_hour(spark, sf_dir):
    return grouped.requests_by_hour(_log_cube(spark, sf_dir))


# Token distributions


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.ranked_values(tokens.token_values(views.request_log(spark, sf_dir)))


@query
def token_histograms(spark, sf_dir):
    return tokens.token_histograms(_ranked(spark, sf_dir))


@query
def long_context_tail(spark, sf_dir):
    return tokens.long_context_tail(_ranked(spark, sf_dir))


# Scalar functions


@query
def coerce_numbers(spark, sf_dir):
    e = raw.event_cells(spark, sf_dir, cell=raw.NUMBER_CELL)
    return e.select(
        "event_id",
        coerce.to_long(F.col("cell")).alias("as_long"),
        coerce.to_double(F.col("cell")).alias("as_double"),
        coerce.at_least_one(coerce.to_long(F.col("cell"))).alias("as_requests"),
    )


@query
def coerce_timestamps(spark, sf_dir):
    e = raw.event_cells(spark, sf_dir, cell=raw.TIME_CELL)
    ts = coerce.to_timestamp(F.col("cell"))
    return e.select(
        "event_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("at"),
        tiers.day_name(ts).alias("day"), F.hour(ts).alias("hour"),
    )


@query
def error_flags(spark, sf_dir):
    e = raw.event_cells(spark, sf_dir, cell=raw.STATUS_CELL)
    return e.select(
        "event_id",
        coerce.failed_over_http(F.col("cell")).alias("http_error"),
        coerce.failed_in_words(F.col("cell")).alias("log_error"),
    )


@query
def alias_pick(spark, sf_dir):
    e = raw.event_cells(spark, sf_dir, Amount=raw.NUMBER_CELL, COST=raw.STATUS_CELL)
    cells = normalize.columns_by_alias(e.select("event_id", "Amount", "COST"))
    return e.select("event_id", normalize.pick(cells, ["cost", "cost_usd", "amount"]).alias("picked"))


@query
def price_tiers(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select("p_partkey", F.expr(raw.MODEL_NAME).alias("model"))
    return p.select("p_partkey", "model", tiers.price_tier(F.col("model")).alias("tier"))


@query
def file_formats(spark, sf_dir):
    e = raw.event_cells(spark, sf_dir, line=raw.HEAD_LINE)
    return (
        e.groupBy(F.coalesce(formats.format_of_line(F.col("line")), F.lit("unknown")).alias("format"))
        .agg(F.count("*").alias("files"))
    )


@query
def chat_text(spark, sf_dir):
    """Each turn as a chat body with string, block, empty and foreign elements."""
    turns = views.table(spark, sf_dir, "conversations")
    kind, text = F.lit("text").alias("type"), F.upper("role").alias("text")
    blocks = F.array(F.struct(kind, text), F.struct(kind, F.lit("").alias("text")))
    messages = F.concat_ws(
        ",",
        F.to_json(F.struct("role", F.col("text").alias("content"))),
        F.lit('{"role": "tool", "content": ""}'),
        F.lit("7"),
        F.to_json(F.struct(blocks.alias("content"))),
    )
    body = F.concat(F.lit('{"messages": ['), messages, F.lit("]}"))
    return turns.select(
        "conv_id", "turn", F.sha2(chat.message_text(F.try_parse_json(body)), 256).alias("text_hash")
    )


# Prompts


@query
def prompt_sketches(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    d = prompts.redact(docs, F.col("text"))
    return d.select(
        "doc_id", "prompt_hash", F.size("prompt_sketch").alias("sketch_size"),
        F.md5(F.array_join(F.col("prompt_sketch").cast("array<string>"), ",")).alias("sketch_digest"),
    )


@query
def sketch_jaccard(spark, sf_dir):
    """Similarity of every document to the next one by id."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    d = written(prompts.redact(docs, F.col("text")).select("doc_id", "prompt_sketch"), "sketches")
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("prompt_sketch").alias("b"))
    value = prompts.sketch_jaccard(F.col("prompt_sketch"), F.col("b"))
    return d.join(following, "doc_id").select("doc_id", F.round(value, 9).alias("jaccard"))


@query
def exact_duplicates(spark, sf_dir):
    return duplicates.exact_stats(views.document_prompts(spark, sf_dir))


@query
def near_duplicates(spark, sf_dir):
    groups = duplicates.prompt_groups(views.document_prompts(spark, sf_dir))
    return duplicates.duplicate_stats(groups)


@query
def near_duplicate_flags(spark, sf_dir):
    return duplicates.prompt_groups(views.document_prompts(spark, sf_dir)).drop("source_format")


@query
def templated_near_duplicates(spark, sf_dir):
    groups = duplicates.prompt_groups(views.templated_prompts(spark, sf_dir))
    return duplicates.duplicate_stats(groups)


# Readers


def _shown(usage: DataFrame, *more: str) -> DataFrame:
    """Normalized rows in types that compare alike in any engine."""
    return usage.select(
        *more,
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"),
        "model", "route", "input_tokens", "output_tokens", "cost_usd", "is_error", "status",
        "n_requests", "prompt_hash", F.size("prompt_sketch").alias("sketch_size"),
    )


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request log objects, with fields in the nested, plain and missing places."""
    e = views.spread(views.table(spark, sf_dir, "events"))
    third = F.col("event_id") % 3
    return e.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.when(third != 0, F.col("event_type")).alias("call_type"),
        F.when(third == 0, F.lit("/v1/chat")).alias("endpoint"),
        views.model_by(F.col("user_id")).alias("model"),
        F.when(third == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("startTime"),
        F.when(third == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(third != 2, F.struct(
            F.floor(F.col("value") * 100).alias("prompt_tokens"),
            (F.col("event_id") % 800).alias("completion_tokens"),
        )).alias("usage"),
        F.when(third == 2, F.floor(F.col("value") * 10)).alias("prompt_tokens"),
        F.when(third == 0, F.col("value")).alias("response_cost"),
        F.when(third == 1, F.concat(F.lit("$"), F.col("value").cast("string"))).alias("cost"),
        F.when(F.col("event_type") == "error", F.lit("failure")).otherwise("success").alias("status"),
        F.when(F.col("event_id") % 7 == 0, F.lit("timeout")).otherwise("").alias("exception"),
        F.when(third == 1, F.array(F.struct(
            F.lit("user").alias("role"), F.concat_ws(" ", F.lit("Say  "), "event_type", "props").alias("content")
        ))).alias("messages"),
        F.when(third == 2, F.concat_ws(" ", "event_type", "props")).alias("prompt"),
    )


def _as_lines(log: DataFrame) -> DataFrame:
    return log.select(F.to_json(F.struct("*")).alias("line"))


@query
def request_log_lines(spark, sf_dir):
    """Events written as JSON lines in memory and read back by the log reader."""
    objects = lines.parse_objects(_as_lines(_event_log(spark, sf_dir)))
    return _shown(normalize.normalize_litellm(objects))


@query
def request_log_csv(spark, sf_dir):
    """Events as text cells of a request log export, with a JSON body."""
    e = raw.event_cells(
        spark, sf_dir, created_at=raw.TIME_CELL, Model=raw.MODEL_CELL, prompt_tokens=raw.NUMBER_CELL,
        Cost=raw.NUMBER_CELL, status=raw.STATUS_CELL,
    )
    body = F.when(
        F.col("event_id") % 4 != 0,
        F.to_json(F.struct(F.array(F.struct(F.col("props").alias("content"))).alias("messages"))),
    ).otherwise("{broken")
    cells = e.select(
        "created_at", "Model", "prompt_tokens", "Cost", "status",
        F.col("event_type").alias("path"), F.col("event_id").cast("string").alias("completion_tokens"),
        body.alias("request_body"),
        F.when(F.col("event_id") % 8 == 0, F.col("event_type")).alias("prompt"),
    )
    return _shown(normalize.normalize_helicone(cells))


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text cells of an activity export."""
    i = views.spread(views.table(spark, sf_dir, "lineitem").drop("l_tax"))
    return i.select(
        (F.unix_date(F.to_date("l_shipdate")).cast("bigint") * 86400).cast("string").alias("timestamp"),
        views.model_by(F.col("l_suppkey")).alias("model"),
        F.col("l_returnflag").alias("operation"),
        F.concat(F.floor("l_extendedprice").cast("string"), F.lit(".0")).alias("n_context_tokens_total"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).otherwise(" ")
        .alias("n_generated_tokens_total"),
        F.floor(F.col("l_quantity") - 1).cast("string").alias("num_requests"),
    )


@query
def activity_csv(spark, sf_dir):
    usage = normalize.normalize_openai(_activity(spark, sf_dir))
    return (
        usage.groupBy("model", "route", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))
        .agg(
            F.count("*").alias("rows"), F.sum("n_requests").alias("n_requests"),
            F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        )
    )


@query
def cache_usage_csv(spark, sf_dir):
    """Line items as a usage export with input split by cache use, or in one plain column."""
    i = views.spread(views.table(spark, sf_dir, "lineitem").drop("l_tax"))
    has = F.col("l_linenumber") % 3
    cells = i.select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm").alias("usage_date_utc"),
        views.model_by(F.col("l_suppkey")).alias("model_version"),
        F.col("l_linestatus").alias("workspace"),
        F.when(has == 1, F.floor("l_extendedprice").cast("string")).otherwise("").alias("usage_input_tokens_no_cache"),
        F.when(has != 0, F.floor("l_quantity").cast("string")).alias("usage_input_tokens_cache_read"),
        F.col("l_partkey").cast("string").alias("input_tokens"),
        F.col("l_suppkey").cast("string").alias("usage_output_tokens"),
    )
    usage = normalize.normalize_anthropic(cells)
    return (
        usage.groupBy("model", "route")
        .agg(
            F.count("*").alias("rows"), F.count("timestamp").alias("dated"),
            F.sum("n_requests").alias("n_requests"), F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"), F.count("cost_usd").alias("costs"),
        )
    )


@query
def cost_csv(spark, sf_dir):
    """Line items as a cost export: one row per token type, no tokens."""
    i = views.spread(views.table(spark, sf_dir, "lineitem").drop("l_tax"))
    cells = i.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("usage_date_utc"),
        views.model_by(F.col("l_suppkey")).alias("Model"),
        F.col("l_returnflag").alias("token_type"),
        F.concat(F.lit("$"), F.col("l_quantity").cast("string")).alias("cost_usd"),
    )
    cube = usage_cube(normalize.normalize_anthropic(cells))
    return _money(grouped.spend_by_model_day(cube))


@query
def malformed_log_lines(spark, sf_dir):
    e = raw.event_cells(spark, sf_dir, line=raw.LOG_LINE)
    reason = lines.fault(coerce.strip(F.col("line")))
    return e.where(reason.isNotNull()).groupBy(reason.alias("reason")).agg(F.count("*").alias("lines"))


@query
def request_log_any_case(spark, sf_dir):
    """Events as JSON lines of a request log export with keys in mixed case; of two that differ in case the last counts."""
    e = raw.event_cells(spark, sf_dir, cell=raw.NUMBER_CELL, code=raw.STATUS_CELL)
    body = F.struct(F.array(F.struct(F.col("props").alias("content"))).alias("messages"))
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Created_At"), F.lit("hidden").alias("Path"),
        F.col("event_type").alias("PATH"), F.col("cell").alias("Prompt_Tokens"), F.col("event_id").alias("COMPLETION_TOKENS"),
        F.col("code").alias("Status"), F.when(F.col("event_id") % 2 == 0, body).alias("Request_Body"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("pRoMpT"),
    )).alias("line")
    usage = normalize.normalize_helicone_log(lines.parse_entries(e.select(line)))
    return usage.groupBy("route").agg(
        F.count("*").alias("rows"), F.count("timestamp").alias("dated"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.count_if("is_error").alias("errors"),
        F.count("prompt_hash").alias("prompts"), F.count_distinct("prompt_hash").alias("distinct_prompts"),
    )


@query
def malformed_line_numbers(spark, sf_dir):
    """Log lines written in the order of events; the bad ones by their number over all files."""
    e = raw.event_cells(spark, sf_dir, line=raw.LOG_LINE)
    folder = f"{scratch_path(spark, 'log')}/lines"
    e.repartitionByRange("event_id").sortWithinPartitions("event_id").select("line").write.text(folder)
    file = F.col("_metadata.file_path").alias("source_file")
    files = spark.read.text(folder).select(file).groupBy("source_file").agg(F.count("*").alias("lines"))
    earlier = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("source_file", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    bad = lines.malformed_lines(spark, [folder]).join(files, "source_file")
    return bad.select((F.col("before") + F.col("line_no")).alias("number"), "reason")


LONG_PROMPT = 25_000_000


@query
def long_log_lines(spark, sf_dir):
    """Events as log lines; the prompt of every millionth has ``LONG_PROMPT`` characters."""
    e = views.spread(views.table(spark, sf_dir, "events"))
    size = F.when(F.col("event_id") % 1_000_000 == 0, F.lit(LONG_PROMPT)).otherwise(F.lit(20))
    log = e.select(
        F.col("event_type").alias("model"), F.struct(F.col("event_id").alias("prompt_tokens")).alias("usage"),
        F.rpad(F.col("event_id").cast("string"), size, " word").alias("prompt"),
    )
    text = lines.read_text(_as_lines(log))
    usage = normalize.normalize_litellm(lines.parse_objects(text))
    faults = text.agg(F.count_if(lines.fault(F.col("line")).isNotNull()).alias("faults"))
    found = usage.groupBy("model").agg(
        F.count("*").alias("rows"), F.sum("input_tokens").alias("input_tokens"), F.count("prompt_hash").alias("prompts"),
        F.count_distinct("prompt_hash").alias("distinct_prompts"),
    )
    return found.join(F.broadcast(faults))  # one row


@query
def quoted_csv(spark, sf_dir):
    """Events written as CSV with quotes, commas and line feeds in cells, and read back in splits."""
    e = views.spread(views.table(spark, sf_dir, "events"))
    cell = F.concat(
        F.col("event_id").cast("string"), F.lit(', said "'), "event_type", F.lit('"\n\n'),
        F.repeat(F.lit('",\n'), (F.col("event_id") % 7).cast("int")), F.coalesce("props", F.lit("")),
    )
    folder = f"{scratch_path(spark, 'quoted')}/cells"
    e.select(
        F.col("event_id").cast("string").alias("request_id"), F.col("event_id").alias("prompt_tokens"),
        F.col("event_type").alias("path"), cell.alias("prompt"),
    ).write.options(header=True, quote='"', escape='"', quoteAll=True).csv(folder)
    usage = read_usage(spark, folder)
    return usage.select("route", "input_tokens", "prompt_hash")


@query
def mixed_exports(spark, sf_dir):
    """Write a request log and an activity export to files, detect and read them back."""
    folder = scratch_path(spark, "exports")
    _as_lines(_event_log(spark, sf_dir)).write.text(f"{folder}/log")
    _activity(spark, sf_dir).write.option("header", True).csv(f"{folder}/activity")
    usage = read_usage(spark, folder)
    return usage.groupBy("source_format").agg(
        F.count("*").alias("records"), F.sum("n_requests").alias("n_requests"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count("prompt_hash").alias("prompts"), F.count("timestamp").alias("dated"),
    )


@query
def normalized_profile(spark, sf_dir):
    """Filled cells of each normalized column, by format, over all three kinds of source."""
    usage = _all_usage(spark, sf_dir).unionByName(views.document_prompts(spark, sf_dir))
    names = ["timestamp", "model", "input_tokens", "output_tokens", "cost_usd", "status", "prompt_hash"]
    return usage.groupBy("source_format").agg(
        F.count("*").alias("records"), *[F.count(c).alias(f"filled_{c}") for c in names]
    )


# Report, audits, stream


@query
def report_summary(spark, sf_dir):
    """One row per format out of the whole report."""
    usage = _all_usage(spark, sf_dir).unionByName(views.document_prompts(spark, sf_dir))
    r = compute_report(written(usage, "usage"))
    able = r.availability.groupBy("source_format").agg(
        F.count_if(F.col("status") == "computed").alias("computed_metrics")
    )
    spend = r.spend_by_model_day.groupBy("source_format").agg(F.count("*").alias("spend_rows"))
    out = r.totals.join(able, "source_format").join(spend, "source_format")
    out = out.join(r.duplicate_prompts, "source_format", "left")
    out = out.join(r.error_rate.select("source_format", "error_requests"), "source_format", "left")
    tail = r.long_context_tail.select("source_format", "p99_input_tokens", "requests_over_32k_input")
    return _money(out.join(tail, "source_format", "left"))


def _text_report(spark: SparkSession, sf_dir: str):
    """The report of all usage and of documents as prompts."""
    usage = _all_usage(spark, sf_dir).unionByName(views.document_prompts(spark, sf_dir))
    return compute_report(written(usage, "usage"))


@query
def report_json(spark, sf_dir):
    """Every line of the written JSON report, read back: rows and figures by format and metric."""
    folder = scratch_path(spark, "report")
    write_report(_text_report(spark, sf_dir), folder, "test")
    v = F.try_parse_json("value")
    text = lambda path, kind="string": F.try_variant_get(v, path, kind)
    lines = spark.read.text(f"{folder}/report").select(
        text("$.at.source_format").alias("source_format"), text("$.at.metric").alias("metric"),
        text("$.at.key").alias("key"), text("$.value.n_requests", "bigint").alias("n"),
        text("$.value.totals.requests", "bigint").alias("requests"),
        text("$.value.metrics.error_rate.reason").alias("error_reason"),
        text("$.value.exact_duplicate_records", "bigint").alias("exact_duplicates"),
        text("$.value.near_duplicate_records", "bigint").alias("near_duplicates"),
        text("$.value.p90", "bigint").alias("p90"),
    )
    return lines.groupBy("source_format", "metric").agg(
        F.count("*").alias("lines"), F.min("key").alias("first_key"), F.max("key").alias("last_key"),
        F.sum("n").alias("n_requests"), F.max("requests").alias("requests"), F.max("error_reason").alias("error_reason"),
        F.max("exact_duplicates").alias("exact_duplicates"), F.max("near_duplicates").alias("near_duplicates"),
        F.sum("p90").alias("p90"),
    )


@query
def reports_by_file(spark, sf_dir):
    """Reports of single files, among them one without rows, added up by format."""
    folder = scratch_path(spark, "exports")
    _as_lines(_event_log(spark, sf_dir)).write.text(f"{folder}/log")
    _activity(spark, sf_dir).write.option("header", True).csv(f"{folder}/activity")
    heads = views.table(spark, sf_dir, "region").limit(1).select(F.lit("request_id,prompt_tokens,request_body"))
    heads.write.text(f"{folder}/empty")
    r = analyze(spark, folder, by_file=True)
    keys = ["source_format", "source_file"]
    able = r.availability.groupBy(*keys).agg(F.count_if(F.col("status") == "computed").alias("computed"))
    errors = r.error_rate.select(*keys, "error_requests")
    rows = r.totals.join(able, keys).join(errors, keys, "left")
    return rows.groupBy("source_format").agg(
        F.sum("requests").cast(COUNT).alias("requests"), F.sum("input_tokens").cast(COUNT).alias("input_tokens"),
        F.sum("output_tokens").cast(COUNT).alias("output_tokens"), F.sum("error_requests").cast(COUNT).alias("errors"),
        F.max("computed").alias("computed_metrics"),
    )


@query
def report_document(spark, sf_dir):
    """The pieces of the report's JSON documents: elements of each metric, and those that follow another."""
    pieces = document_pieces(_text_report(spark, sf_dir), "test")
    comma = F.startswith("text", F.lit(",")).cast("int")
    return pieces.where("section between 1 and 7 and slot in (1, 3) and sub < 2").groupBy(
        "source_format", "section", "slot", "sub"
    ).agg(F.count("*").alias("elements"), F.sum(comma).cast("bigint").alias("after_others"))


@query
def fragment_audit(spark, sf_dir):
    """Cells cut from documents, and cells of other words, against all documents as prompts."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = F.substring("text", (F.col("doc_id") % 50 + 1).cast("int"), (F.col("doc_id") % 60).cast("int"))
    cells = docs.where(F.length(cut) > 0).select(
        F.when(F.col("doc_id") % 2 == 0, "cut").otherwise("reversed").alias("column"),
        F.col("doc_id").alias("cell"), F.when(F.col("doc_id") % 2 == 0, cut).otherwise(F.reverse(cut)).alias("text"),
    )
    return fragments.fragment_audit(docs.select("text"), cells)


@query
def output_fragment_audit(spark, sf_dir):
    """No string of the report may hold a fragment of any document, or be long."""
    cells = fragments.report_cells(report_lines(_text_report(spark, sf_dir)))
    prompts = views.table(spark, sf_dir, "documents").select("text")
    return fragments.fragment_audit(prompts, cells).drop("cells")


@query
def near_vector_flags(spark, sf_dir):
    """Embeddings and their variants that are near to another by cosine."""
    return vectors.near_vectors(views.varied_vectors(spark, sf_dir), "vec_id", "embedding")


@query
def leak_audit(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return audit.leak_audit(docs, ["licensed under", "password", "the of", "Éeau"])


def _report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells of the report: its JSON lines by metric, as one column each."""
    lines = report_text(report_lines(_text_report(spark, sf_dir)), "test")
    return lines.select("metric", "key", "value")


@query
def output_leak_audit(spark, sf_dir):
    """All lines of the report: no cell may hold a fragment of a prompt."""
    return audit.leak_audit(_report_cells(spark, sf_dir), ["customer", "licensed under", "password"]).drop("long_cells")


@query
def identifier_scan(spark, sf_dir):
    return audit.identifier_scan(views.table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query
def advice_cells(spark, sf_dir):
    return audit.advice_cells(views.table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query
def output_advice_cells(spark, sf_dir):
    """All lines of the report hold no advice."""
    return audit.advice_cells(_report_cells(spark, sf_dir)).drop("cells")


@query
def streamed_spend(spark, sf_dir):
    """Events taken in as a stream into the normalized table, then spend on that table."""
    batch = views.table(spark, sf_dir, "events")
    events = (
        spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    folder = scratch_path(spark, "stream")
    append_usage(views.log_of_events(events), f"{folder}/usage", f"{folder}/state").awaitTermination()
    return _money(grouped.spend_by_model_day(usage_cube(spark.read.parquet(f"{folder}/usage"))))

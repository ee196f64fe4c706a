"""The report of a source as one JSON document, in pieces that are put in order and never gathered.

A document is {tool, version, privacy, report: {source_format, totals, metrics: {name: {status, value |
reason}}}}. Each bracket and each element is a row with its place; rows are ordered by range, so the text
parts of a source's folder, one after the other, are its document, however long its lists are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.operators.availability import METRICS
from usagelens.operators.grouped import is_request_log

PRIVACY = "aggregates only; contains no prompt text"
PLACE = ("section", "slot", "key", "sub", "subkey")
OPEN, FIRST, BETWEEN, SECOND, CLOSE = range(5)


def _object(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _text(value: Column) -> Column:
    """A JSON string."""
    own = F.to_json(F.array(value))
    return F.substring(own, F.lit(2), F.length(own) - 2)


def _rows(df: DataFrame, keys: list[str], section: int, slot: int, text: Column, key=None, sub: int = 0, subkey=None) -> DataFrame:
    blank = F.lit("")
    return df.select(
        *keys, F.lit(section).alias("section"), F.lit(slot).alias("slot"), (blank if key is None else key).alias("key"),
        F.lit(sub).alias("sub"), (blank if subkey is None else subkey).alias("subkey"), text.alias("text"),
    )


def _listed(rows: DataFrame, keys: list[str], *within: str) -> DataFrame:
    """Elements of a list: all but the first of each begin with a comma."""
    group = [*keys, *within]
    first = rows.groupBy(*group).agg(F.min(F.struct("key", "subkey")).alias("first"))
    comma = F.when(F.struct("key", "subkey") == F.col("first"), "").otherwise(",")
    return rows.join(first, group).withColumn("text", F.concat(comma, "text")).select(rows.columns)


def document_pieces(report, version: str) -> DataFrame:
    """(source_format, [source_file], section, slot, key, sub, subkey, text): the documents of all sources."""
    keys = [c for c in ("source_format", "source_file") if c in report.totals.columns]
    names = F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), _text(F.col(k))) for k in keys))
    meta = f'{{"tool":"usagelens","version":"{version}","privacy":"{PRIVACY}","report":{{'
    totals = _object("requests", "input_tokens", "output_tokens", "cost_usd")
    head = F.concat(F.lit(meta), names, F.lit(',"totals":'), totals, F.lit(',"metrics":{'))
    parts = [_rows(report.totals, keys, 0, OPEN, head), _rows(report.totals, keys, len(METRICS) + 1, CLOSE, F.lit("}}}"))]

    def able(df: DataFrame, metric: str) -> DataFrame:
        own = report.availability.where((F.col("metric") == metric) & (F.col("status") == "computed"))
        return df.join(own.select(*keys), keys, "left_semi")

    def frame(metric: str, begin: str, end: str) -> int:
        section = METRICS.index(metric) + 1
        name = f'{"," if section > 1 else ""}"{metric}":{{"status":'
        states = report.availability.where(F.col("metric") == metric)
        lacking = F.concat(F.lit(f'{name}"unavailable","reason":'), _text(F.col("reason")), F.lit("}"))
        computed = F.col("status") == "computed"
        opened = F.when(computed, F.lit(f'{name}"computed","value":{begin}')).otherwise(lacking)
        parts.append(_rows(states, keys, section, OPEN, opened))
        parts.append(_rows(states.where(computed), keys, section, CLOSE, F.lit(f"{end}}}")))
        return section

    def whole(metric: str, df: DataFrame) -> None:
        columns = [c for c in df.columns if c not in (*keys, "top_1pct_input_tokens", "all_input_tokens")]
        parts.append(_rows(able(df, metric), keys, frame(metric, "", ""), FIRST, _object(*columns)))

    spend = able(report.spend_by_model_day, "spend_by_model_day")
    columns = ["model", "day", "n_requests", "input_tokens", "output_tokens", "cost_usd"]
    section = frame("spend_by_model_day", "[", "]")
    parts.append(_listed(_rows(spend, keys, section, FIRST, _object(*columns), F.col("day"), 0, F.col("model")), keys))

    section = frame("token_histograms", "{", "}")
    figures = [c for c in report.token_histograms.columns if c not in (*keys, "kind")]
    named = F.concat(_text(F.col("kind")), F.lit(":"), _object(*figures))
    parts.append(_listed(_rows(able(report.token_histograms, "token_histograms"), keys, section, FIRST, named, F.col("kind")), keys))

    whole("duplicate_prompts", report.duplicate_prompts)

    section = frame("model_mix", "[", "]")
    mix, tier = able(report.model_mix, "model_mix"), F.col("tier")
    begin = F.concat(F.lit('{"tier":'), _text(tier), F.lit(',"models":['))
    rest = _object("n_models", "n_requests", "share_of_requests", "input_tokens")
    end = F.concat(F.lit("],"), F.substring(rest, F.lit(2), F.length(rest)))
    models = _rows(able(report.tier_models, "model_mix"), keys, section, FIRST, _text(F.col("model")), tier, 1, F.col("model"))
    parts.append(_listed(_rows(mix, keys, section, FIRST, begin, tier), keys))
    parts.append(_listed(models, keys, "key"))
    parts.append(_rows(mix, keys, section, FIRST, end, tier, 2))

    whole("error_rate", report.error_rate)

    section = frame("temporal_patterns", '{"by_day":[', "]}")
    days, hours = (able(df, "temporal_patterns") for df in (report.by_day, report.by_hour))
    hour = F.lpad(F.col("hour").cast("string"), 2, "0")
    by_request = able(report.totals, "temporal_patterns")
    by_request = by_request.where(is_request_log(by_request))
    parts.append(_listed(_rows(days, keys, section, FIRST, _object("day", "n_requests", "cost_usd"), F.col("day")), keys))
    parts.append(_rows(by_request, keys, section, BETWEEN, F.lit('],"by_hour":[')))
    parts.append(_listed(_rows(hours, keys, section, SECOND, _object("hour", "n_requests"), hour), keys))

    whole("long_context_tail", report.long_context_tail)
    return reduce(DataFrame.unionByName, parts)


def write_documents(report, out: str, version: str, mode: str = "errorifexists") -> None:
    """One folder a source under ``out``; its parts one after the other are one JSON document."""
    pieces = document_pieces(report, version)
    keys = [c for c in pieces.columns if c not in (*PLACE, "text")]
    order = [*keys, *PLACE]
    rows = pieces.repartitionByRange(*order).sortWithinPartitions(*order).select(*keys, F.col("text").alias("value"))
    rows.write.mode(mode).partitionBy(*keys).text(out)

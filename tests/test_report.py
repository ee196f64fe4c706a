from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

import samples
from usagelens import analyze, compute_report, read_usage
from usagelens.operators import audit, tokens
from usagelens.operators.availability import METRICS, REASON
from usagelens.plans.report import report_lines, write_report
from usagelens.schema import USAGE_SCHEMA


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("exports")


def report_for(spark, folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return analyze(spark, str(path))


def lines_of(report):
    """The report's JSON lines: format and metric to the values in order."""
    out = {}
    for r in report_lines(report).orderBy("source_format", "metric", "key").collect():
        out.setdefault((r.source_format, r.metric), []).append(json.loads(r.value))
    return out


@pytest.fixture(scope="module")
def log_lines(spark, folder):
    found = lines_of(report_for(spark, folder, "log.jsonl", samples.request_log()))
    assert {f for f, _ in found} == {"litellm_jsonl"}
    return {metric: values for (_, metric), values in found.items()}


@pytest.fixture(scope="module")
def billing_lines(spark, folder):
    found = lines_of(report_for(spark, folder, "billing.csv", samples.simple_billing()))
    return {metric: values for (_, metric), values in found.items()}


ROWS = samples.REQUESTS


def test_totals(log_lines):
    totals = log_lines["report"][0]["totals"]
    assert totals["cost_usd"] == pytest.approx(round(sum(r.cost for r in ROWS), 6))
    del totals["cost_usd"]
    assert totals == {
        "requests": len(ROWS), "input_tokens": sum(r.tokens_in for r in ROWS),
        "output_tokens": sum(r.tokens_out for r in ROWS)}


def test_spend_rows_and_order(log_lines):
    rows = log_lines["spend_by_model_day"]
    want = samples.plain_spend(ROWS)
    assert [(r["day"], r["model"]) for r in rows] == sorted(want)
    for r in rows:
        n, tokens_in, tokens_out, cost = want[r["day"], r["model"]]
        assert (r["n_requests"], r["input_tokens"], r["output_tokens"]) == (n, tokens_in, tokens_out)
        assert r["cost_usd"] == pytest.approx(cost)


def test_histograms(log_lines):
    got = {h.pop("kind"): h for h in log_lines["token_histograms"]}
    assert got == {
        "input": samples.plain_histogram([r.tokens_in for r in ROWS]),
        "output": samples.plain_histogram([r.tokens_out for r in ROWS])}


def test_tail_and_errors(log_lines):
    sizes = [r.tokens_in for r in ROWS]
    assert log_lines["long_context_tail"] == [{
        "p95_input_tokens": samples.nearest_rank(sizes, 95), "p99_input_tokens": max(sizes), "max_input_tokens": max(sizes),
        "requests_over_32k_input": sum(s > 32000 for s in sizes),
        "share_of_input_tokens_in_top_1pct_requests": round(max(sizes) / sum(sizes), 4)}]
    failed = sum(r.failed for r in ROWS)
    assert log_lines["error_rate"] == [{
        "total_requests": len(ROWS), "error_requests": failed, "error_rate": round(failed / len(ROWS), 4)}]


def test_mix_and_time(log_lines):
    want = samples.plain_mix(ROWS)
    models = [{"tier": m["tier"], "model": name} for m in want for name in m["models"]]
    assert [{k: r[k] for k in ("tier", "model")} for r in log_lines["tier_models"]] == models
    for m in want:
        m["n_models"] = len(m.pop("models"))
    assert log_lines["model_mix"] == want
    days, hours = Counter(r.time[:10] for r in ROWS), Counter(int(r.time[11:13]) for r in ROWS)
    assert [(d["day"], d["n_requests"]) for d in log_lines["by_day"]] == sorted(days.items())
    assert [(h["hour"], h["n_requests"]) for h in log_lines["by_hour"]] == sorted(hours.items())


def test_duplicates(log_lines):
    d = log_lines["duplicate_prompts"][0]
    exact = samples.exact_duplicates(ROWS)
    assert (d["analyzed_records"], d["exact_duplicate_records"]) == (len(ROWS), exact)
    assert d["near_duplicate_records"] >= exact


def test_billing_metrics_are_marked_unavailable(billing_lines):
    states = billing_lines["report"][0]["metrics"]
    assert list(states) == list(METRICS)
    for name in ("token_histograms", "duplicate_prompts", "error_rate", "long_context_tail"):
        assert states[name] == {"status": "unavailable", "reason": REASON} and name not in billing_lines
    assert all(r["cost_usd"] is None for r in billing_lines["spend_by_model_day"])
    assert "by_hour" not in billing_lines and len(billing_lines["by_day"]) == len({b[0] for b in samples.BILLED})
    assert billing_lines["report"][0]["totals"] == {
        "requests": sum(b[4] for b in samples.BILLED), "input_tokens": sum(b[2] for b in samples.BILLED),
        "output_tokens": sum(b[3] for b in samples.BILLED), "cost_usd": None}


def test_cost_export(spark, folder):
    found = lines_of(report_for(spark, folder, "costs.csv", samples.token_costs()))
    head = found["anthropic_csv", "report"][0]
    assert head["totals"]["cost_usd"] == pytest.approx(round(sum(float(c[3]) for c in samples.COSTS), 6))
    assert head["metrics"]["spend_by_model_day"]["status"] == "computed"
    assert {m["model"] for m in found["anthropic_csv", "tier_models"]} == {c[1] for c in samples.COSTS}


def test_a_report_of_any_size_is_written_whole(spark, tmp_path):
    n = 210_000
    row = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in USAGE_SCHEMA}
    usage = spark.range(n).select(*[
        {"source_format": F.lit("openai_csv"), "model": F.concat(F.lit("m"), F.col("id")), "n_requests": F.lit(1).cast("bigint"),
         "is_error": F.lit(False), "input_tokens": F.lit(2).cast("bigint")}.get(name, c).alias(name) for name, c in row.items()
    ])
    write_report(compute_report(usage), str(tmp_path / "r"), "0")
    lines = spark.read.text(str(tmp_path / "r" / "report"))
    assert lines.where(F.contains("value", F.lit('"metric":"spend_by_model_day"'))).count() == n
    assert lines.rdd.getNumPartitions() > 1 or lines.count() > n


def test_sums_beyond_64_bits(spark):
    rows = [("helicone", "m", False, 1, 999_999_999_999_999_999, 5, 999_999_999_999.0)] * 12
    some = spark.createDataFrame(
        rows, "source_format string, model string, is_error boolean, n_requests bigint, input_tokens bigint, output_tokens bigint, cost_usd double")
    missing = [f for f in USAGE_SCHEMA if f.name not in some.columns]
    usage = some.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    r = compute_report(usage)
    total = r.totals.first()
    assert int(total.input_tokens) == 12 * 999_999_999_999_999_999 and total.cost_usd == pytest.approx(12e12)
    assert r.long_context_tail.first().share_of_input_tokens_in_top_1pct_requests == round(1 / 12, 4)
    assert {h.kind: h["max"] for h in r.token_histograms.collect()} == {"input": 999_999_999_999_999_999, "output": 5}


def test_empty_usage(spark):
    r = compute_report(spark.createDataFrame([], USAGE_SCHEMA))
    assert all(df.count() == 0 for df in r.tables().values())


def test_written_report_holds_no_prompt_and_no_advice(spark, folder, tmp_path):
    path = folder / "again.jsonl"
    path.write_text(samples.request_log(), encoding="utf-8")
    out = str(tmp_path / "out")
    r = analyze(spark, str(path), out=out)
    lines = [x.value for x in spark.read.text(f"{out}/report").collect()]
    assert all(list(json.loads(x)) == ["tool", "version", "at", "value"] for x in lines)
    text = "\n".join(lines)
    for prompt in samples.PROMPTS:
        assert prompt.lower() not in text.lower()
    assert '"messages"' not in text
    for name, df in r.tables().items():
        stored = spark.read.parquet(f"{out}/tables/{name}")
        assert stored.count() == df.count()
        for row in audit.leak_audit(stored, ["garden", "bakery", "ferry"]).collect():
            assert row.long_cells == 0 and row.leaking_cells == 0
    document = spark.createDataFrame([(text,)], "document string")
    assert audit.advice_cells(document).first().advising_cells == 0


def test_usage_rows_hold_no_text(spark, folder):
    path = folder / "secret.jsonl"
    secret = "the number on my card is 123-45-6789 and my mail is jane@example.com"
    path.write_text(json.dumps({"usage": {}, "prompt": secret}) + "\n", encoding="utf-8")
    row = read_usage(spark, str(path)).first()
    assert row.prompt_hash and "123-45" not in str(row) and "jane" not in str(row)


def test_rates_with_null_and_zero(spark):
    rows = [("helicone", 0, None), ("helicone", 0, None)]
    usage = spark.createDataFrame(rows, "source_format string, input_tokens bigint, output_tokens bigint")
    ranked = tokens.ranked_values(tokens.token_values(usage))
    tail = tokens.long_context_tail(ranked).first()
    assert tail.share_of_input_tokens_in_top_1pct_requests == 0.0
    out = {r.kind: r for r in tokens.token_histograms(ranked).collect()}
    assert (out["input"]["count"], out["output"]["count"], out["output"]["mean"]) == (2, 0, 0.0)


def test_ranks_over_a_wide_range(spark):
    """Two-level running counts equal a plain sort, for small, huge and negative values."""
    import random

    rng = random.Random(9)
    values = [rng.choice([rng.randint(-50, 50), rng.randint(0, 10**4), rng.randint(0, 2**40)])
              for _ in range(997)]
    usage = spark.createDataFrame([("helicone", v, None) for v in values],
                                  "source_format string, input_tokens bigint, output_tokens bigint")
    ranked = tokens.ranked_values(tokens.token_values(usage))
    got = {r.tokens: (r.at_most, r.n) for r in ranked.collect()}
    assert got == {v: (sum(x <= v for x in values), 997) for v in values}


def test_identifier_scan(spark):
    df = spark.createDataFrame(
        [("mail a@b.org or jane@example.com, key sk-abc.1", "org-12345678 org-1")], "x string, y string")
    got = {(r.column, r.kind): r.hits for r in audit.identifier_scan(df).collect()}
    assert got == {("x", "mail"): 1, ("x", "key"): 1, ("y", "organisation"): 1}


def test_scan_prunes_columns_and_keeps_sketches_out(spark, tmp_path):
    path = str(tmp_path / "usage")
    spark.createDataFrame([], USAGE_SCHEMA).write.parquet(path)
    usage = spark.read.parquet(path)
    plan = tokens.token_values(usage)._jdf.queryExecution().executedPlan().toString()
    assert "prompt_sketch" not in plan and "ReadSchema: struct<source_format:string,input_tokens" in plan
    assert "PushedFilters: [In(source_format" in plan

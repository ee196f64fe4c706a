from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

import samples
from usagelens import analyze, read_usage, supported_formats
from usagelens.plans.report import report_lines
from usagelens.schema import USAGE_COLUMNS
from usagelens.sources.detect import detect_formats
from usagelens.sources.lines import MalformedInput, malformed_lines
from usagelens.sources.readers import UnknownFormat, WrongFormat


@pytest.fixture
def save(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(text, encoding="utf-8")
        return str(path)

    return write


def test_request_log(spark, save):
    rows = read_usage(spark, save("log.jsonl", samples.request_log())).collect()
    assert len(rows) == len(samples.REQUESTS)
    assert {r.source_format for r in rows} == {"litellm_jsonl"}
    assert sum(r.is_error for r in rows) == sum(r.failed for r in samples.REQUESTS)
    assert sum(r.input_tokens for r in rows) == sum(r.tokens_in for r in samples.REQUESTS)
    assert all(r.prompt_hash and r.prompt_sketch and r.n_requests == 1 for r in rows)
    assert tuple(rows[0].asDict()) == USAGE_COLUMNS


def test_request_csv_with_json_bodies(spark, save):
    rows = read_usage(spark, save("log.csv", samples.request_csv())).collect()
    assert len(rows) == len(samples.REQUESTS)
    assert {r.source_format for r in rows} == {"helicone"}
    assert sum(r.is_error for r in rows) == sum(r.failed for r in samples.REQUESTS)
    assert len({r.prompt_hash for r in rows}) == len({r.prompt for r in samples.REQUESTS})


def test_both_logs_hash_prompts_alike(spark, save):
    log = read_usage(spark, save("log.jsonl", samples.request_log()))
    table = read_usage(spark, save("log.csv", samples.request_csv()))
    assert log.select("prompt_hash").subtract(table.select("prompt_hash")).count() == 0


def test_request_export_as_json_lines(spark, save):
    text = (
        '{"created_at":"2026-06-01T09:00:00Z","model":"gpt-4o","prompt_tokens":5,"status":500,'
        '"request_body":{"messages":[{"content":"one two three four"}]}}\n'
        '{"created_at":"2026-06-01T09:00:00Z","completion_tokens":"7","status":200,"prompt":"x y"}\n'
    )
    rows = read_usage(spark, save("e.jsonl", text), fmt="helicone").orderBy("output_tokens").collect()
    assert [(r.input_tokens, r.output_tokens, r.is_error) for r in rows] == [
        (5, None, True), (None, 7, False)]
    assert all(r.prompt_hash for r in rows)


def test_quoted_line_feeds(spark, save):
    text = 'request_id,prompt_tokens,prompt\nr1,3,"two\nlines, here"\nr2,4,plain\n'
    rows = read_usage(spark, save("m.csv", text)).orderBy("input_tokens").collect()
    assert [r.input_tokens for r in rows] == [3, 4]
    flat = read_usage(spark, save("f.csv", "request_id,prompt_tokens\nr1,3\n"), multiline=False)
    assert flat.count() == 1


def test_simple_billing(spark, save):
    rows = read_usage(spark, save("b.csv", samples.simple_billing())).collect()
    assert {r.source_format for r in rows} == {"openai_csv"}
    assert sum(r.n_requests for r in rows) == sum(b[4] for b in samples.BILLED)
    assert all(r.prompt_hash is None and r.cost_usd is None for r in rows)


def test_activity_billing(spark, save):
    rows = read_usage(spark, save("a.csv", samples.activity_billing())).collect()
    assert sum(r.n_requests for r in rows) == sum(a[4] for a in samples.ACTIVITY)
    assert {str(r.timestamp.date()) for r in rows} == {"2025-11-05", "2025-11-06", "2025-11-07"}
    assert sum(r.input_tokens or 0 for r in rows) == sum(a[2] or 0 for a in samples.ACTIVITY)
    assert sum(r.output_tokens or 0 for r in rows) == sum(a[3] or 0 for a in samples.ACTIVITY)


def test_console_billing(spark, save):
    rows = read_usage(spark, save("c.csv", samples.console_billing())).collect()
    assert {r.source_format for r in rows} == {"anthropic_csv"}
    assert sum(r.cost_usd for r in rows) == pytest.approx(sum(c[4] for c in samples.CONSOLE))
    assert sum(r.input_tokens for r in rows) == sum(c[2] for c in samples.CONSOLE)


def test_cache_columns_are_summed(spark, save):
    rows = read_usage(spark, save("u.csv", samples.cache_usage())).collect()
    assert sum(r.input_tokens for r in rows) == sum(sum(c[2:6]) for c in samples.CACHED)
    assert sum(r.output_tokens for r in rows) == sum(c[6] for c in samples.CACHED)
    assert {r.model for r in rows} == {c[1] for c in samples.CACHED}
    assert all(r.cost_usd is None for r in rows)


def test_token_costs(spark, save):
    rows = read_usage(spark, save("t.csv", samples.token_costs())).collect()
    assert sum(r.cost_usd for r in rows) == pytest.approx(sum(float(c[3]) for c in samples.COSTS))
    assert all(r.input_tokens is None and r.output_tokens is None for r in rows)


def test_mixed_folder_is_detected_per_file(spark, tmp_path, save):
    save("d/one.jsonl", "\n  \n" + samples.request_log())
    save("d/sub/two.csv", samples.activity_billing())
    save("d/three.csv", samples.token_costs())
    save("d/four.csv", samples.cache_usage())
    with gzip.open(tmp_path / "d" / "five.jsonl.gz", "wt") as f:
        f.write(samples.request_log())
    found = {r.path.rsplit("/", 1)[-1]: r.format
             for r in detect_formats(spark, [str(tmp_path / "d")]).collect()}
    assert found == {"one.jsonl": "litellm_jsonl", "two.csv": "openai_csv", "three.csv": "anthropic_csv",
                     "four.csv": "anthropic_csv", "five.jsonl.gz": "litellm_jsonl"}
    counts = dict(read_usage(spark, str(tmp_path / "d")).groupBy("source_format").count().collect())
    assert counts == {"litellm_jsonl": 2 * len(samples.REQUESTS), "openai_csv": len(samples.ACTIVITY), "anthropic_csv": len(samples.COSTS) + len(samples.CACHED)}


def test_long_first_line(spark, save):
    line = '{"messages":[{"content":"' + "word " * 40_000 + '"}],"usage":{}}\n'
    assert read_usage(spark, save("long.jsonl", line)).count() == 1


def test_unknown_file_names_the_formats(spark, save):
    with pytest.raises(UnknownFormat) as e:
        read_usage(spark, save("x.txt", "alpha,beta\n1,2\n"))
    assert all(name in str(e.value) for name in supported_formats())


def test_unknown_forced_format(spark, save):
    with pytest.raises(UnknownFormat):
        read_usage(spark, save("b.csv", samples.simple_billing()), fmt="other")


def test_forced_format(spark, save):
    assert read_usage(spark, save("b.csv", samples.simple_billing()), fmt="openai_csv").count() == len(samples.BILLED)


def test_malformed_lines_are_listed_or_raise(spark, save):
    good = samples.request_log().splitlines()
    path = save("cut.jsonl", f'{good[0]}\n\n{good[1]}\n{{"messages": [{{"role": "us\n["a", {{}}]\n{good[2]}\n')
    assert read_usage(spark, path).count() == 3
    bad = malformed_lines(spark, [path]).orderBy("line_no").collect()
    assert [(r.line_no, r.reason) for r in bad] == [(4, "malformed JSON"), (5, "expected a JSON object")]
    with pytest.raises(MalformedInput) as e:
        read_usage(spark, path, strict=True)
    assert "line 4" in str(e.value) and "cut.jsonl" in str(e.value)
    assert "messages" not in str(e.value)


def test_line_numbers_across_splits(spark, save):
    """A file read in many splits keeps its line numbers."""
    want, rows = [], []
    for i in range(1, 4001):
        rows.append('{"cut' if i % 997 == 0 else "" if i % 5 == 0 else f'{{"usage": {{}}, "n": {i}}}')
        if i % 997 == 0:
            want.append(i)
    path = save("big.jsonl", "\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        assert spark.read.text(path).select(F.spark_partition_id()).distinct().count() > 3
        got = [r.line_no for r in malformed_lines(spark, [path]).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want


def test_undecodable_bytes_are_dropped(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_bytes(b'{"usage": {}, "model": "gp\xfft"}\n')
    assert read_usage(spark, str(path)).first().model == "gpt"
    csv_path = tmp_path / "b.csv"
    csv_path.write_bytes(b"input_tokens,output_tokens,model\n1,2,gp\xfft\n")
    assert read_usage(spark, str(csv_path)).first().model == "gpt"


def test_odd_values_in_a_log_line(spark, save):
    text = (
        '{"usage": [1], "prompt_tokens": "1,200", "cost": "$0.5", "status": 500, "model": "m"}\n'
        '{"usage": {"prompt_tokens": null}, "prompt_tokens": 7, "prompt": 5, "input": "hidden"}\n'
        '{"usage": null, "startTime": "", "timestamp": 1745366400, "prompt": "", "input": "seen text"}\n'
    )
    rows = read_usage(spark, save("odd.jsonl", text)).orderBy(F.col("input_tokens").desc()).collect()
    assert [r.input_tokens for r in rows] == [1200, 7, None]
    assert rows[0].cost_usd == 0.5 and rows[0].status == "500" and not rows[0].is_error
    assert rows[1].prompt_hash is None
    assert rows[2].prompt_hash and str(rows[2].timestamp) == "2025-04-23 00:00:00"


@pytest.mark.parametrize("name", ["a b.jsonl", "a[1].jsonl", "50%#+{x}.jsonl", "q?*.jsonl", "ü é.jsonl"])
def test_file_names_are_taken_as_they_are(spark, save, name):
    folder = save(f"odd/{name}", samples.request_log()).rsplit("/", 1)[0]
    save("odd/a1.csv", samples.simple_billing())
    counts = dict(read_usage(spark, folder).groupBy("source_format").count().collect())
    assert counts == {"litellm_jsonl": len(samples.REQUESTS), "openai_csv": len(samples.BILLED)}


def test_heads_hold_no_values(spark, save):
    path = save("h.jsonl", '{"usage": {"prompt_tokens": 77123}, "prompt": "secret words", "messages": [{"content": "more"}]}\n')
    head = detect_formats(spark, [path]).first().head
    assert not any(w in head for w in ("secret", "more", "77123"))


def test_wrong_forced_format_raises(spark, save):
    with pytest.raises(WrongFormat):
        read_usage(spark, save("b.csv", samples.simple_billing()), fmt="litellm_jsonl")
    with pytest.raises(WrongFormat):
        read_usage(spark, save("l.log", samples.request_log()), fmt="openai_csv")


def test_json_lines_by_content_not_by_name(spark, save):
    text = '{"request_id": "a", "prompt_tokens": 4}\n{"request_id": "b", "prompt_tokens": 5, "prompt_tokens": 6}\n'
    rows = read_usage(spark, save("export.log", text))
    assert sorted((r.source_format, r.input_tokens) for r in rows.collect()) == [("helicone", 4), ("helicone", 6)]
    assert read_usage(spark, save("export.json", text), fmt="helicone").count() == 2


def test_report_lists_lines_left_out(spark, save):
    good = samples.request_log().splitlines()
    path = save("some.jsonl", f"{good[0]}\n{{\n[7]\n\n{good[1]}\n{{]\n")
    report = analyze(spark, path)
    got = sorted((r.source_format, r.line_no, r.reason) for r in report.malformed.collect())
    assert got == [("litellm_jsonl", 2, "malformed JSON"), ("litellm_jsonl", 3, "expected a JSON object"), ("litellm_jsonl", 6, "malformed JSON")]
    lines = report_lines(report).where("metric = 'malformed_lines'").collect()
    assert {r.key: '"lines":2' in r.value for r in lines} == {"malformed JSON": True, "expected a JSON object": False}
    with pytest.raises(MalformedInput):
        analyze(spark, path, strict=True)


def test_empty_file(spark, save):
    path = save("empty.csv", "")
    with pytest.raises(UnknownFormat):
        read_usage(spark, path)
    assert read_usage(spark, path, fmt="openai_csv").count() == 0

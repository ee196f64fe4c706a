"""Reports of single files and of files without rows, JSON documents, keys in any case, fragments of prompts."""

from __future__ import annotations

import glob
import json
import random

import pytest

import samples
from pyspark.sql import functions as F
from usagelens import analyze, read_usage
from usagelens.operators import fragments
from usagelens.operators.availability import METRICS, REASON
from usagelens.plans.document import PRIVACY
from usagelens.plans.report import report_lines

EMPTY = {
    "helicone": "request_id,prompt_tokens,request_body\n", "openai_csv": "n_context_tokens_total,num_requests\n",
    "anthropic_csv": "usage_date_utc,input_tokens\n",
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_an_export_without_rows_is_reported(spark, tmp_path, name):
    (tmp_path / "e.csv").write_text(EMPTY[name])
    report = analyze(spark, str(tmp_path))
    total = report.totals.collect()
    assert [(r.source_format, r.requests, r.input_tokens, r.output_tokens, r.cost_usd) for r in total] == [(name, 0, 0, 0, None)]
    states = {r.metric: (r.status, r.reason) for r in report.availability.collect()}
    computed = {"error_rate"} if name == "helicone" else set()
    assert states == {m: ("computed", None) if m in computed else ("unavailable", REASON) for m in METRICS}
    rates = [(r.total_requests, r.error_requests, r.error_rate) for r in report.error_rate.collect()]
    assert rates == ([(1, 0, 0.0)] if name == "helicone" else [])


def documents_of(folder):
    """The JSON documents under a report's folder: the text parts of each source, one after the other."""
    out = {}
    for own in {p.rsplit("/", 1)[0] for p in glob.glob(f"{folder}/documents/**/part-*", recursive=True)}:
        text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{own}/part-*")))
        data = json.loads(text)
        out[data["report"]["source_format"], data["report"].get("source_file", "").rsplit("/", 1)[-1]] = data
    return out


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    lines = samples.request_log().splitlines()
    (folder / "one.jsonl").write_text("\n".join(lines[:5]) + "\n{broken\n")
    (folder / "two.jsonl").write_text("\n".join(lines[5:]) + "\n")
    (folder / "bill.csv").write_text(samples.simple_billing())
    (folder / "none.csv").write_text(EMPTY["helicone"])
    return folder


def test_documents_of_formats(spark, exports, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        report = analyze(spark, str(exports), out=str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    found = documents_of(tmp_path / "out")
    assert {k[0] for k in found} == {"litellm_jsonl", "openai_csv", "helicone"}
    values = {}
    for r in report_lines(report).orderBy("source_format", "metric", "key").collect():
        values.setdefault((r.source_format, r.metric), []).append(json.loads(r.value))
    for (name, _), data in found.items():
        assert list(data) == ["tool", "version", "privacy", "report"] and data["privacy"] == PRIVACY
        own = data["report"]
        assert list(own) == ["source_format", "totals", "metrics"] and list(own["metrics"]) == list(METRICS)
        line = values[name, "report"][0]
        assert own["totals"] == line["totals"]
        for metric, m in own["metrics"].items():
            if m["status"] == "unavailable":
                assert m == line["metrics"][metric] == {"status": "unavailable", "reason": REASON}
                continue
            listed = values.get((name, metric))
            if metric in ("duplicate_prompts", "error_rate", "long_context_tail"):
                assert [m["value"]] == listed
            elif metric == "spend_by_model_day":
                assert m["value"] == listed
            elif metric == "token_histograms":
                assert [{"kind": k, **v} for k, v in m["value"].items()] == listed
            elif metric == "temporal_patterns":
                want = {"by_day": values[name, "by_day"]}
                if name != "openai_csv":
                    want["by_hour"] = values[name, "by_hour"]
                assert m["value"] == want
            else:
                models = {}
                for t in values[name, "tier_models"]:
                    models.setdefault(t["tier"], []).append(t["model"])
                assert [{k: v for k, v in t.items() if k != "models"} for t in m["value"]] == listed
                assert {t["tier"]: t["models"] for t in m["value"]} == models


def test_reports_of_files(spark, exports, tmp_path):
    report = analyze(spark, str(exports), out=str(tmp_path / "out"), by_file=True)
    file = lambda r: r.source_file.rsplit("/", 1)[-1]
    requests = {(r.source_format, file(r)): r.requests for r in report.totals.collect()}
    billed = sum(b[4] for b in samples.BILLED)
    assert requests == {
        ("litellm_jsonl", "one.jsonl"): 5, ("litellm_jsonl", "two.jsonl"): len(samples.REQUESTS) - 5,
        ("openai_csv", "bill.csv"): billed, ("helicone", "none.csv"): 0}
    assert {(r.source_format, file(r)) for r in report.spend_by_model_day.collect()} == set(requests) - {("helicone", "none.csv")}
    assert [(file(r), r.reason) for r in report.malformed.collect()] == [("one.jsonl", "malformed JSON")]
    found = documents_of(tmp_path / "out")
    assert {k: d["report"]["totals"]["requests"] for k, d in found.items()} == requests
    lines = report_lines(report).where("metric = 'malformed_lines'").collect()
    assert [file(r) for r in lines] == ["one.jsonl"]


def test_keys_in_any_case_in_the_order_of_the_line(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text(
        '{"Request_ID": "a", "PROMPT_TOKENS": 4, "Model": "first", "MODEL": "last", "STATUS": 500, "prompt_Tokens": null}\n'
        '{"request_id": "b", "prompt_tokens": 3, "MODEL": "x", "model": "", "Created": "2026-06-01"}\n'
    )
    rows = read_usage(spark, str(tmp_path / "k.jsonl")).orderBy("model").collect()
    assert [(r.model, r.input_tokens, r.is_error) for r in rows] == [(None, 3, False), ("last", None, True)]
    assert str(rows[0].timestamp) == "2026-06-01 00:00:00"


def test_every_fragment_of_any_prompt_is_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij é", k=rng.randint(2, 9)))
    prompts = [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(60)] + ["", None, "short"]
    squeezed = [" ".join((p or "").split()) for p in prompts]
    cells, want = [], set()
    for i, p in enumerate(squeezed):
        at = rng.randint(0, max(0, len(p) - 31))
        if len(p) >= 40:
            cells.append((f"hit{i}", "zz" * rng.randint(0, 300) + p[at : at + 31].strip().upper().ljust(31, p[(at + 31) % len(p)]) + "q!"))
            if len(p[at : at + 31].strip()) == 31:
                want.add(f"hit{i}")
        cells.append((f"miss{i}", p[at : at + 15]))
    cells += [("null", None), ("empty", ""), ("other", "Q" * 5000)]
    frame = spark.createDataFrame(cells, "cell string, text string")
    text = spark.createDataFrame([(p,) for p in prompts], "text string")
    got = {r["cell"] for r in fragments.fragment_hits(text, frame).collect()}
    assert want <= got and len(want) > 20 and not any(c.startswith(("miss", "null", "empty", "other")) for c in got)


def test_fragments_are_compared_by_short_digests(spark):
    plan = fragments.fragment_hits(
        spark.createDataFrame([("a" * 40,)], "text string"), spark.createDataFrame([("c", "a" * 20)], "cell string, text string")
    )._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unhex(sha2(") >= 2  # 16 bytes a block are sent, not 64 characters
    digest = spark.createDataFrame([("x" * 16,)], "b string").select(fragments._digest(F.col("b"), "s").alias("d")).first()["d"]
    assert len(digest) == 16


def test_blocks_of_long_cells_are_those_of_all_places(spark):
    text = "".join(random.Random(1).choices("abc", k=1500))
    got = spark.createDataFrame([(text,)], "t string").select(fragments.cell_blocks("t", 16).alias("b")).first()["b"]
    assert set(got) == {text[i : i + 16] for i in range(len(text) - 15)}


def test_strings_of_a_report_line(spark):
    value = {"a": "plain", "b": ["x\"y", "\\", "é\n"], "c": {"d": "z" * 250}, "n": 5, "o": None}
    row = spark.createDataFrame([("m", "key", json.dumps(value))], "metric string, key string, value string")
    got = {r.text for r in fragments.report_cells(row).collect()}
    assert got == {"key", "a", "b", "c", "d", "n", "o", "plain", "x\"y", "\\", "é\n", "z" * 250}
    audit = fragments.fragment_audit(spark.createDataFrame([("no " * 9 + "z" * 250,)], "text string"), fragments.report_cells(row)).first()
    assert (audit.long_cells, audit.leaking_cells) == (1, 1)

from __future__ import annotations

import pytest

import samples
from usagelens import read_usage
from usagelens.streaming.ingest import append_usage, spend_windows, stream_request_log, undated_spend


def test_stream_appends_each_line_once(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "usage", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(samples.request_log() + "{broken\n")
    append_usage(stream_request_log(spark, source), table, state).awaitTermination()
    assert spark.read.parquet(table).count() == len(samples.REQUESTS)
    (tmp_path / "in" / "b.jsonl").write_text(samples.request_log())
    append_usage(stream_request_log(spark, source), table, state).awaitTermination()
    assert spark.read.parquet(table).count() == 2 * len(samples.REQUESTS)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_spend_windows_close_with_the_watermark(spark, tmp_path, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _spend_windows(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_rows_without_a_time(spark, tmp_path):
    path = tmp_path / "u.jsonl"
    path.write_text('{"usage": {"prompt_tokens": 3}}\n' * 2 + samples.request_log())
    got = undated_spend(read_usage(spark, str(path))).collect()
    assert [(r.day, r.n_requests, r.input_tokens) for r in got] == [("unknown", 2, 6)]


def _spend_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(samples.request_log())
    spend = spend_windows(stream_request_log(spark, str(tmp_path / "in")), "0 seconds")
    q = (
        spend.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    days = {r.day for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    every = sorted({r.time[:10] for r in samples.REQUESTS})
    assert days == set(every[:-1])

"""CSV with line feeds in cells, read in splits; long JSON strings; bytes that are no UTF-8."""

from __future__ import annotations

import csv
import io
import random
from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from usagelens import read_usage
from usagelens.sources import csv_records
from usagelens.sources.lines import malformed_lines, read_lines
from usagelens.sources.readers import read_csv


@contextmanager
def splits_of(spark, size):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def odd_csv(seed, rows=120, newline="\n"):
    """Cells with quotes, doubled quotes, commas and line feeds, some longer than several splits."""
    rng = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=newline)
    writer.writerow(["id", "text", "more"])
    for i in range(rows):
        cell = "".join(rng.choices(["a", "b ", '"', '""', ",", newline, "\n", "é", "{\"k\": \"v\"}"], k=rng.choice([0, 1, 3, 20, 150])))
        writer.writerow([i, cell, rng.choice(["", "x", 'q"', "\n", '",', "y,z"])])
        if rng.random() < 0.1:
            out.write(newline)
    return out.getvalue()


def plain(text):
    return Counter(tuple(c or None for c in r) for r in list(csv.reader(io.StringIO(text, newline="")))[1:] if r)


@pytest.mark.parametrize("size", [37, 61, 256, 100_000])
@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_splits_give_the_records_of_the_whole_file(spark, tmp_path, size, newline):
    text = odd_csv(size, newline=newline)
    path = tmp_path / "odd.csv"
    path.write_bytes(text.encode())
    with splits_of(spark, size):
        if size < 100 and newline != "\r":
            assert csv_records.physical_lines(spark, [str(path)]).select("split").distinct().count() > 20
        got = Counter(tuple(r) for r in read_csv(spark, [str(path)], header="id,text,more").select("id", "text", "more").collect())
    assert got == plain(text)


def test_equal_to_the_reader_of_whole_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(odd_csv(5))
    (tmp_path / "b.csv").write_text(odd_csv(6, rows=3))
    (tmp_path / "c.csv").write_text("id,text,more\n")
    paths = [str(tmp_path / f"{n}.csv") for n in "abc"]
    whole = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(paths)
    with splits_of(spark, 50):
        got = read_csv(spark, paths)
        assert got.columns == ["id", "text", "more", "source_file"]
        rows = Counter(tuple(r) for r in got.drop("source_file").collect())
        files = dict(got.groupBy(F.element_at(F.split("source_file", "/"), -1).alias("f")).count().collect())
    assert rows == Counter(tuple(r) for r in whole.collect()) and files == {"a.csv": 120, "b.csv": 3}


def test_quotes_that_open_nothing(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,text,more\n1,5" disk,x\n2,"a" b"c,y\n3,"open\nto the ""end"""z,"w"\n4,say "hi\n')
    with splits_of(spark, 9):
        got = sorted(tuple(r)[:1] for r in read_csv(spark, [str(path)]).select("id").collect())
    assert got == [("1",), ("2",), ("3",), ("4",)]


def test_states_compose():
    rng = random.Random(0)
    import numpy as np

    f0, f1 = (np.array([rng.random() < 0.5 for _ in range(200)]) for _ in range(2))
    for start in (False, True):
        want, now = [], start
        for a, b in zip(f0, f1):
            now = bool(b if now else a)
            want.append(now)
        assert csv_records.states(f0, f1, start).tolist() == want


def test_long_strings_of_a_log_line_count(spark, tmp_path):
    long = "word " * 5_000_000
    path = tmp_path / "long.jsonl"
    line = '{"usage": {"prompt_tokens": 7}, "model": "m", "response_cost": 0.5, "messages": [{"content": "%s"}]}\n'
    path.write_text(line % long + line % "short" + '{"usage": "' + "x" * 21_000_000 + "\n")
    rows = read_usage(spark, str(path))
    assert rows.agg(F.sum("input_tokens"), F.sum("cost_usd"), F.count("prompt_hash")).first() == (14, 1.0, 2)
    assert [(r.line_no, r.reason) for r in malformed_lines(spark, [str(path)]).collect()] == [(3, "malformed JSON")]


BROKEN = [
    b"plain", "a � mark".encode(), b"gp\xfft", "� beside é".encode() + b"\xff\xc3", b"\xef\xbf" + "�!".encode(),
    b"\x01E\x01F\xff\x01", b"\xf0\x9f\x98", b"\xed\xa0\x80z", b"\xc0\xafx", "�".encode() * 3 + b"\xe2\x82",
]


def test_broken_bytes_are_dropped_and_marks_stay(spark, tmp_path):
    path = tmp_path / "b.txt"
    path.write_bytes(b"\n".join(BROKEN) + b"\n")
    got = Counter(r["line"] for r in read_lines(spark, [str(path)]).select("line").collect())
    assert got == Counter(b.decode("utf-8", "ignore") for b in BROKEN)
    table = tmp_path / "b.csv"
    table.write_bytes(b"input_tokens,output_tokens,model\n" + b"".join(b"1,2,%s\n" % b for b in BROKEN))
    models = Counter(r["model"] for r in read_usage(spark, str(table)).select("model").collect())
    assert models == Counter(b.decode("utf-8", "ignore") or None for b in BROKEN)


def test_files_without_line_feeds_in_cells_are_read_line_by_line(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("\n\nid,text\n" + "".join(f'{i},"q ""{i}"", x"\r\n\n' for i in range(50)))
    (tmp_path / "odd.csv").write_text('id,text\n1,"a\nb"\n2,c\n')
    paths = [str(tmp_path / f) for f in ("plain.csv", "odd.csv")]
    found = csv_records.continued_files(csv_records._rows(spark, paths))
    assert [f.rsplit("/", 1)[1] for f in found] == ["odd.csv"]
    with splits_of(spark, 100):
        rows = {(r["id"], r["text"]) for r in read_csv(spark, paths, header="id,text").collect()}
        records = csv_records.records(spark, paths[:1])
    assert rows == {(str(i), f'q "{i}", x') for i in range(50)} | {("1", "a\nb"), ("2", "c")}
    assert records._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one scan more than the look at quotes

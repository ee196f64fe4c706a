"""CSV records with line feeds in cells, read in splits of a file.

A physical line starts either a record or inside a quoted cell, and whether the next line starts inside one is a
function of that: one bit for each of the two cases. In files where no line opens a cell that the next one
continues, each line is a record, whatever its split. In the others splits compose the functions of their lines, a
scan over the splits of a file picks the case each split really starts in, and with it every split
cuts its lines into records in the order it reads them. A record that crosses a split is put together
from its parts, of which a split has at most two.

The state of a split is kept by the driver and sent to tasks only for splits that start inside a
cell: a few numbers a split, fewer than the scan itself keeps of each.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.coerce import drop_undecodable
from usagelens.sources.lines import literal_paths

BATCH_ROWS = 4096
BYTE_ORDER_MARK = "﻿"
SPLIT = "file string, split bigint, in_cell_from_start boolean, in_cell_from_cell boolean, reaches boolean"
RECORDS = "file string, split bigint, chain bigint, whole boolean, record string"


def _ends_in_cell(line: Column, starts_in_cell: bool) -> Column:
    """Whether the line after ``line`` starts inside a quoted cell.

    Doubled quotes do not change that. Of the quotes left, one opens a cell if it is the first mark of
    the cell, one inside a quoted cell closes it, and others are part of their cell.
    """
    single = F.replace(line, F.lit('""'), F.lit(""))
    parts = F.split(F.concat(F.lit(","), single), '"', -1)
    before = F.slice(parts, F.lit(1), F.size(parts) - 1)
    scanned = F.aggregate(
        before, F.lit(starts_in_cell), lambda inside, part: ~inside & F.endswith(part, F.lit(","))
    )
    return F.when(F.contains(line, F.lit('"')), scanned).otherwise(F.lit(starts_in_cell))


def _rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, split, value): what stands between line feeds."""
    return spark.read.option("lineSep", "\n").text(literal_paths(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        drop_undecodable(F.col("value")).alias("value"),
    )


def _at_returns() -> Column:
    parts = F.split("value", "\r", -1)
    return F.when(F.contains("value", F.lit("\r")), parts).otherwise(F.array("value"))


def physical_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, split, line, cr, from_start, from_cell) in the order of each split; a line ends at LF or CR."""
    return _states_of(_rows(spark, paths))


def _states_of(rows: DataFrame) -> DataFrame:
    cut = _at_returns()
    lines = rows.select("file", "split", F.posexplode(cut).alias("at", "line"), F.size(cut).alias("n"))
    lines = lines.select("file", "split", "line", (F.col("at") < F.col("n") - 1).alias("cr"))
    return lines.select(
        "*", _ends_in_cell(F.col("line"), False).alias("from_start"), _ends_in_cell(F.col("line"), True).alias("from_cell")
    )


def states(from_start: np.ndarray, from_cell: np.ndarray, start: bool) -> np.ndarray:
    """The state after each line, when the first of them starts in ``start``."""
    n = len(from_start)
    fixed, flip = from_start == from_cell, from_start & ~from_cell
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))
    flips = np.cumsum(flip)
    base = np.where(last >= 0, from_start[last], start)
    since = flips - np.where(last >= 0, flips[last], 0)
    return base ^ (since % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Runs of one file and split."""
    file, split = batch.column(0), batch.column(1).to_numpy()
    codes = file.dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(split) != 0)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows]):
        if b > a:
            yield file[int(a)].as_py(), int(split[a]), batch.slice(int(a), int(b - a))


def split_states(lines: DataFrame) -> DataFrame:
    """Per split, the state it ends in from either start, and whether a record ends in it when it starts inside a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SPLIT.split(", ")]

        def row(key, s, c, reaches) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([s]), pa.array([c]), pa.array([reaches])], names=names
            )

        now, s, c, reaches = None, False, True, False
        for batch in batches:
            for file, split, part in _runs(batch):
                if (file, split) != now:
                    if now:
                        yield row(now, s, c, reaches)
                    now, s, c, reaches = (file, split), False, True, False
                f0, f1 = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                s, inside = bool(states(f0, f1, s)[-1]), states(f0, f1, c)
                reaches = reaches or not inside.all()
                c = bool(inside[-1])
        if now:
            yield row(now, s, c, reaches)

    return lines.select("file", "split", "from_start", "from_cell").mapInArrow(run, SPLIT)


def starts_inside(found) -> dict[tuple[str, int], int]:
    """For each split that starts inside a cell, the split in which that record begins."""
    files = defaultdict(list)
    for r in found:
        files[r["file"]].append(r)
    out: dict[tuple[str, int], int] = {}
    for file, splits in files.items():
        inside, chain = False, 0
        for r in sorted(splits, key=lambda r: r["split"]):
            if inside:
                out[file, r["split"]] = chain
            ends = r["in_cell_from_cell"] if inside else r["in_cell_from_start"]
            if ends and (not inside or r["reaches"]):
                chain = r["split"]
            inside = ends
    return out


def continued_files(rows: DataFrame) -> list[str]:
    """Files with a line that starts outside a cell and ends inside one. Only lines with quotes are looked at."""
    lines = _states_of(rows.where(F.contains("value", F.lit('"'))))
    return [r["file"] for r in lines.where("from_start").select("file").distinct().collect()]


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, record) of every record but a file's first, its header. Empty lines are no records."""
    rows = _rows(spark, paths)
    continued = continued_files(rows)
    if not continued:
        return _line_records(rows)
    own = F.col("file").isin(continued)
    return _line_records(rows.where(~own)).unionByName(_joined_records(_states_of(rows.where(own))))


def _line_records(rows: DataFrame) -> DataFrame:
    """Records of files whose every line is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, header = None, False
        for batch in batches:
            for file, split, part in _runs(batch):
                if (file, split) != now:
                    now, header = (file, split), split == 0
                yield part.slice(1 if header else 0).select(["file", "record"])
                header = False

    lines = rows.select("file", "split", F.explode(_at_returns()).alias("record"))
    return lines.where("record <> ''").mapInArrow(run, "file string, record string")


def _joined_records(lines: DataFrame) -> DataFrame:
    """Records of files in which some go on after a line's end."""
    spark = lines.sparkSession
    inside = spark.sparkContext.broadcast(starts_inside(split_states(lines).collect()))  # a few numbers a split

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["file", "split", "chain", "whole", "record"]
            )

        now, state, chain, held, header = None, False, None, [], False

        def ended(cut: bool) -> None:
            """The lines held are a record, or the part of one that its split has."""
            nonlocal chain, header
            record = "".join(held)
            if record.rstrip("\r\n") or cut or chain is not None:
                if not header:
                    out.append((*now, now[1] if chain is None else chain, not cut and chain is None, record))
                header = False
            held.clear()
            chain = None

        for batch in batches:
            for file, split, part in _runs(batch):
                if (file, split) != now:
                    if held:
                        ended(True)
                    now, header = (file, split), split == 0
                    chain = inside.value.get(now)
                    state = chain is not None
                after = states(*(part.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)), state)
                for line, cr, open_ in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), after.tolist()):
                    held.append(line + ("\r" if cr else "\n"))
                    if not open_:
                        ended(False)
                        if len(out) >= BATCH_ROWS:
                            yield flushed()
                state = bool(after[-1])
        if held:
            ended(True)
        if out:
            yield flushed()

    cut = lines.mapInArrow(run, RECORDS)
    piece = F.struct("split", "record")
    crossing = cut.where("not whole").groupBy("file", "chain").agg(F.sort_array(F.collect_list(piece)).alias("parts"))
    # Without its first part it is a header that crosses a split.
    crossing = crossing.where(F.col("parts")[0]["split"] == F.col("chain"))
    joined = crossing.select("file", F.array_join(F.col("parts.record"), "").alias("record"))
    every = cut.where("whole").select("file", "record").unionByName(joined)
    return every.select("file", F.rtrim("record", F.lit("\r\n")).alias("record"))


def header_names(header: str) -> list[str]:
    return next(csv.reader([header.removeprefix(BYTE_ORDER_MARK)]), [])


def read_cells(spark: SparkSession, paths: list[str], header: str) -> DataFrame:
    """The cells of files with this header, as text; of columns with one name the last is read."""
    names = header_names(header)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.from_csv("record", schema, {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    last = {name.strip().lower(): i for i, name in enumerate(names)}
    parsed = records(spark, paths).select("file", cells.alias("cells"))
    return parsed.select(
        *(F.col(f"cells.c{i}").alias(names[i]) for i in sorted(last.values())), F.col("file").alias("source_file")
    )

"""Token counts by separator scan over flat token files without an index.

A token file is a run of unsigned 16- or 32-bit ids in which an end-of-document id closes each
document, and nothing else. Its byte ranges, of fixed size and without regard to documents, are read in
tasks. Each block is searched with one vectorised comparison; it yields its separators' positions and
the tokens after its last one. A prefix scan over the blocks of a file, which carries a few numbers a block, then gives
each block the number of documents before it and the tokens that an unfinished document has gathered, and
with them each document's number and length.

Edge cases: a file without a separator, and tokens after the last separator, are one unfinished
document with ``closed`` false; empty files and tables give no rows; a document may span any number
of blocks; a null text is written as its separator alone; repeated rows are written twice; other columns are
not looked at. Files lie in the shared folder, which must be one that ``pyarrow`` can open; a task names its files at
random, and only those it reports are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.token_files import file_system
from usagelens.llm.tokens import token_ids
from usagelens.storage import scratch_path, written

BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 27  # a file is closed after the document that reaches this
SEPARATOR = 65535  # an id that no text yields: the vocabulary, with its added token, ends at 50256
WRITTEN = "file string, number bigint, doc_id bigint"
BATCH_ROWS = 1 << 15
BLOCKS = "file string, block bigint, begin bigint, bytes bigint"
FOUND = "file string, block bigint, tokens bigint, ends array<bigint>"


def _ranges(files: DataFrame, width: int, block_tokens: int) -> DataFrame:
    """Blocks of ``files`` (file, length), dealt out evenly."""
    step = block_tokens * width
    begin = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(step).cast("bigint")))
    cut = files.where("length > 0").select("file", "length", begin.alias("begin"))
    block = (F.col("begin") / step).cast("bigint")
    rows = cut.select("file", block.alias("block"), "begin", F.least(F.lit(step), F.col("length") - F.col("begin")).alias("bytes"))
    return rows.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "file", "block")


def file_blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Byte ranges of the flat files under ``path``; listing reads no content."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    return _ranges(files, width, block_tokens)


def write_tokens(docs: DataFrame, ranks: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write flat files of the tokens of ``docs``; the stored list of documents by file and number in it.

    The files themselves hold ids alone.
    """
    folder = scratch_path(docs.sparkSession, "flat-tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fs, out, rows = TaskContext.get().partitionId(), None, None, []
        path, number, size, files = "", 0, 0, 0

        def listed() -> pa.RecordBatch:
            file, n, doc = zip(*rows)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(file), pa.array(n, pa.int64()), pa.array(doc, pa.int64())], names=["file", "number", "doc_id"]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if out is None:
                    path = f"{folder}/part-{part:06d}-{files:05d}-{uuid.uuid4().hex}.bin"
                    fs, name = file_system(path)
                    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out, number, size, files = fs.open_output_stream(name, compression=None), 0, 0, files + 1
                ids = token_ids(text.as_py(), ranks, SEPARATOR, encode_special_tokens=False).astype("<u2")
                out.write(ids.tobytes())
                rows.append((path, number, doc.as_py()))
                number, size = number + 1, size + len(ids)
                if size >= file_tokens:
                    out.close()
                    out = None
                if len(rows) >= BATCH_ROWS:
                    yield listed()
        if out is not None:
            out.close()
        if rows:
            yield listed()

    return written(docs.select("doc_id", "text").mapInArrow(run, WRITTEN), "flat-documents")


def _with_lengths(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, name = file_system(file)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([fs.get_file_info(name).size], pa.int64())], names=["file", "length"]
                )

    return files.mapInArrow(run, "file string, length bigint")


def block_ends(blocks: DataFrame, end_id: int = SEPARATOR, width: int = 2) -> DataFrame:
    """Per block: its number of tokens and the positions just after its separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, begin, size in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = file_system(file)
                with fs.open_input_file(name) as source:
                    source.seek(begin)
                    ids = np.frombuffer(source.read(size), dtype=f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()),
                     pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "block", "tokens", "ends"],
                )

    return blocks.mapInArrow(run, FOUND)


def document_lengths(found: DataFrame) -> DataFrame:
    """Stitch blocks: (file, number, tokens, closed) for each document of each file.

    ``tokens`` counts the separator. The scan over a file's blocks carries their sums alone.
    """
    found = written(found, "block-ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    f = found.select("file", "block", "tokens", F.size("ends").alias("closes"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    f = f.withColumn("stop", F.sum("tokens").over(upto))
    f = f.withColumn("begin", F.col("stop") - F.col("tokens")).withColumns({
        "earlier": F.coalesce(F.sum("closes").over(before), F.lit(0)),
        "open": F.coalesce(F.max(F.col("begin") + F.col("last")).over(before), F.lit(0)),
        "final": F.lead("block").over(upto).isNull(),
    })
    f = f.join(found.select("file", "block", "ends"), ["file", "block"])
    edges = F.transform("ends", lambda e: e + F.col("begin"))
    docs = F.transform(edges, lambda e, i: F.struct(
        (F.col("earlier") + i).alias("number"),
        (e - F.when(i == 0, F.col("open")).otherwise(F.get(edges, i - 1))).alias("tokens"),
        F.lit(True).alias("closed"),
    ))
    end = F.coalesce(F.col("begin") + F.col("last"), F.col("open"))
    rest = F.when(F.col("final") & (F.col("stop") > end), F.array(F.struct(
        (F.col("earlier") + F.col("closes")).alias("number"), (F.col("stop") - end).alias("tokens"), F.lit(False).alias("closed"),
    ))).otherwise(F.array().cast("array<struct<number:bigint,tokens:bigint,closed:boolean>>"))
    return f.select("file", F.explode(F.concat(docs, rest)).alias("d")).select("file", "d.*")


def count_tokens(
    docs: DataFrame, ranks: str | None = None, block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Write the flat files of ``docs``, scan them, and give (doc_id, tokens, file, number)."""
    names = write_tokens(docs, ranks, file_tokens)
    files = _with_lengths(names.select("file").distinct())
    lengths = document_lengths(block_ends(_ranges(files, 2, block_tokens)))
    return lengths.join(names, ["file", "number"]).select("doc_id", "tokens", "file", "number")

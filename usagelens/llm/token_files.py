"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of frames that each decompress on their own, one a document (a document of more than
``FRAME_IDS`` ids takes several), holding ids as little-endian unsigned 32-bit numbers. After them
comes a directory frame: for each document its id, whether the id is null, and its number of frames.
The file ends with a skippable frame, the seek table: compressed size, decompressed size and checksum
(low half of the XXH64 of the decompressed bytes) of every frame, then the number of frames, a flag
byte and a magic number. Any zstandard decoder can read a file from front to back; a reader that
knows the table reads the tail, then only the frames of the documents asked for, and checks each.

Documents are written in ascending order of their ids, null first: rows go to ranges of (id, text) and
each range to files of its own. A task names its files at random and reports them as rows; the table
of these rows is the list of files, so files of failed or repeated tasks are never read.

Edge cases: a null text is empty and holds the end id alone; an empty table gives an empty list and no
documents; rows that share an id are ordered by their text, equal rows are all written; other columns are not
looked at; a text of any length is one document. A frame whose bytes do not fit its checksum raises. Files lie
in the shared folder, which must be one that ``pyarrow`` can open.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.tokens import token_ids
from usagelens.storage import scratch_path, written

END = 2
FRAME_IDS = 1 << 22
FILE_IDS = 1 << 26  # a file is closed after the document that reaches this
READ_IDS = 1 << 22  # ids read by one unit of work
BATCH_BYTES = 4 << 20
LEVEL = 3
# Fixed values of the seekable zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80

FILES = "part int, number int, path string, documents bigint, ids bigint, least bigint, greatest bigint, nulls bigint"
READ = "doc_id bigint, start bigint, ids binary"


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileWriter:
    """Frames to a stream that only needs ``write``."""

    def __init__(self, out, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        self.out, self.frame_bytes = out, 4 * frame_ids
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.table: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, bool, int]] = []
        self.ids = 0

    def _frame(self, data: bytes) -> None:
        packed = self.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), checksum(data)))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data, before = ids.tobytes(), len(self.table)
        for i in range(0, max(1, len(data)), self.frame_bytes):
            self._frame(data[i : i + self.frame_bytes])
        self.documents.append((doc_id or 0, doc_id is None, len(self.table) - before))
        self.ids += len(ids)

    def close(self) -> None:
        names, nulls, frames = zip(*self.documents) if self.documents else ((), (), ())
        self._frame(b"".join((np.array(names, "<i8").tobytes(), np.array(nulls, "u1").tobytes(), np.array(frames, "<u4").tobytes())))
        table = np.array(self.table, "<u4").tobytes()
        tail = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(tail)) + table + tail)


class FileReader:
    """Documents of a file that can ``seek`` and ``read``; frames are read when asked for."""

    def __init__(self, file):
        self.file = file
        self.loaded, self.begin = b"", 0
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = file.seek(0, 2)
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a file with a seek table and checksums")
        self.table = np.frombuffer(self._read(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        data = self.frame(frames - 1)
        n = len(data) // 13
        names, nulls = np.frombuffer(data, "<i8", n), np.frombuffer(data, "u1", n, 8 * n)
        self.names = [None if no else int(name) for name, no in zip(names, nulls)]
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n, 9 * n), dtype=np.int64)])
        ids = np.concatenate([[0], np.cumsum(self.table[:-1, 1], dtype=np.int64)]) // 4
        self.start = ids[self.first]  # ids before each document, and all

    def _read(self, at: int, size: int) -> bytes:
        if self.begin <= at and at + size <= self.begin + len(self.loaded):
            return self.loaded[at - self.begin : at - self.begin + size]
        self.file.seek(at)
        return self.file.read(size)

    def load(self, a: int, b: int) -> None:
        """Fetch the frames of documents ``a`` to ``b`` with one read."""
        begin, end = int(self.at[self.first[a]]), int(self.at[self.first[b]])
        self.loaded, self.begin = self._read(begin, end - begin), begin

    def frame(self, i: int) -> bytes:
        size, _, want = (int(x) for x in self.table[i])
        data = self.unpack(self._read(int(self.at[i]), size), max_output_size=int(self.table[i, 1]))
        if checksum(data) != want:
            raise ValueError(f"frame {i} does not fit its checksum")
        return data

    def document(self, i: int) -> bytes:
        return b"".join(self.frame(j) for j in range(int(self.first[i]), int(self.first[i + 1])))


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def write_files(
    docs: DataFrame, ranks: str | None = None, end: int = END, file_ids: int = FILE_IDS, frame_ids: int = FRAME_IDS
) -> DataFrame:
    """Write the files of (doc_id, text) and give the stored list of them."""
    folder = scratch_path(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, writer = TaskContext.get().partitionId(), 0, None, None
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            known = [n for n, null, _ in writer.documents if not null]
            row = (part, number, path, len(writer.documents), writer.ids, min(known, default=None),
                   max(known, default=None), len(writer.documents) - len(known))
            return pa.RecordBatch.from_pydict({
                c.split()[0]: pa.array([v], {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[c.split()[1]])
                for c, v in zip(FILES.split(", "), row)
            })

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{number:05d}-{uuid.uuid4().hex}.ids.zst"
                    out = fs.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None)
                    writer = FileWriter(out, frame_ids=frame_ids)
                writer.add(doc.as_py(), token_ids(text.as_py(), ranks, end, encode_special_tokens=False))
                if writer.ids >= file_ids:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    # Equal rows may be many; a running number lets a range border fall between them.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i"))
    order = ("doc_id", "h", "i")
    sorted_docs = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(sorted_docs.mapInArrow(run, FILES), "token-file-list")


def with_starts(files: DataFrame, group: int = 1024) -> DataFrame:
    """The list of files with ``before``, the ids in earlier files: sums of groups of parts, then inside them."""
    grouped = files.withColumn("group", F.floor(F.col("part") / group))
    sums = grouped.groupBy("group").agg(F.sum("ids").alias("sum"))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("group", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("group").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    own = grouped.withColumn("own", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    return own.join(sums, "group").withColumn("before", F.col("base") + F.col("own")).drop("group", "base", "own")


def read_files(files: DataFrame, wanted: list[int] | None = None, read_ids: int = READ_IDS) -> DataFrame:
    """(doc_id, start, ids) of all documents, or of those with a ``wanted`` id; ``start``: ids of all before it."""
    spark = files.sparkSession
    listed = with_starts(files)
    if wanted is not None:
        least, most = (min(wanted), max(wanted)) if wanted else (None, None)
        listed = listed.where((F.col("greatest") >= F.lit(least).cast("bigint")) & (F.col("least") <= F.lit(most).cast("bigint")))
    only = None if wanted is None else set(wanted)
    last = F.greatest(F.lit(0), F.floor((F.col("ids") - 1) / read_ids))
    units = listed.select("path", "before", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("unit"))
    units = units.repartition(4 * spark.sparkContext.defaultParallelism, "path", "unit")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names, starts, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
            names=["doc_id", "start", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before, unit in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = file_system(path)
                with fs.open_input_file(name) as file:
                    reader, held, size = FileReader(file), [], 0
                    # A document belongs to the unit that its first id lies in.
                    a, b = np.searchsorted(reader.start[:-1], [unit * read_ids, (unit + 1) * read_ids])
                    if only is None and a < b:
                        reader.load(a, b)
                    for i in range(a, b):
                        if only is not None and reader.names[i] not in only:
                            continue
                        held.append((reader.names[i], before + int(reader.start[i]), reader.document(i)))
                        size += len(held[-1][2])
                        if size >= BATCH_BYTES:
                            yield batch_of(held)
                            held, size = [], 0
                    if held:
                        yield batch_of(held)

    return units.mapInArrow(run, READ)


def stored_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Write ``docs``, read them back and describe each: doc_id, start, n_tokens, ids_crc32."""
    back = read_files(write_files(docs, ranks))
    return back.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )

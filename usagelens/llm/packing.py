"""Harmonic packing: fixed-length sequences from classes of reciprocal capacity.

A document is cut into full sequences, and what is left, the rest, belongs to class k if it is at most
capacity / k and above capacity / (k + 1). A sequence of class k takes k whole rests. What then is free in it,
less than a rest, is filled by others: by a rest that fits whole, or, when ``WAITING`` sequences wait, by cutting
the next one. So sequences are full, most rests stay whole, and a sequence costs one cut at most on average.
Workers fill their sequences independently: a task keeps less than one open sequence a class and the
waiting ones. At its end the open pieces are laid end to end and cut at multiples of the capacity; the last,
shorter run is cut at powers of two. No sequence therefore needs padding.

Edge cases: a null or empty text is the end-of-document id alone; a text of any length is packed whole; repeated
rows are packed each on their own; an empty table gives an empty result; other columns are not looked
at. A sequence id is the task's number times 2**40 plus a count; a retried task reads the same rows and gives the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from usagelens.llm.tokens import token_ids

CAPACITY = 2048
WAITING = 32  # sequences with room for less than a rest of their class
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([(c, pa.int64()) for c in COLUMNS])


class Packer:
    """Sequences of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, base: int, waiting: int = WAITING):
        if capacity & (capacity - 1):
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.base, self.waiting, self.made = capacity, base, waiting, 0
        self.open: dict[int, list[tuple]] = {}  # by class
        self.gaps: list[tuple[int, list[tuple]]] = []  # room, pieces
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            crc = zlib.crc32(memoryview(ids).cast("B"))
            self.rows.append((doc, start, len(ids), crc, n, self.base + self.made, offset))
            offset += len(ids)
        self.made += 1

    def _fill(self, i: int, piece: tuple) -> None:
        room, pieces = self.gaps.pop(i)
        pieces.append(piece)
        if room == len(piece[2]):
            self._close(pieces)
        else:
            self.gaps.append((room - len(piece[2]), pieces))

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self._close([(doc, at, ids[at : at + self.capacity], n)])
            at += self.capacity
        while at < n:
            rest = n - at
            fits = [(room, i) for i, (room, _) in enumerate(self.gaps) if room >= rest]
            if fits:
                self._fill(min(fits)[1], (doc, at, ids[at:].copy(), n))
                return
            if len(self.gaps) < self.waiting:
                break
            room, i = max((room, i) for i, (room, _) in enumerate(self.gaps))
            self._fill(i, (doc, at, ids[at : at + room].copy(), n))
            at += room
        if at == n:
            return
        k = self.capacity // (n - at)
        own = self.open.setdefault(k, [])
        own.append((doc, at, ids[at:].copy(), n))
        if len(own) == k:
            room = self.capacity - sum(len(p[2]) for p in own)
            if room:
                self.gaps.append((room, own))
            else:
                self._close(own)
            del self.open[k]

    def finish(self) -> None:
        left = [p for _, pieces in self.gaps for p in pieces] + [p for k in sorted(self.open) for p in self.open[k]]
        total, run = sum(len(p[2]) for p in left), []
        room = self._room(total)
        for doc, start, ids, n in left:
            while len(ids):
                own, ids = ids[:room], ids[room:]
                run.append((doc, start, own, n))
                start, room, total = start + len(own), room - len(own), total - len(own)
                if not room:
                    self._close(run)
                    run, room = [], self._room(total)
        self.open, self.gaps = {}, []

    def _room(self, total: int) -> int:
        return self.capacity if total >= self.capacity else 1 << max(total, 1).bit_length() - 1

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = zip(*rows) if rows else [[]] * len(COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=ARROW)


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None) -> DataFrame:
    """Per piece of each document: where it lies in its document and in its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                packer.add(doc, token_ids(texts[i].as_py(), ranks, encode_special_tokens=False))
                if len(packer.rows) >= 20000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

"""Near-duplicate vectors: rows whose cosine with another row reaches a threshold, completely.

The search has no cap and misses no pair. It stays below all pairs because

1. equal vectors are counted first, and one of them is searched;
2. vectors are ordered by their nearest pivot and their likeness to it, and cut into shards in that order.
   Inside a shard all are compared, which settles families of near copies however large they are;
3. only vectors still unsettled search all others. What a unit vector has beside a pivot is its residual, and
   two vectors agree in at most the product of their likenesses plus the product of their residuals' norms. So
   the angles of two near vectors to any pivot differ by no more than the angle of the threshold. Vectors,
   blocks and shards whose ranges of angles lie further apart are never compared;
4. comparing is a product of two matrices in single precision with a margin, and what comes within the margin is
   decided in double precision.

Pivots are a bounded sample. They decide how much is compared, never what is found. Vectors without
structure, whose angles to all pivots are alike, are still all compared.

Null or empty vectors, null or non-finite components and vectors of zeros are near to nothing, as are
vectors of different lengths. Rows that share an id are judged each by its vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.operators.grouped import rate
from usagelens.storage import written

# The threshold, the sample of pivots and the sizes of what a task holds.
NEAR_COSINE = 0.95
PIVOTS = 64
SHARD_BYTES = 1 << 22  # vectors of a shard, in double precision
BLOCK_BYTES = 2 * SHARD_BYTES  # vectors that search together
GROUP_BYTES = 16 * SHARD_BYTES  # vectors that a task reads one shard after the other
STRIP = 512  # rows compared with a shard at once

_ANGLE_SLACK = 1e-6
_SLACK = 1e-12  # a cosine that misses the threshold by rounding alone reaches it
_KEYS = ["key_1", "key_2"]
_SHARD_FIELDS = (
    "number bigint, size int, keys binary, vectors binary, near binary, cells array<int>, low array<double>, high array<double>"
)


def _usable(v):
    """A vector with a direction whose squared norm neither overflows nor vanishes."""
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return F.coalesce((squares > 0) & (squares < math.inf), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _near_rows(queries: np.ndarray, data: np.ndarray, threshold: float, same: bool = False) -> np.ndarray:
    """Which queries have a partner among the data, both unit vectors; itself is none if both are the ``same``."""
    near = np.zeros(len(queries), dtype=bool)
    margin = 1e-5 + 1e-6 * queries.shape[1]
    rough = data.astype(np.float32)
    for at in range(0, len(queries), STRIP):
        part = queries[at : at + STRIP]
        own = (np.arange(len(part)), at + np.arange(len(part)))
        cosines = part.astype(np.float32) @ rough.T
        if same:
            cosines[own] = -2
        best = cosines.max(axis=1)
        near[at : at + len(part)] = best >= threshold + margin
        doubtful = np.flatnonzero((best >= threshold - margin) & (best < threshold + margin))
        if len(doubtful):
            cosines = part[doubtful] @ data.T
            if same:
                cosines[np.arange(len(doubtful)), at + doubtful] = -2
            near[at + doubtful] = cosines.max(axis=1) >= threshold - _SLACK
    return near


def _pivots_of(pivots: dict[int, np.ndarray], length: int) -> np.ndarray:
    return pivots.get(length, np.zeros((0, length)))


def _placer(pivots: dict[int, np.ndarray]):
    """Adds a vector's nearest pivot and the angle to it."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, angle = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch))
            sizes = batch["vector"].map(len).to_numpy()
            for size in np.unique(sizes):
                own = _pivots_of(pivots, size)
                if len(own):
                    at = np.flatnonzero(sizes == size)
                    angles = _angles(_units(_stacked(batch["vector"].iloc[at])), own)
                    cell[at] = angles.argmin(axis=1)
                    angle[at] = angles.min(axis=1)
            yield batch.assign(size=sizes.astype(np.int32), cell=cell, angle=angle)

    return place


def _sharder(pivots: dict[int, np.ndarray], threshold: float):
    """Cuts ordered vectors of a task into shards of one length, and settles what is near inside one."""

    def shard(number: int, size: int, rows: list[tuple]) -> dict:
        units = _units(np.stack([v for *_, v in rows]))
        keys = np.array([(a, b) for a, b, _, _ in rows], dtype=np.int64)
        angles = _angles(units, _pivots_of(pivots, size))
        return {
            "number": number, "size": size, "keys": keys.tobytes(), "vectors": units.tobytes(),
            "near": _near_rows(units, units, threshold, same=True).tobytes(),
            "cells": sorted({c for _, _, c, _ in rows}), "low": angles.min(axis=0), "high": angles.max(axis=0),
        }

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        size, rows = 0, []
        for batch in batches:
            for a, b, length, cell, v in zip(*(batch[c] for c in (*_KEYS, "size", "cell", "vector"))):
                if rows and (length != size or len(rows) >= max(1, SHARD_BYTES // (8 * size))):
                    yield pd.DataFrame([shard(number, size, rows)])
                    number, rows = number + 1, []
                size = length
                rows.append((a, b, cell, np.asarray(v, dtype=np.float64)))
        if rows:
            yield pd.DataFrame([shard(number, size, rows)])

    return cut


def _unsettled(pivots: dict[int, np.ndarray]):
    """Leaves a shard's unsettled vectors, with the ranges of their angles."""

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                stay = ~np.frombuffer(row["near"], dtype=bool)
                if stay.any():
                    units = np.frombuffer(row["vectors"]).reshape(-1, row["size"])[stay]
                    angles = _angles(units, _pivots_of(pivots, row["size"]))
                    keys = np.frombuffer(row["keys"], dtype=np.int64).reshape(-1, 2)[stay]
                    row |= {"keys": keys.tobytes(), "vectors": units.tobytes(), "near": b""}
                    row |= {"low": angles.min(axis=0), "high": angles.max(axis=0)}
                    out.append(row)
            yield pd.DataFrame(out, columns=batch.columns)

    return leave


def _searcher(pivots: dict[int, np.ndarray], threshold: float):
    """Searches a group's shards for partners of a block's vectors."""
    reach = math.acos(min(1.0, max(-1.0, threshold))) + _ANGLE_SLACK

    def search(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 2), dtype=np.int64)]
        for q in block.to_dict("records"):
            left = np.frombuffer(q["vectors"]).reshape(-1, q["size"])
            keys = np.frombuffer(q["keys"], dtype=np.int64).reshape(-1, 2)
            angles = _angles(left, _pivots_of(pivots, q["size"]))
            for d in group.to_dict("records"):
                if d["number"] == q["number"] or d["size"] != q["size"] or not len(left):
                    continue
                low, high = np.asarray(d["low"]) - reach, np.asarray(d["high"]) + reach
                at = np.flatnonzero(((angles >= low) & (angles <= high)).all(axis=1))
                if not len(at):
                    continue
                data = np.frombuffer(d["vectors"]).reshape(-1, d["size"])
                near = at[_near_rows(left[at], data, threshold)]
                found.append(keys[near])
                left, keys, angles = (np.delete(x, near, axis=0) for x in (left, keys, angles))
        return pd.DataFrame(np.concatenate(found), columns=_KEYS)

    return search


def _ranges(shards: DataFrame, name: str) -> DataFrame:
    """Ranges of angles and cells of all shards under one ``name``, which are of one length."""
    place = F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "range")
    by_pivot = (
        shards.select(name, "size", place).groupBy(name, "size", "pivot")
        .agg(F.min("range.low").alias("low"), F.max("range.high").alias("high"))
        .groupBy(name, "size").agg(F.array_sort(F.collect_list(F.struct("pivot", "low", "high"))).alias("ranges"))
    )
    return shards.select(name, "size").distinct().join(by_pivot, [name, "size"], "left").select(
        name, "size", F.coalesce("ranges.low", F.array().cast("array<double>")).alias(f"{name}_low"),
        F.coalesce("ranges.high", F.array().cast("array<double>")).alias(f"{name}_high"),
    )


def _offsets(shards: DataFrame) -> DataFrame:
    """(number, offset): the bytes of vectors in the shards before. Only a task's total meets other tasks' totals."""
    held = written(shards.select("number", F.shiftright("number", 32).alias("task"), F.length("vectors").alias("held")), "held")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    tasks = held.groupBy("task").agg(F.sum("held").alias("total"))
    tasks = tasks.select("task", F.coalesce(F.sum("total").over(before.orderBy("task")), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("held").over(before.partitionBy("task").orderBy("number")), F.lit(0))
    return held.withColumn("within", within).join(tasks, "task").select("number", (F.col("start") + F.col("within")).alias("offset"))


def _searched(shards: DataFrame, pivots: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Keys of vectors that are near to one of another shard."""
    reach = math.acos(min(1.0, max(-1.0, threshold))) + _ANGLE_SLACK
    held = _offsets(shards)
    data = shards.join(held.select("number", F.floor(F.col("offset") / GROUP_BYTES).alias("group")), "number")
    seek = shards.mapInPandas(_unsettled(pivots), shards.schema)
    seek = seek.join(held.select("number", F.floor(F.col("offset") / BLOCK_BYTES).alias("block")), "number")
    data, seek = written(data, "grouped-vectors"), written(seek, "unsettled-vectors")

    # A block is posted under every pivot that it may share with a group, and a group under its own pivots.
    blocks = _ranges(seek, "block")
    groups = _ranges(data, "group")
    homes = data.select("group", "size", F.explode("cells").alias("cell")).distinct()
    cells = homes.groupBy("size", "cell").agg(F.count("*").alias("groups"))
    homes = homes.join(groups, ["group", "size"])
    posted = blocks.join(cells.groupBy("size").agg(F.collect_list("cell").alias("cells")), "size")
    posted = posted.withColumn("cell", F.explode("cells")).drop("cells")
    apart = F.exists(
        F.arrays_zip("block_low", "block_high", "group_low", "group_high"),
        lambda r: (r["block_low"] - r["group_high"] > reach) | (r["group_low"] - r["block_high"] > reach),
    )
    pairs = posted.join(homes, ["size", "cell"]).where(~apart).select("block", "group", "size").distinct()
    pairs = written(pairs, "vector-blocks")

    left = seek.join(pairs, ["block", "size"])
    right = data.join(pairs, ["group", "size"])
    keys = ["block", "group", "size"]
    names = ["number", "size", "keys", "vectors", "low", "high"]
    left, right = (x.select("block", "group", *names) for x in (left, right))
    return (
        left.groupBy(*keys).cogroup(right.groupBy(*keys))
        .applyInPandas(_searcher(pivots, threshold), "key_1 bigint, key_2 bigint")
    )


def _settled(shards: DataFrame) -> DataFrame:
    """Keys of vectors that are near to one of their own shard."""

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, near in zip(batch["keys"], batch["near"]):
                rows = np.frombuffer(keys, dtype=np.int64).reshape(-1, 2)
                yield pd.DataFrame(rows[np.frombuffer(near, dtype=bool)], columns=_KEYS)

    return shards.select("keys", "near").mapInPandas(settled, "key_1 bigint, key_2 bigint")


def near_vectors(rows: DataFrame, key: str, vector: str, threshold: float = NEAR_COSINE) -> DataFrame:
    """(key, copies, is_near) of every row: how many rows hold its vector, and whether another row is near.

    Copies of a vector are near by definition. Rows without a usable vector have null copies and are not near.
    ``threshold`` lies above 0 and at most at 1. An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and be 1 at most")
    v = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: x + F.lit(0.0))  # 0.0 for -0.0
    base = rows.select(F.col(f"`{key}`").alias("key"), v.alias("vector"))
    hashes = {k: F.when(_usable(F.col("vector")), F.xxhash64(F.lit(i), "vector")) for i, k in enumerate(_KEYS)}
    base = base.withColumns(hashes)

    distinct = base.where("key_1 is not null").groupBy(*_KEYS).agg(
        F.count("*").alias("copies"), F.any_value("vector").alias("vector")
    )
    distinct = written(distinct, "vectors")
    sample = distinct.orderBy(F.xxhash64("key_1", F.lit(2)), *_KEYS).limit(PIVOTS).select("vector").collect()
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(len(row["vector"]), []).append(row["vector"])
    pivots = {size: _units(np.array(vs)) for size, vs in by_length.items()}

    bytes_held = distinct.agg(F.sum(F.size("vector") * F.lit(8))).first()[0] or 0
    parts = math.ceil((bytes_held + 1) / BLOCK_BYTES)
    placed = distinct.drop("copies").mapInPandas(
        _placer(pivots), "key_1 bigint, key_2 bigint, vector array<double>, size int, cell int, angle double"
    )
    order = ["size", "cell", "angle", *_KEYS]
    shards = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shards = written(shards.mapInPandas(_sharder(pivots, threshold), _SHARD_FIELDS), "vector-shards")

    near = _settled(shards).union(_searched(shards, pivots, threshold)).distinct().withColumn("found", F.lit(True))
    flags = distinct.drop("vector").join(near, _KEYS, "left").select(
        *_KEYS, "copies", ((F.col("copies") > 1) | F.coalesce("found", F.lit(False))).alias("is_near")
    )
    return (
        base.select("key", *_KEYS).join(written(flags, "near-vectors"), _KEYS, "left")
        .select(F.col("key").alias(key), "copies", F.coalesce("is_near", F.lit(False)).alias("is_near"))
    )


def near_vector_stats(flags: DataFrame) -> DataFrame:
    """Analyzed rows, those with copies, near ones, and their rates, in one row."""
    totals = flags.agg(
        F.count("copies").alias("analyzed_vectors"),
        F.count_if(F.col("copies") > 1).alias("exact_duplicate_vectors"),
        F.count_if("is_near").alias("near_duplicate_vectors"),
    )
    shares = {
        f"{kind}_duplicate_rate": rate(F.col(f"{kind}_duplicate_vectors"), F.col("analyzed_vectors"))
        for kind in ("exact", "near")
    }
    return totals.withColumns(shares)

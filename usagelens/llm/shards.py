"""Vectors in shards of bounded size, and a search of all shards by blocks of queries.

Rows are dealt to shards evenly, whatever their ids and values, so nothing makes a large shard. A
shard is one row with its ids and its vectors as blocks of bytes. Shards are dealt to groups and
queries to blocks, and a task searches one group for one block: it holds the block's queries and their
best so far, and reads the shards of the group one after the other. A query is so sent once for each
group and a shard once for each block, not once for each other: a stated query set against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.storage import written

SHARD_ROWS = 4096
GROUP_ROWS = 1 << 18
BLOCK_QUERIES = 1 << 14
SHARD = "shard int, n int, dims int, ids binary, data binary, labels binary, extra binary"
NONE = np.iinfo(np.int64).min + 1  # below every integer score; its negative is a number too


def usable(vectors: DataFrame, *carry: str) -> DataFrame:
    """(vec_id, v, ...) with neither a null nor a null, NaN or infinite component."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & whole).select("vec_id", v.alias("v"), *carry)


def quantized(vectors: DataFrame, scale: int, *carry: str) -> DataFrame:
    """Usable vectors with components as integers: floor(scale * x)."""
    v = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return usable(vectors, *carry).select("vec_id", v.alias("v"), *carry)


def matrix(rows, dims: int, dtype: str) -> np.ndarray:
    """Rows of one width; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), dims), dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def product(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where every partial sum fits them."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return q @ rows.T


class Shards:
    """Stored shards, their number, and how many rows and queries they hold."""

    def __init__(self, table: DataFrame, shards: int, rows: int, asked: int):
        self.table, self.shards, self.rows, self.asked = table, shards, rows, asked


def build(
    vectors: DataFrame, dtype: str, every: int, arrange: Callable, label: str, shard_rows: int = SHARD_ROWS
) -> Shards:
    """Store the shards of (vec_id, v) and, where it has one, an integer label.

    ``arrange(ids, rows, labels)`` gives the order of the rows in a shard and bytes kept beside them.
    Rows whose id is divisible by ``every`` are queries.
    """
    size = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-size["n"] // shard_rows), min(2 * cores, size["n"] // 512))
    labelled = "label" in vectors.columns

    def make(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dims = max((len(r) for r in frame["v"]), default=0)
        ids = frame["vec_id"].to_numpy(np.int64)
        rows = matrix(frame["v"], dims, dtype)
        labels = frame["label"].to_numpy(np.int64) if labelled else np.zeros(len(ids), np.int64)
        first = np.lexsort((*rows.T[::-1], labels, ids))
        ids, rows, labels = ids[first], rows[first], labels[first]
        order, extra = arrange(ids, rows, labels)
        return pd.DataFrame({
            "shard": [int(key[0])], "n": [len(ids)], "dims": [dims], "ids": [ids[order].tobytes()],
            "data": [np.ascontiguousarray(rows[order]).tobytes()], "labels": [labels[order].tobytes()], "extra": [extra],
        })

    # The running number parts rows that share an id, too.
    dealt = vectors.withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("row", "vec_id"), F.lit(n)).cast("int")).drop("row")
    return Shards(written(dealt.groupBy("shard").applyInPandas(make, SHARD), label), n, size["n"], size["asked"])


def opened(row, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and labels of a shard, or of the queries of one."""
    ids = np.frombuffer(row["ids"], np.int64)
    rows = np.frombuffer(row["data"], dtype).reshape(len(ids), row["dims"])
    return ids, rows, np.frombuffer(row["labels"], np.int64)


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices one under the other, in the width of the widest."""
    dims = max(p.shape[1] for p in parts)
    return np.concatenate([p if p.shape[1] == dims else np.pad(p, ((0, 0), (0, dims - p.shape[1]))) for p in parts])


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dims = max(a.shape[1], b.shape[1])
    wide = lambda m: m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))
    return wide(a), wide(b)


def keep_best(score: np.ndarray, best: np.ndarray, who: np.ndarray, s: np.ndarray, ids: np.ndarray, none) -> None:
    """Merge found (query, score, id) into the best of each query: highest score, then smallest id."""
    k = score.shape[1]
    touched = np.unique(who)
    old = score[touched] > none
    q = np.concatenate([np.broadcast_to(touched[:, None], old.shape)[old], who])
    s = np.concatenate([score[touched][old], s])
    ids = np.concatenate([best[touched][old], ids])
    order = np.lexsort((ids, -s, q))
    q, s, ids = q[order], s[order], ids[order]
    begin = np.searchsorted(q, touched)
    place = np.arange(len(q)) - begin[np.searchsorted(touched, q)]
    top = place < k
    score[touched], best[touched] = none, -1
    score[q[top], place[top]], best[q[top], place[top]] = s[top], ids[top]


def queries(shards: Shards, every: int, extra: Callable | None = None) -> DataFrame:
    """The queries of each shard, as a row like a shard's own; ``extra(row, places)`` gives what is kept beside them."""

    def run(batches):
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                ids = np.frombuffer(row["ids"], np.int64)
                at = np.flatnonzero(ids % every == 0)
                if not len(at):
                    continue
                width = len(row["data"]) // max(1, len(ids))
                data = np.frombuffer(row["data"], np.uint8).reshape(len(ids), width)[at].tobytes()
                labels = np.frombuffer(row["labels"], np.int64)[at].tobytes()
                own = extra(row, at) if extra else b""
                out.append((row["shard"], len(at), row["dims"], ids[at].tobytes(), data, labels, own))
            if out:
                yield pd.DataFrame(out, columns=list(frame.columns))

    return shards.table.mapInPandas(run, SHARD)


def search(shards: Shards, asked: DataFrame, begin: Callable, found: str) -> DataFrame:
    """What each block of queries finds in each group of shards, as rows of ``found``.

    ``begin(rows)`` takes the query rows of a block and gives an object with ``scan(row)``, called for each
    shard, and ``result()``, a pandas frame.
    """
    cores = asked.sparkSession.sparkContext.defaultParallelism
    blocks = min(shards.shards, max(1, -(-shards.asked // BLOCK_QUERIES)))
    groups = min(shards.shards, max(-(-shards.rows // GROUP_ROWS), -(-2 * cores // blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumns({"kind": F.lit(0), "block": F.col("shard") % blocks}).withColumn("group", every(groups))
    s = shards.table.withColumns({"kind": F.lit(1), "group": F.col("shard") % groups}).withColumn("block", every(blocks))
    rows = q.unionByName(s).withColumn("cell", F.col("block") * groups + F.col("group")).drop("block", "group")
    rows = rows.repartitionById(blocks * groups, "cell").sortWithinPartitions("cell", "kind", "shard")

    def run(batches):
        cell, waiting, state = None, [], None
        for frame in batches:
            for row in frame.to_dict("records"):
                if row["cell"] != cell:
                    if state is not None:
                        yield state.result()
                    cell, waiting, state = row["cell"], [], None
                if row["kind"] == 0:
                    waiting.append(row)
                    continue
                if state is None and waiting:
                    state = begin(waiting)
                if state is not None:
                    state.scan(row)
        if state is not None:
            yield state.result()

    return rows.mapInPandas(run, found)


def best_rows(q_ids: np.ndarray, score: np.ndarray, best: np.ndarray, none) -> pd.DataFrame:
    some = score > none
    return pd.DataFrame({
        "query_id": np.repeat(q_ids, some.sum(axis=1)), "vec_id": best[some], "score": score[some]
    })


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of all groups: (query_id, rank, vec_id, score)."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")

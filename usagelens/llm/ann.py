"""Approximate nearest neighbours by multi-index hashing.

Vectors become 64-bit codes: the signs after a learned rotation (iterative quantisation on a bounded
sample). A code is split into eight substrings, and each shard is indexed by each of them. Pigeonhole:
codes that differ in at most 8 (t + 1) - 1 bits agree up to t bits in one substring. A search probes
all substrings within t = 0, 1, 2, ... bits, which retrieves every code within that radius, and
reranks the retrieved rows by their floats. It ends when the radius covers the one that neighbours
better than the k-th found so far need. How far codes of a given cosine lie apart is measured on the sample:
the radius is the ``cover`` quantile for that cosine. Queries of a block that share the value of a
substring share its probes, and a block keeps its best from shard to shard, so radii shrink.

Vectors are scaled by the largest norm and given one more component that fills them up to length 1,
so the largest inner product is the smallest angle, whatever the norms are.

Edge cases: null and zero vectors, and vectors with a null, NaN or infinite component, take no part;
rows with the id of the query are not its candidates; rows that share an id are candidates each on
their own, and what several queries of one id find is ranked together; ties go to the smaller id; fewer candidates
than k give all of them; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm import shards as S

K = 20
QUERY_EVERY = 20
BITS = 64
PARTS = 8
SAMPLE_ROWS = 3000  # rows that rotation and radii are learned from
COVER = 0.98
SEED = 7
TILE = 1 << 23  # pairs of queries and rows looked at together
# Bytes by their number of set bits: what to flip to probe at a distance.
FLIPS = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) == t) for t in range(9)]


def filled_up(rows: np.ndarray, norm: float) -> np.ndarray:
    x = rows / norm
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = SEED) -> np.ndarray:
    """Directions (dims, bits): rotations of the leading axes fitted to their own signs."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.svd(x, full_matrices=False)[2].T if len(x) else np.eye(x.shape[1])
    made, have = [], 0
    while have < bits:
        width = min(bits - have, axes.shape[1])
        v = x @ axes[:, :width]
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds if len(x) else 0):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        made.append(axes[:, :width] @ r)
        have += width
    return np.concatenate(made, axis=1)


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """One byte a substring: (rows, 8)."""
    return np.packbits(x @ rotation > 0, axis=1)


def learn_radii(x: np.ndarray, q: np.ndarray, rotation: np.ndarray, cover: float = COVER) -> np.ndarray:
    """For cosines from 1 down to -1 in steps of 0.05, the radius that covers such pairs."""
    grid = np.arange(41)
    theory = np.ceil(BITS * np.arccos(np.clip(1 - grid * 0.05, -1, 1)) / np.pi + 8).astype(int)
    seen: list[list[np.ndarray]] = [[] for _ in grid]
    cx, cq = codes(x, rotation).view(">u8").ravel(), codes(q, rotation).view(">u8").ravel()
    for i in range(0, min(len(q), 500)):
        distance = np.bitwise_count(cx ^ cq[i])
        step = np.clip(((1 - x @ q[i]) / 0.05).astype(int), 0, 40)
        step[i] = -1
        for g in np.unique(step[step >= 0]):
            seen[g].append(distance[step == g])
    radii = theory.copy()
    for g in grid:
        own = np.concatenate(seen[g]) if seen[g] else np.zeros(0)
        if len(own) >= 200:
            radii[g] = int(np.ceil(np.quantile(own, cover)))
    return np.minimum(np.maximum.accumulate(radii), BITS)


def index_of(code: np.ndarray) -> bytes:
    """For each substring: rows ordered by its value, and where each value starts."""
    parts = [code.tobytes()]
    for p in range(PARTS):
        order = np.argsort(code[:, p], kind="stable").astype("<u4")
        starts = np.searchsorted(code[order, p], np.arange(257)).astype("<u4")
        parts += [order.tobytes(), starts.tobytes()]
    return b"".join(parts)


def open_index(data: bytes, n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    code, at, tables = np.frombuffer(data, np.uint8, n * PARTS).reshape(n, PARTS), n * PARTS, []
    for _ in range(PARTS):
        order = np.frombuffer(data, "<u4", n, at)
        tables.append((order, np.frombuffer(data, "<u4", 257, at + 4 * n)))
        at += 4 * n + 4 * 257
    return code, tables


def probe(code: np.ndarray, active: np.ndarray, tables, t: int, seen: np.ndarray) -> None:
    """Mark the rows that differ from an active query in exactly ``t`` bits of some substring."""
    for p, (order, starts) in enumerate(tables):
        by_value = active[np.argsort(code[active, p], kind="stable")]
        values, begin = np.unique(code[by_value, p], return_index=True)
        for v, who in zip(values, np.split(by_value, begin[1:])):
            rows = np.concatenate([order[starts[u] : starts[u + 1]] for u in v ^ FLIPS[t]])
            seen[who[:, None], rows[None, :]] = True


class Asked:
    """A block of queries and its best so far."""

    def __init__(self, rows: list[dict], k: int, rotation: np.ndarray, radii: np.ndarray, norm: float, dims: int):
        parts = [S.opened(r, "<f8") for r in rows]
        self.ids, q = np.concatenate([p[0] for p in parts]), S.stacked([p[1] for p in parts])
        self.q = S.same_width(q, np.zeros((0, dims)))[0]
        self.code = codes(flat(self.q), rotation)
        self.words = np.ascontiguousarray(self.code).view(">u8").ravel()
        self.length = np.linalg.norm(self.q, axis=1) * norm
        self.radii = radii
        self.score = np.full((len(self.ids), k), -np.inf)
        self.best = np.full((len(self.ids), k), -1, np.int64)

    def scan(self, row: dict) -> None:
        ids, rows, _ = S.opened(row, "<f8")
        rows = S.same_width(rows, np.zeros((0, self.q.shape[1])))[0]
        code, tables = open_index(row["extra"], len(ids))
        words = np.ascontiguousarray(code).view(">u8").ravel()
        step = max(1, TILE // max(1, len(ids)))
        for i in range(0, len(self.ids), step):
            self._scan(np.arange(i, min(i + step, len(self.ids))), ids, rows, words, tables)

    def needed(self, who: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The radius that holds nearly all rows better than ``kth``; all bits while there is none."""
        with np.errstate(invalid="ignore"):
            at = np.clip((1 - kth / self.length[who]) / 0.05, 0, 40)
        return np.where(kth > -np.inf, self.radii[np.nan_to_num(at, nan=40.0).astype(int)], BITS)

    def _scan(self, own: np.ndarray, ids, rows, words, tables) -> None:
        q, k = self.q[own], self.score.shape[1]
        scores = q @ rows.T
        scores[self.ids[own][:, None] == ids[None, :]] = -np.inf
        seen = np.zeros(scores.shape, bool)
        distance = np.full(scores.shape, 255, np.uint8)  # of retrieved rows
        need = self.needed(own, self.score[own, -1])
        active = np.arange(len(own))
        reach = np.zeros(len(own), np.int64)
        for t in range(9):
            probe(self.code[own], active, tables, t, seen)
            at, row = np.nonzero(seen[active] & (distance[active] == 255))
            at = active[at]
            distance[at, row] = np.bitwise_count(words[row] ^ self.words[own[at]])
            reach[active] = min(PARTS * (t + 1) - 1, BITS)
            inside = np.where(distance[active] <= np.minimum(reach, need)[active, None], scores[active], -np.inf)
            kth = self.score[own[active], -1]
            if inside.shape[1] >= k:
                kth = np.maximum(kth, np.partition(inside, -k, axis=1)[:, -k])
            need[active] = self.needed(own[active], kth)
            active = active[reach[active] < need[active]]
            if not len(active):
                break
        inside = np.where(distance <= np.minimum(reach, need)[:, None], scores, -np.inf)
        least = self.score[own, -1]
        if inside.shape[1] >= k:
            least = np.maximum(least, np.partition(inside, -k, axis=1)[:, -k])
        slack = 1e-12 * np.abs(np.where(np.isfinite(least), least, 0.0)) + 1e-12 * self.length[own]
        at, row = np.nonzero((inside > -np.inf) & (inside >= (least - slack)[:, None]))
        exact = (q[at] * rows[row]).sum(axis=1)  # does not depend on how rows are dealt
        S.keep_best(self.score, self.best, own[at], exact, ids[row], -np.inf)

    def result(self) -> pd.DataFrame:
        return S.best_rows(self.ids, self.score, self.best, -np.inf)


def flat(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 with an empty last component, as queries have."""
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-300)[:, None]
    return np.concatenate([unit, np.zeros((len(rows), 1))], axis=1)


def nearest(
    vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, shard_rows: int = S.SHARD_ROWS,
    sample_rows: int = SAMPLE_ROWS, cover: float = COVER,
) -> DataFrame:
    """For each row with an id divisible by ``every``: the ``k`` nearest others found."""
    usable = S.usable(vectors).where(F.exists("v", lambda x: x != 0))
    v64 = usable.select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = v64.agg(F.max(F.sqrt(square)).alias("norm"), F.max(F.size("v")).alias("dims"), F.count("*").alias("n")).first()
    norm, dims = facts["norm"] or 1.0, facts["dims"] or 1
    # A bounded sample by hash: about sample_rows rows, whatever the table's size and however often an id repeats.
    share = min(1.0, sample_rows / max(1, facts["n"]))
    row = F.monotonically_increasing_id()
    part = F.pmod(F.xxhash64(F.lit(SEED), "vec_id", "row"), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = v64.withColumn("row", row).where(part).orderBy("vec_id", "row").select("v").collect()
    sample = S.matrix([r["v"] for r in chosen], dims, "<f8")
    x = filled_up(sample, norm)
    rotation = learn_rotation(x)
    radii = learn_radii(x, flat(sample), rotation, cover)

    def arrange(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        rows, _ = S.same_width(rows, np.zeros((0, dims)))
        return np.arange(len(ids)), index_of(codes(filled_up(rows, norm), rotation))

    stored = S.build(v64, "<f8", every, arrange, "ann-shards", shard_rows)
    asked = S.queries(stored, every)
    begin = lambda rows: Asked(rows, k, rotation, radii, norm, dims)
    return S.ranked(S.search(stored, asked, begin, "query_id bigint, vec_id bigint, score double"), k)

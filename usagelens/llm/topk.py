"""Exact top-k by inner product over integer vectors, with block-at-a-time pruning.

The rows of a shard are ordered so that like rows meet, and cut into blocks, ranges of that order. A
block keeps the largest and smallest value of each term. For a query, the sum over terms of the
better product is a bound on every score in the block. Blocks are taken in order of that sum and
scored whole from their rows, until the bound is below the k-th best score. A query starts with the
k-th score of its own shard and goes on with its best so far, so other shards prune from the first block on.

Edge cases: null vectors, and vectors with a null, NaN or infinite component, take no part; rows with
the id of the query are not its candidates; rows that share an id are candidates each on their own,
and what several queries of one id find is ranked together; ties go to the smaller id; shorter vectors count as
filled up with zeros; fewer candidates than k give all of them; other columns are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from usagelens.llm import shards as S
from usagelens.llm.shards import NONE

K = 5
QUERY_EVERY = 50
BLOCK_ROWS = 256
SCALE = 256


def like_rows(rows: np.ndarray, block: int = BLOCK_ROWS) -> np.ndarray:
    """An order in which runs of ``block`` rows are alike: halves along the widest term."""
    parts, done = [np.arange(len(rows))], []
    while parts:
        own = parts.pop()
        if len(own) <= block or not rows.shape[1]:
            done.append(own)
            continue
        own_rows = rows[own].astype(np.float64)
        own = own[np.argsort(own_rows[:, own_rows.var(axis=0).argmax()], kind="stable")]
        half = max(block, (len(own) // 2) // block * block)
        parts += [own[half:], own[:half]]
    return np.concatenate(done) if done else np.arange(0)


def block_search(
    q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int,
    block: int = BLOCK_ROWS, score: np.ndarray | None = None, best: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Best scores and ids per query (-1: none), and the number of scores made.

    ``floor``: a score that k candidates of the query are known to reach, per query. ``score`` and
    ``best``, if given, are what was found before; they are kept up to date.
    """
    score = np.full((len(q), k), NONE) if score is None else score
    best = np.full((len(q), k), -1, np.int64) if best is None else best
    edges = np.arange(0, len(rows), block)
    if not len(q) or not len(rows):
        return score, best, 0
    high = np.maximum.reduceat(rows, edges).astype(np.float64)
    low = np.minimum.reduceat(rows, edges).astype(np.float64)
    qf = q.astype(np.float64)
    bound = np.maximum(qf, 0) @ high.T + np.minimum(qf, 0) @ low.T
    bound += np.abs(bound) * 1e-12  # rounding must not lower a bound
    order = np.argsort(-bound, axis=1, kind="stable")
    active, made = np.arange(len(q)), 0
    for step in range(len(edges)):
        now = order[active, step]
        need = np.maximum(floor[active], score[active, k - 1])
        on = bound[active, now] >= need
        active, now = active[on], now[on]
        if not len(active):
            break
        for b in np.unique(now):
            who = active[now == b]
            part = slice(edges[b], edges[b] + block)
            s, cand = S.product(q[who], rows[part]), ids[part]
            made += s.size
            need = np.maximum(score[who, k - 1], floor[who])
            hit, col = np.nonzero((s >= need[:, None]) & (q_ids[who][:, None] != cand[None, :]))
            if len(hit):
                S.keep_best(score, best, who[hit], s[hit, col], cand[col], NONE)
    return score, best, made


class Asked:
    """A block of queries and its best so far."""

    def __init__(self, rows: list[dict], k: int):
        parts = [S.opened(r, "<i8") for r in rows]
        self.ids, self.q = np.concatenate([p[0] for p in parts]), S.stacked([p[1] for p in parts])
        self.floor = np.concatenate([np.frombuffer(r["extra"], np.int64) for r in rows])
        self.score = np.full((len(self.ids), k), NONE)
        self.best = np.full((len(self.ids), k), -1, np.int64)

    def scan(self, row: dict) -> None:
        ids, rows, _ = S.opened(row, "<i8")
        q, rows = S.same_width(self.q, rows)
        block_search(self.ids, q, self.floor, ids, rows, self.score.shape[1], score=self.score, best=self.best)

    def result(self) -> pd.DataFrame:
        return S.best_rows(self.ids, self.score, self.best, NONE)


def top_k(
    vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, shard_rows: int = S.SHARD_ROWS
) -> DataFrame:
    """For each row with an id divisible by ``every``: its ``k`` best others."""

    def arrange(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        order = like_rows(rows)
        ids, rows = ids[order], rows[order]
        asked = np.flatnonzero(ids % every == 0)
        none = np.full(len(asked), NONE)
        own = block_search(ids[asked], rows[asked], none, ids, rows, k)[0][:, k - 1]
        return order, own.astype(np.int64).tobytes()

    stored = S.build(S.quantized(vectors, SCALE), "<i8", every, arrange, "topk-shards", shard_rows)
    asked = S.queries(stored, every, lambda row, at: row["extra"])
    found = S.search(stored, asked, lambda rows: Asked(rows, k), "query_id bigint, vec_id bigint, score bigint")
    return S.ranked(found, k)

"""Hard negatives by score windows over STR-packed R-trees.

Each shard of integer vectors holds one R-tree: rows are sorted into tiles one coordinate after the
other, the label first and then the widest coordinates (sort-tile-recursive), and runs of that order are the
leaves; runs of nodes are their parents. A node keeps its minimum bounding box and its range of labels. For an anchor, the box
gives an interval of products for each coordinate, and their sums an interval that holds every score
below the node.

A query is an anchor with a window of scores and a wish for its own label or any other. Its queue
holds nodes by the highest score they can still give inside the window; the best node is taken first.
A node is dropped if its interval lies outside the window, if its labels cannot do, or if it stands
strictly below the k-th score found, which for ties goes on to the smaller id. All queries of a block
take their next node in the same step, so that scores are made by matrix products.

Two searches: the positives of each anchor, then for each of them the negatives in its window.

Edge cases: rows with a null id, label or vector, or a null, NaN or infinite component, take no part;
rows with the anchor's id are neither its positives nor its negatives; rows that share an id count
each, also as anchors; ties go to the smaller id; fewer rows than asked for give all of them; an
anchor without positives, or a positive without negatives, gives no rows; shorter vectors count as filled up
with zeros; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm import shards as S
from usagelens.llm.shards import NONE

QUERY_EVERY = 50
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LEAST_PERCENT, MOST_PERCENT = 50, 95
LEAF_ROWS = 128
FANOUT = 8


def tiled(rows: np.ndarray, labels: np.ndarray, leaf: int = LEAF_ROWS) -> np.ndarray:
    """Sort-tile-recursive order: by label, then in each tile by the next widest coordinate."""
    order = np.argsort(labels, kind="stable")
    axes = np.argsort(-rows.astype(np.float64).var(axis=0), kind="stable") if len(rows) else np.arange(0)
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    parts, done = [(own, 0) for own in np.split(order, cuts)][::-1], []
    while parts:
        own, depth = parts.pop()
        pages = -(-len(own) // leaf)
        if pages <= 1 or depth == len(axes):
            done.append(own)
            continue
        slabs = int(np.ceil(pages ** (1 / (len(axes) - depth)) - 1e-9))  # the same number on each coordinate left
        own = own[np.argsort(rows[own, axes[depth]], kind="stable")]
        size = -(-pages // slabs) * leaf
        parts += [(own[i : i + size], depth + 1) for i in range(0, len(own), size)][::-1]
    return np.concatenate(done) if done else order


class Tree:
    """Boxes of all nodes, leaves first, then level by level up to the root."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, leaf: int = LEAF_ROWS, fanout: int = FANOUT):
        edges = np.arange(0, len(rows), leaf)
        low, high = np.minimum.reduceat(rows, edges), np.maximum.reduceat(rows, edges)
        least, most = np.minimum.reduceat(labels, edges), np.maximum.reduceat(labels, edges)
        self.leaves, self.leaf = len(edges), leaf
        self.children: dict[int, tuple[int, int]] = {}
        levels, first = [(low, high, least, most)], 0
        while len(levels[-1][0]) > 1:
            low, high, least, most = levels[-1]
            edges = np.arange(0, len(low), fanout)
            above = first + len(low)
            for i, e in enumerate(edges):
                self.children[above + i] = (first + e, first + min(e + fanout, len(low)))
            levels.append((np.minimum.reduceat(low, edges), np.maximum.reduceat(high, edges),
                           np.minimum.reduceat(least, edges), np.maximum.reduceat(most, edges)))
            first = above
        self.low, self.high, self.least, self.most = (np.concatenate(x) for x in zip(*levels))
        self.root = len(self.low) - 1

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and node, bounds below and above every score; wider than rounding."""
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        low, high = self.low.astype(np.float64).T, self.high.astype(np.float64).T
        least, most = up @ low + down @ high, up @ high + down @ low
        slack = (up @ np.abs(high) + up @ np.abs(low) - down @ np.abs(high) - down @ np.abs(low)) * 1e-12
        return least - slack, most + slack


class Windows:
    """Queries of one block: anchor, window of scores, same or other label; and their best so far."""

    def __init__(self, q, anchor, ids, labels, low, high, same: bool, k: int):
        self.q, self.anchor, self.ids, self.labels = q, anchor, ids, labels
        self.low, self.high, self.same = low, high, same
        self.score = np.full((len(anchor), k), NONE)
        self.best = np.full((len(anchor), k), -1, np.int64)

    def scan(self, tree: Tree, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> int:
        """Search one tree; the number of scores made."""
        q, rows = S.same_width(self.q, rows)
        pad = q.shape[1] - tree.low.shape[1]
        if pad:
            tree.low, tree.high = (np.pad(m, ((0, 0), (0, pad))) for m in (tree.low, tree.high))
        least, most = (m[self.anchor] for m in tree.intervals(q))
        own = self.labels[:, None]
        fits = (tree.least <= own) & (own <= tree.most) if self.same else ~((tree.least == own) & (tree.most == own))
        inside = fits & (most >= self.low[:, None]) & (least <= self.high[:, None])
        key = np.where(inside, np.minimum(most, self.high[:, None].astype(np.float64)), -np.inf)
        queue = np.full(key.shape, -np.inf)
        queue[:, tree.root] = key[:, tree.root]
        active, made = np.arange(len(key)), 0
        while len(active):
            own = queue[active]
            node = own.argmax(axis=1)
            top = own[np.arange(len(active)), node]
            on = (top > -np.inf) & (top >= self.score[active, -1])
            active, node = active[on], node[on]
            queue[active, node] = -np.inf
            for at in np.unique(node):
                who = active[node == at]
                if at >= tree.leaves:
                    a, b = tree.children[int(at)]
                    queue[who, a:b] = key[who, a:b]
                    continue
                part = slice(at * tree.leaf, (at + 1) * tree.leaf)
                anchors, where = np.unique(self.anchor[who], return_inverse=True)
                s = S.product(q[anchors], rows[part])[where]
                made += s.size
                label = labels[part][None, :] == self.labels[who][:, None]
                good = (s >= np.maximum(self.low[who], self.score[who, -1])[:, None]) & (s <= self.high[who][:, None])
                good &= (label if self.same else ~label) & (ids[part][None, :] != self.ids[who][:, None])
                hit, col = np.nonzero(good)
                if len(hit):
                    S.keep_best(self.score, self.best, who[hit], s[hit, col], ids[part][col], NONE)
        return made


def scores_between(score: np.ndarray, least: int = LEAST_PERCENT, most: int = MOST_PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest whole s with least * score <= 100 * s <= most * score, without overflow."""
    whole, rest = np.divmod(score, 100)
    return whole * least - (-(rest * least) // 100), whole * most + rest * most // 100


class Positives:
    """The search for positives of a block of anchors."""

    FOUND = "shard int, place int, vec_id bigint, score bigint"

    def __init__(self, rows: list[dict], k: int):
        parts = [S.opened(r, "<i8") for r in rows]
        ids, labels = (np.concatenate([p[i] for p in parts]) for i in (0, 2))
        n = len(ids)
        self.shard = np.repeat([r["shard"] for r in rows], [r["n"] for r in rows])
        self.place = np.concatenate([np.arange(r["n"]) for r in rows])
        all_scores = np.full(n, NONE), np.full(n, np.iinfo(np.int64).max)
        self.windows = Windows(S.stacked([p[1] for p in parts]), np.arange(n), ids, labels, *all_scores, True, k)

    def scan(self, row: dict) -> None:
        ids, rows, labels = S.opened(row, "<i8")
        self.windows.scan(Tree(rows, labels), ids, rows, labels)

    def result(self) -> pd.DataFrame:
        some = self.windows.score > NONE
        n = some.sum(axis=1)
        return pd.DataFrame({
            "shard": np.repeat(self.shard, n), "place": np.repeat(self.place, n),
            "vec_id": self.windows.best[some], "score": self.windows.score[some],
        })


class Negatives:
    """The search for negatives of a block of anchors and their positives, which ``extra`` lists."""

    FOUND = (
        "shard int, place int, number int, anchor_id bigint, positive_id bigint, positive_score bigint, "
        "negative_id bigint, negative_score bigint"
    )

    def __init__(self, rows: list[dict], k: int, least: int, most: int):
        parts = [S.opened(r, "<i8") for r in rows]
        ids, labels = (np.concatenate([p[i] for p in parts]) for i in (0, 2))
        first = np.cumsum([0, *(r["n"] for r in rows)])
        lists = [np.frombuffer(r["extra"], np.int64).reshape(-1, 4) for r in rows]
        self.shard = np.repeat([r["shard"] for r in rows], [len(x) for x in lists])
        self.place, self.number, self.positive, self.given = np.concatenate(lists).T
        anchor = np.concatenate([x[:, 0] + f for x, f in zip(lists, first)])
        low, high = scores_between(self.given, least, most)
        self.windows = Windows(S.stacked([p[1] for p in parts]), anchor, ids[anchor], labels[anchor], low, high, False, k)

    scan = Positives.scan

    def result(self) -> pd.DataFrame:
        w = self.windows
        some = w.score > NONE
        n = some.sum(axis=1)
        rep = lambda x: np.repeat(x, n)
        return pd.DataFrame({
            "shard": rep(self.shard), "place": rep(self.place), "number": rep(self.number), "anchor_id": rep(w.ids),
            "positive_id": rep(self.positive), "positive_score": rep(self.given),
            "negative_id": w.best[some], "negative_score": w.score[some],
        })


def hard_negatives(
    vectors: DataFrame, every: int = QUERY_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = LEAST_PERCENT, most: int = MOST_PERCENT, shard_rows: int = S.SHARD_ROWS,
) -> DataFrame:
    """For each anchor and positive its hard negatives; ``vectors``: (vec_id, label, embedding)."""
    labelled = S.quantized(vectors.where("label is not null"), SCALE, "label")

    def arrange(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        return tiled(rows, labels), b""

    stored = S.build(labelled, "<i8", every, arrange, "negative-shards", shard_rows)
    anchors = S.queries(stored, every)
    found = S.search(stored, anchors, lambda rows: Positives(rows, positives), Positives.FOUND)
    first = Window.partitionBy("shard", "place").orderBy(F.desc("score"), "vec_id")
    pairs = found.withColumn("number", F.row_number().over(first)).where(F.col("number") <= positives)
    entry = F.struct("place", "number", "vec_id", "score")
    lists = pairs.groupBy("shard").agg(F.sort_array(F.collect_list(entry)).alias("pairs"))  # at most a shard's rows

    def packed(batches):
        for frame in batches:
            frame["extra"] = [
                np.array([[p["place"], p["number"], p["vec_id"], p["score"]] for p in own], np.int64).tobytes()
                for own in frame["pairs"]
            ]
            yield frame.drop(columns="pairs")

    asked = anchors.drop("extra").join(lists, "shard")
    asked = asked.mapInPandas(packed, "shard int, n int, dims int, ids binary, data binary, labels binary, extra binary")
    found = S.search(stored, asked, lambda rows: Negatives(rows, negatives, least, most), Negatives.FOUND)
    each = Window.partitionBy("shard", "place", "number").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

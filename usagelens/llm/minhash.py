"""MinHash near-duplicates by an inverted join on signature coordinates.

Each document has a set of word shingles, as 64-bit hashes, and a signature of the smallest value of
64 hash functions over it. Documents with equal sets are one class, searched once. A class is posted
under each of its (coordinate, value) pairs that another class shares. Two sets of the wanted
similarity agree in at least ``MATCHES`` coordinates but for a chance below 1e-5, so

- a class with fewer shared pairs has no partner and drops out;
- of the shared pairs, ordered by how few classes hold them, only the first
  ``shared - MATCHES + 1`` need posting: partners meet under one of those (prefix filter). The long
  posting lists of passages that many documents share are thereby skipped, and are looked at only
  when the collisions of a pair that met elsewhere are counted (skip merging);
- pairs whose collisions reach ``MATCHES`` are confirmed on their full sets.

Only components are asked for, so pairs inside a posting list are not all formed. First each list
links its members to one pivot, the member whose pairs are the commonest, and components grow from
those links; members left out are compared with the most central one of the rest. What two members
share with the pivot then bounds how alike they can be. Only pairs across components that this bound leaves open, or that share a shingle rare beside the pivot, are
compared.
That search is complete: a pair it leaves out is connected already or cannot be alike enough.

Edge cases: a null text, or one without words, has 0 shingles and no links; a text with fewer words
than a shingle has one, the whole sequence; rows without doc_id are kept with a null component and
link nothing; repeated rows are copies of each other; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.components import components, extended
from usagelens.storage import written

WORDS = 4
PERCENT = 80
COORDINATES = 64
MATCHES = 36  # a pair at 0.8 has 51 on average; fewer than 36 in about 5 of a million
SEED = 11
USUAL = 16  # members of a pivot that must hold a shingle to count it as the pivot's
SEGMENT = 1 << 20  # bytes hashed at once

_rng = np.random.default_rng(SEED)
_ODD = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE = _ODD(256)
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
MULTIPLY, ADD = _ODD(COORDINATES), _ODD(COORDINATES)
PLACE = _ODD(16)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    space, out, at = SPACE[data], [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):
            gap = int(space[end:].argmax())
            end = end + gap if space[end + gap] else len(data)
        up, down = powers(max(1024, end - at))
        edge = np.diff(np.concatenate([[True], space[at:end], [True]]).view(np.int8))
        starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(end - at + 1, np.uint64)
        np.cumsum(BYTE[data[at:end]] * up[: end - at], out=sums[1:])
        out.append(mix((sums[stops] - sums[starts]) * down[starts] + stops.astype(np.uint64) - starts.astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    size = min(words, len(w))
    n = len(w) - size + 1
    g = np.full(n, size, np.uint64)
    for i in range(size):
        g += w[i : i + n] * PLACE[i]
    return np.unique(mix(g))


def signature(g: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(g), 2048):
        h = (g[at : at + 2048, None] * MULTIPLY + ADD) >> np.uint64(32)
        np.minimum(least, h.min(axis=0).astype(np.uint32), out=least)
    return least.view(np.int32)


def set_key(g: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(int(mix(g ^ PLACE[i]).sum().view(np.int64)) for i in (10, 11))


SETS = "doc_id bigint, row bigint, n_shingles bigint, k1 bigint, k2 bigint, sig array<int>"
FULL = "k1 bigint, k2 bigint, members binary"


def shingle_sets(docs: DataFrame, words: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document its set's size, name and signature, and bigint columns of its own to ``carry``.

    ``row`` names the row once this is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, k1, k2, sigs = [], [], [], []
            for text in batch.column(1):
                g = shingles(text.as_py(), words)
                key = set_key(g)
                n.append(len(g))
                k1.append(key[0])
                k2.append(key[1])
                sigs.append(signature(g))
            values = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(range(row, row + len(n)), pa.int64()), pa.array(n, pa.int64()),
                 pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(offsets, values),
                 *batch.columns[2:]],
                names=["doc_id", "row", "n_shingles", "k1", "k2", "sig", *carry],
            )
            row += len(n)

    return docs.select("doc_id", "text", *carry).mapInArrow(run, SETS + "".join(f", {c} bigint" for c in carry))


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                g = shingles(text.as_py(), words)
                k1, k2 = set_key(g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k1], pa.int64()), pa.array([k2], pa.int64()), pa.array([g.tobytes()], pa.binary())],
                    names=["k1", "k2", "members"],
                )

    return docs.select("text").mapInArrow(run, FULL)


def compared(pairs: DataFrame, rest: bool) -> DataFrame:
    """(u, v, both, rest, n_u, n_v) of (u, v, set_u, set_v, n_u, n_v): shingles in both, and those of v that u lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, more = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = np.intersect1d(x, y, assume_unique=True)
                both.append(len(same))
                more.append(np.setdiff1d(y, same, assume_unique=True).view(np.int64) if rest else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(more, pa.list_(pa.int64())),
                 *batch.columns[4:]],
                names=["u", "v", "both", "rest", "n_u", "n_v"],
            )

    return pairs.mapInArrow(run, "u bigint, v bigint, both bigint, rest array<bigint>, n_u bigint, n_v bigint")


def alike(both: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * both >= percent * (n_a + n_b - both)


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, matches: int = MATCHES
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return linked(docs, words, percent, matches).select("doc_id", "n_shingles", "component_id", "kept")


def linked(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, matches: int = MATCHES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``near_duplicates`` with bigint columns to ``carry`` and ``component``, which names a row's component.

    It differs from component_id where rows with one id lie in several components; it is null for rows
    that link nothing by definition.
    """
    sets = written(shingle_sets(docs, words, carry), "sets")
    real = sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = written(
        real.groupBy("k1", "k2").agg(
            F.min("row").alias("node"), F.min("doc_id").alias("first_doc"), F.min("n_shingles").alias("n")
        ),
        "classes",
    )
    one = classes.select(F.col("node").alias("row"))
    posted = written(real.join(one, "row", "leftsemi").select(F.col("row").alias("node"), "sig"), "posted")
    pairs = posted.select("node", F.posexplode("sig").alias("at", "value"))
    pairs = pairs.select("node", F.xxhash64("at", "value").alias("pair"))
    held = pairs.groupBy("pair").agg(F.count("*").alias("holders")).where("holders > 1")
    rare_first = F.sort_array(F.collect_list(F.struct("holders", "pair")))
    own = pairs.join(held, "pair").groupBy("node").agg(rare_first.alias("own")).where(F.size("own") >= matches)
    own = own.select(
        "node", F.col("own.pair").alias("own"),
        F.slice("own.pair", F.lit(1), F.size("own") - (matches - 1)).alias("prefix"),
        F.aggregate("own.holders", F.lit(0.0), lambda a, h: a + F.log2(h)).alias("weight"),
    )
    own = written(own.join(classes.select("node", "n"), "node"), "own-pairs")
    posts = own.select("node", "weight", "n", F.explode("prefix").alias("pair"))
    met = posts.groupBy("pair").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.max_by("node", "weight").alias("pivot")
    ).where("low < high")
    posts = written(posts.drop("weight").join(met.select("pair", "pivot"), "pair"), "posts")

    live = classes.join(posts.select("node").distinct(), "node", "leftsemi")
    named = live.select("k1", "k2", "node")
    texts = docs.select("doc_id", "text").join(live.select(F.col("first_doc").alias("doc_id")).distinct(), "doc_id", "leftsemi")
    full = written(
        full_sets(texts, words).join(named, ["k1", "k2"]).select("node", "members").dropDuplicates(["node"]), "full-sets"
    )

    def sized(found: DataFrame, *more: str) -> DataFrame:
        """``found`` (u, v) with the sizes of both sets, and ``more`` of their columns."""
        side = lambda x: own.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", *more)))
        return found.join(side("u"), "u").join(side("v"), "v")

    def colliding(found: DataFrame) -> DataFrame:
        """The (u, v, n_u, n_v) of ``found`` with enough collisions."""
        p = sized(found, "own").where(F.size(F.array_intersect("own_u", "own_v")) >= matches)
        return p.select("u", "v", "n_u", "n_v")

    def verified(p: DataFrame, rest: bool) -> DataFrame:
        """Distinct (u, v, n_u, n_v) compared on their full sets."""
        blob = lambda x: full.select(F.col("node").alias(x), F.col("members").alias(f"set_{x}"))
        sets_of = p.join(blob("u"), "u").join(blob("v"), "v").select("u", "v", "set_u", "set_v", "n_u", "n_v")
        return written(compared(sets_of, rest), "compared")

    def links_of(pairs: DataFrame) -> DataFrame:
        return pairs.where(alike(F.col("both"), F.col("n_u"), F.col("n_v"), percent)).select("u", "v")

    stars = posts.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    near = verified(colliding(stars), True)
    labels = written(components(links_of(near)), "labels")
    groups = Groups(posts, near, labels, own.select("node", "own"), matches)
    labels = extended(labels, links_of(verified(colliding(groups.with_centres()), False)))
    # Stored, as one plan of the search and the comparison would be the largest of all.
    left = written(groups.left(labels, percent), "left")
    labels = extended(labels, links_of(verified(sized(left), False)))

    least = classes.join(labels, "node").groupBy("label").agg(F.min("first_doc").alias("component"))
    smallest = labels.join(least, "label").select("node", "label", F.col("component").alias("smallest"))
    known = classes.join(smallest, "node", "left").select(
        "k1", "k2", F.coalesce("label", "node").alias("component"), F.coalesce("smallest", "first_doc").alias("smallest")
    )
    has = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    ends = [F.when(has, F.col(k)).alias(k) for k in ("k1", "k2")]
    out = sets.select("doc_id", "n_shingles", *carry, *ends).join(known, ["k1", "k2"], "left")
    component_id = F.coalesce("smallest", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"),
        "component", *carry,
    )


def _few_with_all(rows: DataFrame, key: list[str], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Of each key whose rows have several labels: rows outside the commonest label, and all rows."""
    sizes = rows.groupBy(*key, label).agg(F.count("*").alias("size"))
    main = sizes.groupBy(*key).agg(F.max_by(label, "size").alias("main"), F.count("*").alias("parts"))
    rows = written(rows.join(main.where("parts > 1").drop("parts"), key), "open")
    few = rows.where(F.col(label) != F.col("main"))
    return few.select(*key, *(F.col(c).alias(f"a_{c}") for c in few.columns if c not in (*key, "main"))), rows


def _apart() -> Column:
    """Each pair across labels once: its first member lies outside the commonest label."""
    return (F.col("label") != F.col("a_label")) & (
        (F.col("label") == F.col("main")) | (F.col("a_node") < F.col("node"))
    )


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


class Groups:
    """Members of posting lists by the pivot they were compared with, and the pairs still to compare.

    Let P be a pivot p and the shingles that ``USUAL`` or more of those compared with p have beside
    it. ``members`` holds how many shingles of each member are in P, for pivots whose members are not
    all connected; ``rest`` holds the shingles beside p.
    """

    def __init__(self, posts: DataFrame, near: DataFrame, labels: DataFrame, signatures: DataFrame, matches: int):
        self.signatures, self.matches = signatures, matches
        own = near.select(F.col("u").alias("pivot"), F.col("v").alias("node"), "both", "rest")
        self.lists = written(posts.join(own.drop("rest"), ["pivot", "node"], "left"), "lists")
        group = self.lists.where("both is not null").select("pivot", "node", "both", "n").distinct()
        open_ = _few_with_all(_labelled(group, labels), ["pivot"])[1]
        self.rest = written(
            open_.select("pivot", "node").join(
                own.select("pivot", "node", F.explode("rest").alias("shingle")), ["pivot", "node"]
            ),
            "rest",
        )
        self.held = self.rest.groupBy("pivot", "shingle").agg(F.count("*").alias("holders")).where("holders > 1")
        usual = self.held.where(F.col("holders") >= USUAL).select("pivot", "shingle")
        more = self.rest.join(usual, ["pivot", "shingle"]).groupBy("pivot", "node").agg(F.count("*").alias("more"))
        both = F.col("both") + F.coalesce("more", F.lit(0))
        open_ = open_.join(more, ["pivot", "node"], "left").withColumn("both", both)
        self.open = written(open_.drop("more"), "members")
        self.members = self.open.select("pivot", "node", "both", "n")

    def with_centres(self) -> DataFrame:
        """(u, v): members outside the commonest component with that component's member nearest to P."""
        centre = self.open.where("label = main").groupBy("pivot").agg(F.max_by("node", "both").alias("centre"))
        met = self.open.where("label <> main").join(centre, "pivot")
        return met.select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct()

    def left(self, labels: DataFrame, percent: int) -> DataFrame:
        """(u, v): pairs in different components that may still be alike.

        Two members of a list that were both compared with its pivot p either share a shingle outside
        P, and meet under it with fewer than ``USUAL`` others; or all they share is in P, so at most
        m = min(|a & P|, |b & P|) shingles, and m must do for their sizes. Members not compared with
        p are paired with all others of the list whose size allows it.
        """
        def collide(few: DataFrame, every: DataFrame, key: list[str], fits: Column) -> DataFrame:
            """Pairs of a key that fit and have enough collisions, counted where they meet."""
            a = few.join(self.signatures.select(F.col("node").alias("a_node"), F.col("own").alias("a_own")), "a_node")
            b = every.join(self.signatures, "node")
            enough = F.size(F.array_intersect("a_own", "own")) >= self.matches
            return a.join(b, key).where(_apart() & fits & enough)

        few, every = _few_with_all(_labelled(self.members, labels), ["pivot"])
        m = F.least("a_both", "both")
        # With the smallest other member a member must be able to reach the likeness at all.
        least_n = every.groupBy("pivot").agg(F.min("n").alias("least_n"))
        few = few.join(least_n, "pivot").where(alike(F.col("a_both"), F.col("a_n"), F.col("least_n"), percent)).drop("least_n")
        bounded = collide(few, every, ["pivot"], alike(m, F.col("a_n"), F.col("n"), percent))

        seldom = self.held.where(F.col("holders") < USUAL).select("pivot", "shingle")
        rest = self.rest.join(seldom, ["pivot", "shingle"]).join(
            every.select("pivot", "node", "label"), ["pivot", "node"]
        )
        few, every = _few_with_all(rest, ["pivot", "shingle"])
        shared = collide(few, every, ["pivot", "shingle"], F.lit(True))

        far = self.lists.select("pair", "node", "n", F.col("both").isNull().alias("far"))
        few, every = _few_with_all(_labelled(far, labels), ["pair"])
        fits = 100 * F.least("a_n", "n") >= percent * F.greatest("a_n", "n")
        met = collide(few, every, ["pair"], (F.col("far") | F.col("a_far")) & fits)

        ends = [F.least("a_node", "node").alias("u"), F.greatest("a_node", "node").alias("v")]
        return bounded.select(ends).unionByName(shared.select(ends)).unionByName(met.select(ends)).distinct()

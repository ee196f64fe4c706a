"""Phrase collocations from sorted suffix pointers.

Words of a text are numbered, and every word position is a pointer to the suffix of up to ``longest``
words that begins there and ends with its piece. Pointers are sorted by multikey three-way quicksort:
a partition is split by one word into less, equal and greater, and the equal part goes on with the
next word, down to the maximum depth. Equal partitions at the maximum depth become one row with their
size, so copies are added up before they are sent.

Rows are routed by their leading words: each of ``routes`` ranges of the order of all suffixes goes to
one task, so a hot word, pair or passage is divided by the words that follow it. Within a range rows come in order, and
the sizes of equal partitions are exact counts: at each depth, partitions below the threshold are
abandoned with all that is below them. A partition at the edge of a range or a batch may go on
elsewhere, so it is kept and its parts are added up. Ranges come from a bounded sample of documents;
they decide where a row is counted, not whether.

Edge cases: a null text is empty; a null language is ``und``; texts of any length are read in segments
that look ahead over their end; repeated rows count each; a table without candidates gives no rows;
other columns are not looked at. Counts and products are exact while 1000 * a * n has at most 38
digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.storage import written

LONGEST = 5
LEAST = 100
TOP = 2000
ROUTE_BYTES = 8 << 20  # of text, a range
MOST_ROUTES = 1 << 17  # bounds what every task holds of ranges; longer ranges are sorted on disk and read in batches
EDGE_BYTES = 64  # of a key, that a range begins with
SAMPLE_BYTES = 16 << 20  # of text, that ranges are taken from
KEYS_A_ROUTE = 32
MOST_KEYS = 1 << 20
SEGMENT = 2 << 20  # bytes of text whose pointers are sorted at once
CUTOFF = 4096  # partitions up to this size are finished by one comparison sort
BATCH_ROWS = 1 << 17
SALTS = 32
UNKNOWN = "und"

_KIND = np.zeros(256, np.uint8)  # 0: word, 1: blank, 2: end of a piece
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_EDGE = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
SUFFIXES = "route int, key binary, count bigint"
COUNTS = "lang string, words int, phrase string, a bigint"


def segments(text: bytes, longest: int = LONGEST, size: int = SEGMENT) -> Iterator[tuple[bytes, int]]:
    """Parts of a text with the bytes of own words; what follows them is there to look ahead."""
    ahead = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % (longest - 1))
    begin = 0
    while len(text) - begin > size:
        edge = _EDGE.search(text, begin + size)
        if edge is None:
            break
        cut = edge.start()
        yield text[begin : ahead.match(text, cut).end()], cut - begin
        begin = cut
    yield (text[begin:] if begin else text), len(text) - begin


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where words start, the number of their piece, and the words themselves."""
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    own = pa.Array.from_buffers(
        pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())]
    )
    return start, piece, own


def multikey_sort(columns: list[np.ndarray], pointers: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    """``pointers`` in the order of their keys, one number a column; 0 ends a key."""
    out = pointers.copy()
    parts = [(0, len(out), 0)]
    while parts:
        lo, hi, depth = parts.pop()
        if hi - lo < 2 or depth == len(columns):
            continue
        own = out[lo:hi]
        if hi - lo <= cutoff:
            out[lo:hi] = own[np.lexsort([c[own] for c in columns[depth:][::-1]])]
            continue
        keys = columns[depth][own]
        some = np.sort(keys[:: max(1, len(keys) // 255)])
        pivot = some[len(some) // 2]
        less, more = keys < pivot, keys > pivot
        a, b = np.count_nonzero(less), np.count_nonzero(more)
        equal = ~(less | more)
        out[lo:hi] = np.concatenate([own[less], own[equal], own[more]])
        parts.append((lo, lo + a, depth))
        parts.append((hi - b, hi, depth))
        if pivot:
            parts.append((lo + a, hi - b, depth + 1))
    return out


def _escaped(word: bytes) -> bytes:
    return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")


def _plain(word: bytes) -> bytes:
    return word.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01")


def _ranks(dictionary: pa.DictionaryArray) -> tuple[np.ndarray, pa.Array]:
    """For each value its place from 1 in byte order, and the values in that order."""
    values = dictionary.dictionary
    order = pc.sort_indices(values)
    rank = np.empty(len(values), np.int32)
    rank[order.to_numpy()] = np.arange(1, len(values) + 1, dtype=np.int32)
    return rank[dictionary.indices.to_numpy()], values.take(order)


def sorted_suffixes(
    parts: list[tuple[bytes, bytes, int]], longest: int = LONGEST, cutoff: int = CUTOFF
) -> tuple[pa.Array, np.ndarray]:
    """Distinct suffixes of (language, lower-cased text, bytes of own words), as keys in order, and their counts."""
    data = np.frombuffer(b"\n".join(p[1] for p in parts), np.uint8)
    start, piece, words = words_of(data)
    if not len(start):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum([len(p[1]) + 1 for p in parts])])
    of = np.searchsorted(first, start, "right") - 1
    own = start - first[of] < np.array([p[2] for p in parts])[of]
    langs = sorted({p[0] for p in parts})
    at = {lang: i + 1 for i, lang in enumerate(langs)}
    ids, vocabulary = _ranks(words.dictionary_encode())
    if (data < 2).any():
        vocabulary = pa.array([_escaped(w) for w in vocabulary.to_pylist()], pa.binary())
    n = len(ids)
    columns = [np.array([at[p[0]] for p in parts], np.int32)[of]]
    for k in range(longest):
        c = np.zeros(n, np.int32)
        m = max(0, n - k)
        c[:m] = np.where(piece[k:] == piece[:m], ids[k:], 0)
        columns.append(c)
    order = multikey_sort(columns, np.flatnonzero(own), cutoff)
    if not len(order):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        v = c[order]
        new[1:] |= v[1:] != v[:-1]
    run = np.flatnonzero(new)
    counts = np.diff(run, append=len(order))
    head = order[run]
    names = pa.array([_escaped(lang) for lang in langs], pa.binary())
    fields = [names.take(pa.array(columns[0][head] - 1))]
    for c in columns[1:]:
        v = c[head]
        fields.append(vocabulary.take(pa.array(v - 1, mask=v == 0)))
    return pc.binary_join_element_wise(*fields, b"\x00", null_handling="skip"), counts


def suffixes(docs: DataFrame, bounds: list[bytes], longest: int = LONGEST, segment: int = SEGMENT) -> DataFrame:
    """Counted suffixes of (lang, text) with the range each belongs to."""
    width = f"S{EDGE_BYTES}"
    # At most MOST_ROUTES heads of keys. Padding with zeros keeps their order, as 0 is below all that words hold.
    shared = docs.sparkSession.sparkContext.broadcast(np.array(bounds, width))

    def made(parts) -> pa.RecordBatch:
        keys, counts = sorted_suffixes(parts, longest)
        route = np.searchsorted(shared.value, np.array(keys.to_pylist(), width), "right").astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(route), keys, pa.array(counts)], names=["route", "key", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                lang = lang.as_py().encode()
                for part, own in segments(text.as_buffer().to_pybytes().lower(), longest, segment):
                    held.append((lang, part, own))
                    size += len(part)
                    if size >= segment:
                        yield made(held)
                        held, size = [], 0
        if held:
            yield made(held)

    return docs.select("lang", "text").mapInArrow(run, SUFFIXES)


def phrase_counts(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Phrases with their counts, from suffixes in order; parts at edges may be below ``least``."""

    def counted(keys: pa.Array, weights: np.ndarray):
        """Counts of one run of keys of a range: (language, words, phrase, count)."""
        parts = pc.split_pattern(keys, b"\x00")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        ids, vocabulary = _ranks(pc.list_flatten(parts).dictionary_encode())
        begin = np.cumsum(sizes) - sizes
        alive = np.arange(len(keys))  # rows of partitions that are not abandoned
        lead = np.zeros(len(keys), np.int64)  # the partition each of them is in
        found = []
        last = len(keys) - 1
        for depth in range(int(sizes.max(initial=0))):
            on = sizes[alive] > depth
            alive, lead = alive[on], lead[on]
            if not len(alive):
                break
            v = ids[begin[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (v[1:] != v[:-1]) | (lead[1:] != lead[:-1])
            run = np.flatnonzero(new)
            total = np.add.reduceat(weights[alive], run)
            stop = np.append(run[1:], len(alive)) - 1
            keep = (total >= least) | (alive[run] == 0) | (alive[stop] == last)
            found.append((alive[run][keep], np.full(int(keep.sum()), depth), total[keep]))
            part = np.cumsum(new) - 1
            alive, lead = alive[keep[part]], part[keep[part]]
        return found, begin, ids, vocabulary

    def rows_of(keys, weights) -> pa.RecordBatch:
        found, begin, ids, vocabulary = counted(keys, weights)
        row, depth, total = (np.concatenate(x) for x in zip(*found))
        words = lambda i, d: [vocabulary[int(j) - 1].as_py() for j in ids[begin[i] : begin[i] + d + 1]]
        names = [[_plain(w).decode("utf-8", "replace") for w in words(i, d)] for i, d in zip(row, depth)]
        return pa.RecordBatch.from_arrays(
            [pa.array([w[0] for w in names], pa.string()), pa.array(depth, pa.int32()),
             pa.array([" ".join(w[1:]) for w in names], pa.string()), pa.array(total, pa.int64())],
            names=["lang", "words", "phrase", "a"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for batch in batches:
            route = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(route)) + 1).tolist(), len(route)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and (route[a] != now or size >= BATCH_ROWS):
                    yield _flush(held, rows_of)
                    held, size = [], 0
                now = route[a]
                held.append(batch.slice(a, b - a))
                size += b - a
        if held:
            yield _flush(held, rows_of)

    return rows.mapInArrow(run, COUNTS)


def _flush(held: list[pa.RecordBatch], rows_of) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    return rows_of(table["key"].combine_chunks(), table["count"].to_numpy())


def range_bounds(docs: DataFrame, longest: int = LONGEST, route_bytes: int = ROUTE_BYTES) -> list[bytes]:
    """Heads of keys that cut the order of suffixes into ranges of about ``route_bytes`` of text each."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    routes = min(MOST_ROUTES, max(2 * cores, -(-total // route_bytes)))

    def share(wanted: float, *key):
        return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int(min(1.0, wanted) * (1 << 30))

    some = docs.where(share(SAMPLE_BYTES / max(1, total), "text"))
    words = min(total, SAMPLE_BYTES) / 6  # about one key a word
    wanted = min(MOST_KEYS, KEYS_A_ROUTE * routes)
    keys = suffixes(some, [], longest).where(share(wanted / max(1.0, words), "key")).select("key")
    keys = sorted({bytes(r["key"])[:EDGE_BYTES] for r in keys.collect()})
    return sorted({keys[i * len(keys) // routes] for i in range(1, routes)}) if keys else []


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, inside_percent: int = 100,
    route_bytes: int = ROUTE_BYTES, segment: int = SEGMENT,
) -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    A candidate occurs at least ``least`` times. It is dropped if a longer candidate that contains it
    occurs at least ``inside_percent`` of its times.
    """
    d = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    bounds = range_bounds(d, longest, route_bytes)
    # Ranges follow the order of keys, so rows in the order of keys are in that of ranges too.
    routed = suffixes(d, bounds, longest, segment).repartitionById(len(bounds) + 1, "route").sortWithinPartitions("key")
    counts = phrase_counts(routed, least).groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"))
    counts = written(counts.where((F.col("a") >= least) | (F.col("words") == 0)), "phrase-counts")
    totals = counts.where("words = 0").select("lang", F.col("a").alias("n"))
    phrases = counts.where("words > 0").select("lang", "phrase", "a")
    candidates = counts.where("words > 1")

    w = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", w.alias("w"), cut).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"),
    )
    part = lambda name, key: phrases.select("lang", F.col("phrase").alias(key), F.col("a").alias(name))
    cuts = cuts.join(part("l", "first"), ["lang", "first"]).join(part("r", "rest"), ["lang", "rest"])
    # A language may hold most candidates, so its total goes to several places.
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    cuts = cuts.join(totals.select("lang", "n", spread), ["lang", "salt"])
    big = lambda c: F.col(c).cast("decimal(17,0)")
    cuts = cuts.withColumns({"up": F.lit(1000).cast("decimal(4,0)") * big("a") * big("n"), "down": big("l") * big("r")})
    cuts = cuts.withColumn("score", F.expr("up div down"))
    lowest = F.min(F.struct("score", "k", "l", "r", "n")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)

    # All phrases of two words and more inside a candidate, with the most that any such candidate has.
    spans = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.transform(
            F.sequence(F.lit(2), F.size("w") - i + 1), lambda m: F.when(m < F.size("w"), F.array_join(F.slice("w", i, m), " "))
        ))), lambda x: x.isNotNull())
    inner = candidates.where("words > 2").select("lang", "a", w.alias("w"))
    inner = inner.select("lang", "a", F.explode(spans).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull()
        | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * inside_percent)
    )
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Language ID by words first, backing off to shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is read from left to right by
the longest known n-gram at each place, from four characters down to one. The language with the
largest sum wins; its score is its share after a softmax over the sums, divided by the root of the
number of words, so that long texts do not all score 1.

The model is fitted on a bounded sample of labelled rows, chosen by hash, and holds a bounded number
of words and n-grams: one matrix of numbers, and the row of each word or n-gram. A word is a run of
letters (Unicode's category L), when learning and when predicting.

Edge cases: ``und`` with score 0 for a null text, a text without letters, or without a model (no
labelled rows); texts of any length are read whole; repeated rows are predicted each on their own; an
empty table gives an empty result; other columns are carried along and not looked at, and columns
named like the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.storage import written

SAMPLE_ROWS = 20000
MAX_WORDS = 200_000
MAX_GRAMS = 100_000
LEAST_ROWS = 200  # of a language, whatever the bounds
LEAST_ENTRIES = 1000  # words, and n-grams, of a language, whatever the bounds
LONGEST_GRAM = 4
CACHE = 50_000  # unseen words whose logs a worker keeps
CACHED_CHARS = 64  # of the longest of them
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
EXACT = regex.compile(r"\p{L}+")
SMOOTH = 0.5


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def words_of(text: str) -> Iterable[str]:
    for run in LETTERS.findall(text.lower()):
        if run.isalpha():
            yield run
        else:  # numerals that are no digits, as in a fraction, are no letters
            yield from EXACT.findall(run)


class Model:
    """Log frequencies per language of words and n-grams, a row of one matrix each."""

    def __init__(self, words: dict[str, int], grams: dict[str, int], logs: np.ndarray, langs: list[str]):
        self.words, self.grams, self.langs = words, grams, langs
        self.logs = logs  # of all words and n-grams
        self.cache: dict[str, int] = {}
        self.kept = np.zeros((0, logs.shape[1]), np.float32)

    def unseen(self, word: str) -> np.ndarray:
        padded, i, steps = f" {word} ", 0, 0
        out = np.zeros(self.logs.shape[1], np.float32)
        while i < len(padded):
            for size in range(LONGEST_GRAM, 0, -1):
                known = self.grams.get(padded[i : i + size])
                if known is not None:
                    out += self.logs[known]
                    steps += 1
                    break
            else:
                size = 1
            i += max(1, size - 1)
        return out / max(1, steps)

    def _places(self, words: Iterable[str]) -> list[int | str]:
        """Rows of words: of the matrix, or after its end of the unseen words kept; else the word."""
        if not len(self.kept):
            self.kept = np.zeros((2 * CACHE, self.logs.shape[1]), np.float32)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        n, spare, out = len(self.logs), len(self.kept), []
        for word in words:
            at = self.words.get(word)
            if at is None and (at := self.cache.get(word)) is None:
                if len(word) > CACHED_CHARS or len(self.cache) == spare:
                    out.append(word)
                    continue
                self.kept[len(self.cache)] = self.unseen(word)
                at = self.cache[word] = n + len(self.cache)
            out.append(at)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        seen = Counter(words_of(text)) if text else None
        if not seen or not self.langs:
            return UNKNOWN, 0.0
        counts = np.fromiter(seen.values(), np.float64, len(seen))
        places = self._places(seen)
        sums = np.zeros(self.logs.shape[1])
        at = np.array([p if isinstance(p, int) else -1 for p in places])
        known, kept = (at >= 0) & (at < len(self.logs)), at >= len(self.logs)
        sums += counts[known] @ self.logs[at[known]]
        sums += counts[kept] @ self.kept[at[kept] - len(self.logs)]
        for i in np.flatnonzero(at < 0):
            sums += counts[i] * self.unseen(places[i])
        sums /= math.sqrt(counts.sum())
        odds = np.exp(sums - sums.max())
        best = int(sums.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def even_share(sizes: list[int], most: int, least: int) -> int:
    """How much each may have, so that all have about ``most``: what small ones leave goes to the others."""
    left, level = most, least
    for i, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        level = max(level, share)
        left -= min(n, share)
    return level


def _sizes(df: DataFrame) -> dict[str, int]:
    return {r["lang"]: r["count"] for r in df.groupBy("lang").count().collect()}  # one row a language


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from about ``sample_rows`` labelled rows; the most frequent words and n-grams stay.

    Each bound is shared evenly by language: what one leaves goes to those with more, so a language is
    cut only if it has more than its share, and all of it stays up to ``LEAST_ROWS`` and ``LEAST_ENTRIES``.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = _sizes(labelled)
    rows = even_share(list(sizes.values()), sample_rows, LEAST_ROWS)
    shares = [(lang, int(min(1.0, rows / n) * (1 << 30))) for lang, n in sizes.items()]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, below bigint")
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("below")
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    sample = labelled.join(F.broadcast(shares), "lang").where(pick)
    counts = written(sample.select("lang", words.alias("word")).groupBy("lang", "word").count(), "lang-words")
    grams = counts.select("lang", "count", F.explode(_grams("word")).alias("gram")).groupBy("lang", "gram")
    grams = written(grams.agg(F.sum("count").alias("count")), "lang-grams")

    def bounded(df: DataFrame, key: str, most: int):
        each = even_share(list(_sizes(df.where("count > 1")).values()), most, LEAST_ENTRIES)
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), key))
        top = df.withColumn("rank", rank).where((F.col("rank") <= each) & ((F.col("count") > 1) | (F.col("rank") <= LEAST_ENTRIES)))
        return [tuple(r) for r in top.select("lang", key, "count").collect()]

    return _model(bounded(counts, "word", max_words), bounded(grams, "gram", max_grams))


def _grams(word: str):
    padded = F.concat(F.lit(" "), F.col(word), F.lit(" "))
    runs = [
        F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i, n=n: F.substring(padded, i, F.lit(n)))
        for n in range(1, 4)
    ]
    longest = F.when(
        F.length(padded) >= LONGEST_GRAM,
        F.transform(F.sequence(F.lit(1), F.length(padded) - LONGEST_GRAM + 1), lambda i: F.substring(padded, i, F.lit(LONGEST_GRAM))),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(*runs, longest)


def _model(words: list[tuple], grams: list[tuple]) -> Model:
    langs = sorted({r[0] for r in words} | {r[0] for r in grams})
    at = {lang: i for i, lang in enumerate(langs)}

    def logs(rows: list[tuple], first: int) -> tuple[dict[str, int], np.ndarray]:
        place: dict[str, int] = {}
        for _, key, _ in rows:
            place.setdefault(key, first + len(place))
        counts = np.zeros((len(place), max(1, len(langs))))
        for lang, key, count in rows:
            counts[place[key] - first, at[lang]] = count
        base = np.log(counts.sum(axis=0) + SMOOTH * max(1, len(place)))
        return place, (np.log(counts + SMOOTH) - base).astype(np.float32)

    words_at, parts = logs(words, 0)
    grams_at, matrix = {}, [parts]
    for size in range(1, LONGEST_GRAM + 1):  # each length has its own frequencies
        own, part = logs([r for r in grams if len(r[1]) == size], sum(map(len, matrix)))
        grams_at.update(own)
        matrix.append(part)
    return Model(words_at, grams_at, np.concatenate(matrix), langs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred and lang_score, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    @F.arrow_udf("lang_pred string, lang_score double")
    def predicted(texts: pa.Array) -> pa.Array:
        own = shared.value
        got = [own.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
            names=["lang_pred", "lang_score"],
        )

    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    inner = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)]  # no clash with what is made here
    got = docs.select(*inner, predicted("text").alias("made"))
    kept = [F.col(f"in_{i}").alias(c) for i, c in enumerate(names)]
    return got.select(*kept, "made.lang_pred", "made.lang_score")


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = fit(docs.select("doc_id", "text", "lang"), **bounds)
    scored = predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

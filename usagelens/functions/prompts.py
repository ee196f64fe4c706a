"""Prompt text to irreversible aggregates: salted hash and bottom-k shingle sketch.

Everything here is narrow and applied in the scan stage, so text reaches no shuffle, cache or
written table. One Arrow function hashes shingles, as an expression takes about 3 us for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sketch size, shingle width in words, and white space between words.
SKETCH_SIZE = 128
SHINGLE_WORDS = 3
WORD_GAP = r"(?U)[\s\x1c-\x1f]+"

# Our own salt. It only separates our hashes from plain SHA-256 of the text.
DEFAULT_SALT = "usagelens/1:"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), WORD_GAP), "")


def normalized(text: Column) -> Column:
    return F.array_join(words(text), " ")


def salted_hash(word_array: Column, salt: str = DEFAULT_SALT) -> Column:
    """Hex SHA-256 of salt and normalized text; null for a blank text."""
    digest = F.sha2(F.concat(F.lit(salt), F.array_join(word_array, " ")), 256)
    return F.when(F.size(word_array) > 0, digest)


def shingle_hash(shingle: Column) -> Column:
    """60-bit hash, never negative, so signed order is numeric order in any SQL engine."""
    return F.conv(F.substring(F.md5(shingle), 1, 15), 16, 10).cast("bigint")


def fast_shingle_hash(shingle: Column) -> Column:
    """64-bit hash in one JVM pass, about twice as fast, but known to Spark only."""
    return F.xxhash64(shingle)


def shingle_hashes(word_array: Column, hasher=shingle_hash) -> Column:
    """Hash of every run of three words; a shorter text is one shingle."""
    starts = F.slice(word_array, 1, F.greatest(F.size(word_array) - (SHINGLE_WORDS - 1), F.lit(1)))
    runs = F.transform(
        starts,
        lambda w, i: hasher(
            F.concat_ws(" ", w, F.get(word_array, i + 1), F.get(word_array, i + 2))
        ),
    )
    return F.when(F.size(word_array) > 0, runs)


def bottom_sketch(hashes: Column, k: int = SKETCH_SIZE) -> Column:
    """The k smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def _md5_sketches(k: int):
    """Sketches of normalized texts by ``shingle_hash``. As a closure it is shipped whole."""

    def sketches(texts: pa.Array) -> pa.Array:
        try:
            from _md5 import md5  # without the setting up of the general library, twice as fast
        except ImportError:
            from hashlib import md5

        ends, parts = [0], []
        for text in texts:
            words = text.as_py().split(b" ") if text.is_valid else []
            if words:
                runs = zip(words, words[1:], words[2:]) if len(words) > 2 else (words,)
                digests = b"".join([md5(b" ".join(run)).digest() for run in runs])
                found = np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)
                parts.append(np.unique(found.astype(np.int64))[:k])
            ends.append(ends[-1] + (len(parts[-1]) if words else 0))
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        values = pa.array(np.concatenate(parts) if parts else [], pa.int64())
        mask = pa.array(~valid) if len(valid) else None
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=mask)

    return sketches


def prompt_sketch(word_array: Column, hasher=shingle_hash, k: int = SKETCH_SIZE) -> Column:
    """The sketch of a text's words; null for a blank text."""
    if hasher is not shingle_hash:
        return bottom_sketch(shingle_hashes(word_array, hasher), k)
    text = F.when(F.size(word_array) > 0, F.array_join(word_array, " ").cast("binary"))
    return F.arrow_udf(_md5_sketches(k), "array<bigint>")(text)


def sketch_jaccard(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Jaccard estimate of two shingle sets; exact when both sketches are shorter than k.

    Otherwise only the k smallest values of the union count.
    """
    both_whole = (F.size(a) < k) & (F.size(b) < k)

    def share(x: Column) -> Column:
        lowest = F.slice(F.sort_array(x.all), 1, k)
        sampled = F.try_divide(F.size(F.array_intersect(x.both, lowest)), F.size(lowest))
        exact = F.try_divide(F.size(x.both), F.size(x.all))
        return F.coalesce(F.when(both_whole, exact).otherwise(sampled), F.lit(0.0))

    # The lambda argument holds union and intersection, so each is built once per pair.
    sets = F.struct(F.array_union(a, b).alias("all"), F.array_intersect(a, b).alias("both"))
    return F.get(F.transform(F.array(sets), share), F.lit(0))


def redact(df: DataFrame, text: Column, salt: str = DEFAULT_SALT, hasher=shingle_hash) -> DataFrame:
    """Replace prompt text by ``prompt_hash`` and ``prompt_sketch``.

    Columns of ``df`` are kept, so drop the text column itself in the select that follows.
    """
    w = F.col("_words")
    return (
        df.withColumn("_words", words(text))
        .withColumn("prompt_hash", salted_hash(w, salt))
        .withColumn("prompt_sketch", prompt_sketch(w, hasher))
        .drop("_words")
    )

"""A corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next one's documents. All but the last return the columns of the documents.

Edge cases follow the operators: null and empty texts are rejected by the first stage; an empty table
gives empty results; further columns of the documents are carried along; of rows that repeat a
document one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import langid, minhash, mixing, packing, pii
from usagelens.plans.views import table
from usagelens.storage import written

LEAST_LANGUAGE_SCORE = 0.3
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language and a score that is not low; lang is left as it is."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    names = docs.columns
    inner = {c: c if c in ("doc_id", "text") else f"in_{i}" for i, c in enumerate(names)}
    plain = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in inner.items()))
    kept = langid.predict(plain, model).where(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)
    )
    return kept.select(*(F.col(a).alias(c) for c, a in inner.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    A document is an id and a text: rows that share both are one document, rows that share an id alone
    are judged each by its text. Of a group's documents with the smallest id, one stays. Rows without an id all stay.
    """
    names = docs.columns
    inner = {c: f"in_{i}" for i, c in enumerate(names)}  # no clash with the columns made here
    d = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in inner.items()))
    parts = [F.col(inner["doc_id"]), F.col(inner["text"])]
    keys = {f"key_{i}": F.xxhash64(F.lit(i), parts[1].isNull(), *parts) for i in (1, 2)}
    d = d.withColumns(keys)
    plain = d.select(parts[0].alias("doc_id"), parts[1].alias("text"), *keys)
    found = minhash.linked(plain, SHINGLE_WORDS, SIMILAR_PERCENT, carry=tuple(keys))
    found = written(found.where("doc_id is not null").select("doc_id", "component", *keys), "groups")
    first = F.min(F.struct("doc_id", *keys)).alias("one")
    rows = found.groupBy(*keys).agg(F.count("*").alias("rows"))
    stay = found.where("component is not null").groupBy("component").agg(first).select("one.key_1", "one.key_2")
    stay = stay.unionByName(found.where("component is null").select(*keys).distinct())
    stay = written(stay.join(rows, list(keys)), "stay")
    alone = d.join(stay.where("rows = 1").select(*keys), list(keys), "leftsemi")
    again = d.join(stay.where("rows > 1").select(*keys), list(keys), "leftsemi").dropDuplicates(list(keys))
    unnamed = d.where(parts[0].isNull())
    return alone.unionByName(again).unionByName(unnamed).select(*(F.col(a).alias(c) for c, a in inner.items()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it replaced; n_chars follows the text."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, whole, each as often as it is drawn, shard by shard in shuffled order.

    A source's last draw takes its document whole too, so its words are near its target, not equal.
    """
    names = docs.columns
    inner = {c: f"in_{i}" for i, c in enumerate(names)}  # no clash with the columns made here
    d = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in inner.items()))
    parts = ("doc_id", "source", "text")
    own = [F.col(inner[c]) for c in parts]
    keys = {f"key_{i}": F.xxhash64(F.lit(i), *(c.isNull() for c in own), *own) for i in (1, 2)}
    d = d.withColumns(keys)
    drawn = mixing.mixed_documents(d.select(*(c.alias(p) for c, p in zip(own, parts)), *keys), carry=tuple(keys))
    drawn = written(drawn.select("shard", "order_key", *keys), "drawn")
    # Equal rows share their draws, so one of them stands for all.
    equal = d.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").select(*keys)
    single = d.join(equal, list(keys), "leftanti")
    stands = d.join(equal, list(keys), "leftsemi").dropDuplicates(list(keys))
    rows = single.unionByName(stands).join(drawn, list(keys))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "order_key")
    return rows.select(*(F.col(a).alias(c) for c, a in inner.items()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

# Language ID and packing are not expressed in SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

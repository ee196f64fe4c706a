"""Registered queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import plain
from compare import connect, differences
from usagelens.llm.queries import ORACLES, QUERIES
from usagelens.plans.views import table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == []


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op9_language_id"])
def test_held_out_accuracy(spark, name):
    got = QUERIES[name](spark, SF_DIR).where("held_out")
    if name == "op9_language_id":
        known = table(spark, SF_DIR, "documents").where("lang is not null").select("doc_id", "lang")
        right = got.join(known, "doc_id").select((F.col("lang") == F.col("lang_pred")).alias("ok"))
    else:
        known = table(spark, SF_DIR, "labels").where("quality is not null").select("doc_id", "quality")
        right = got.join(known, "doc_id").select((F.col("quality") == F.col("predicted")).alias("ok"))
    rows = [r["ok"] for r in right.collect()]
    assert rows and sum(rows) / len(rows) >= 0.85


def test_personal_data_over_the_table(spark):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in table(spark, SF_DIR, "documents").collect()}
    for r in QUERIES["op8_personal_data"](spark, SF_DIR).collect():
        base = ",".join(plain.base_spans(docs[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)


def test_stages(spark, documents):
    own = table(spark, SF_DIR, "documents")
    extra = documents([(10**9, None, "en", "a"), (10**9 + 1, "", "en", "a"), (10**9 + 2, "123 456", "en", "a")])
    docs = own.unionByName(extra.select(own.columns)).withColumn("rank", F.lit(7))
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language ID"](spark, docs, SF_DIR)
    ids = {r[0] for r in one.select("doc_id").collect()}
    assert one.columns == docs.columns and not ids & {10**9, 10**9 + 1, 10**9 + 2}
    assert len(ids) >= 0.98 * own.count()

    two = stages["near-duplicates"](spark, one, SF_DIR)
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    want = plain.near_duplicate_components(texts, words=5)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(k for k, c in want.items() if k == c)

    three = stages["personal data"](spark, two, SF_DIR)
    assert three.columns == docs.columns and three.count() == two.count()
    assert not any(plain.base_spans(r["text"]) for r in three.collect())

    four = stages["mixing"](spark, three, SF_DIR)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in three.collect()]
    mixed = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in four.collect()]
    assert four.columns == docs.columns and set(mixed) <= set(rows) and max(Counter(mixed).values()) <= 2
    have, targets = plain.source_words(mixed), plain.targets(plain.source_words(rows))
    longest = Counter()
    for r in rows:
        longest[r[3]] = max(longest[r[3]], len(r[1].split()))
    assert all(0 <= have[s] - t + 1 <= longest[s] + 2 for s, t in targets.items())

    five = stages["packing"](spark, four, SF_DIR)
    assert five.where("start = 0").count() == len(mixed)


def test_near_duplicate_stage_with_repeated_ids(spark, documents):
    text = "one two three four five six seven eight nine ten"
    docs = documents([
        (1, text), (1, text), (2, text + " eleven"), (2, "quite another text"), (None, "a b c"), (None, "a b c"), (3, ""),
        (3, ""), (3, None), (4, "a second text under one id"), (4, "and a third one that is not like it at all"),
    ])
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == {
        (1, text): 1, (2, "quite another text"): 1, (None, "a b c"): 2, (3, ""): 1, (3, None): 1,
        (4, "a second text under one id"): 1, (4, "and a third one that is not like it at all"): 1,
    }


CLASHES = ["_text_key", "_k1", "key_1", "shard", "order_key", "rows", "in_0", "made", "lang_pred", "component"]


def test_stages_keep_columns_that_clash_with_their_own(spark, documents):
    docs = documents([(i, f"the text number {i} is here and there", "en", "s") for i in range(30)]).drop("lang_pred", "score")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES), name


def test_mix_stage_with_equal_rows(spark, documents):
    docs = documents([(1, "a b c", "en", "s")] * 3 + [(None, "d e", "en", None)] * 2 + [(2, "x " * 50, "en", "t")])
    got = corpus_pipeline.mix(spark, docs, "")
    assert got.columns == docs.columns and set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))


def test_empty_pipeline(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
        docs = docs if "text" in docs.columns else None

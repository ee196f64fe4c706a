from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from test_functions import plain_jaccard
from usagelens.functions import prompts
from usagelens.operators import duplicates

SCHEMA = "source_format string, prompt_hash string, prompt_sketch array<bigint>"


def usage_of(spark, sketches, source="litellm_jsonl"):
    """One record per sketch; equal sketches count as the same prompt."""
    rows = [(source, str(tuple(s)), list(s)) for s in sketches]
    return spark.createDataFrame(rows, SCHEMA)


def plain_near(sketches, k, t):
    """Near flags by comparing everything with everything."""
    distinct = sorted(set(map(tuple, sketches)))
    near = set()
    for a in distinct:
        if sketches.count(list(a)) > 1 or any(
            a != b and plain_jaccard(a, b, k) >= t for b in distinct
        ):
            near.add(str(a))
    return near


def found_near(usage, **options):
    groups = duplicates.prompt_groups(usage, **options)
    return {r.prompt_hash for r in groups.where("is_near").collect()}


def random_sketches(rng, n, k, vocabulary):
    """Templates with changes, boilerplate with own parts, and noise; sizes up to k."""
    boiler = rng.sample(range(vocabulary), k // 2)
    templates = [rng.sample(range(vocabulary), rng.randint(2, k)) for _ in range(4)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35:
            s = set(rng.choice(templates))
            for _ in range(rng.randint(0, max(1, len(s) // 2))):
                s.discard(rng.choice(sorted(s)) if s else 0)
                s.add(rng.randrange(vocabulary))
        elif kind < 0.7:
            s = set(boiler) | set(rng.sample(range(vocabulary), rng.randint(1, k)))
        else:
            s = set(rng.sample(range(vocabulary), rng.randint(1, k)))
        out.append(sorted(s)[:k] or [1])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5])
def test_search_finds_exactly_what_brute_force_finds(spark, seed):
    rng = random.Random(seed)
    sketches = random_sketches(rng, 160, 14, 90)
    for t in (0.5, 0.7) if seed == 1 else (0.5,):
        want = plain_near(sketches, 14, t)
        assert found_near(usage_of(spark, sketches), threshold=t, k=14) == want


def test_hot_boilerplate_and_hot_template(spark):
    """A third of the prompts share boilerplate without being near; another third a template."""
    boiler, template = list(range(1000, 1010)), list(range(2000, 2016))
    sketches = [sorted([*boiler, *range(10_000 + 20 * i, 10_010 + 20 * i)]) for i in range(60)]
    sketches += [sorted([*template[:-1], 50_000 + i]) for i in range(60)]
    sketches += [sorted(range(100_000 + 20 * i, 100_012 + 20 * i)) for i in range(60)]
    got = found_near(usage_of(spark, sketches), k=128)
    assert got == plain_near(sketches, 128, 0.5)
    assert len(got) == 60


def test_families_of_many_sizes(spark):
    """Shared boilerplate with own parts of every length: short ones are near, long ones not."""
    rng = random.Random(8)
    boiler = list(range(12))
    sketches = [
        sorted([*boiler, *range(1000 + 40 * i, 1000 + 40 * i + rng.randint(1, 30))]) for i in range(120)
    ]
    assert found_near(usage_of(spark, sketches)) == plain_near(sketches, 128, 0.5)


@pytest.mark.parametrize("k", [128, 20])
def test_shared_boilerplate_makes_no_pairs(spark, k):
    """Prompts that share a third of themselves, too little to be near, make no pair at all."""
    boiler = range(0, 2400, 200)
    sketches = [
        sorted([*boiler, *(b + 1 + 2 * i + j for b in boiler for j in (0, 1))])[:k] for i in range(50)
    ]
    p = duplicates._distinct_prompts(usage_of(spark, sketches))
    postings = duplicates._postings(p, duplicates._shared_values(p), 0.5)
    facts = duplicates._pivot_facts(postings, postings, p, 0.5, k)
    assert duplicates._candidate_pairs(postings, facts, 0.5, k).count() == 0
    assert found_near(usage_of(spark, sketches), k=k) == plain_near(sketches, k, 0.5) == set()


def test_sketches_looked_up_do_not_grow_with_the_values_shared(spark):
    """A prompt takes its sketch to a fixed number of pivots, and only prompts that can have a partner do."""
    own = list(range(100, 1700, 100))
    sketches = [own, *([v, *range(v * 1000 + 1, v * 1000 + 6)] for v in own)]
    p = duplicates._distinct_prompts(usage_of(spark, sketches))
    values = duplicates._shared_values(p)
    pairs = duplicates._pivot_pairs(p, values).groupBy("a").count()
    assert pairs.agg(F.max("count")).first()[0] <= duplicates.PIVOTS
    live = duplicates._live(p, duplicates._postings(p, values, 0.5))
    assert [r.prompt_hash for r in live.collect()] == [str(tuple(own))]
    assert found_near(usage_of(spark, sketches)) == plain_near(sketches, 128, 0.5) == set()


def test_exact_groups_count_all_members(spark):
    usage = usage_of(spark, [[1, 2], [1, 2], [7, 8, 9]])
    row = duplicates.duplicate_stats(duplicates.prompt_groups(usage)).first()
    assert (row.analyzed_records, row.exact_duplicate_records, row.near_duplicate_records) == (3, 2, 2)
    assert row.exact_duplicate_rate == 0.6667
    assert duplicates.exact_stats(usage).first().exact_duplicate_records == 2


def test_sources_are_searched_apart(spark):
    both = usage_of(spark, [[1, 2, 3]]).union(usage_of(spark, [[1, 2, 3, 4]], "helicone"))
    assert found_near(both) == set()
    same = usage_of(spark, [[1, 2, 3], [1, 2, 3, 4]])
    assert len(found_near(same)) == 2


def test_records_without_prompt_are_left_out(spark):
    usage = spark.createDataFrame([("openai_csv", None, None)] * 2, SCHEMA)
    assert duplicates.duplicate_stats(duplicates.prompt_groups(usage)).count() == 0


def texts(spark, lines):
    df = spark.createDataFrame([("litellm_jsonl", t) for t in lines], "source_format string, t string")
    return prompts.redact(df, F.col("t")).drop("t")


def test_near_texts(spark):
    lines = [
        "kindly boil the following parcel complaint down to a single plain sentence for the clerk",
        "kindly boil the following parcel complaint down to a single plain paragraph for the clerk",
        "draw up a table of the tides at the old harbour",
    ]
    row = duplicates.duplicate_stats(duplicates.prompt_groups(texts(spark, lines))).first()
    assert (row.near_duplicate_records, row.exact_duplicate_records) == (2, 0)


def test_no_duplicates(spark):
    lines = ["put this clause into plain danish", "rhyme about hills under snow", "what tells tcp from udp"]
    row = duplicates.duplicate_stats(duplicates.prompt_groups(texts(spark, lines))).first()
    assert (row.near_duplicate_records, row.near_duplicate_rate) == (0, 0.0)


def test_long_texts_use_the_estimate(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    lines = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(300)]
        lines.append(" ".join(base))
        for _ in range(rng.choice([20, 60])):
            base[rng.randrange(300)] = rng.choice(vocabulary)
        lines.append(" ".join(base))
    usage = texts(spark, lines)
    rows = usage.collect()
    by_hash = {r.prompt_hash: list(r.prompt_sketch) for r in rows}
    want = {
        h for h, s in by_hash.items()
        if any(h != g and plain_jaccard(s, o, 128) >= 0.5 for g, o in by_hash.items())
    }
    assert found_near(usage) == want


def test_hot_values_are_split_by_adaptive_execution(spark):
    """Both joins that can meet a hot key are in a shape whose skew Spark can split."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {name: spark.conf.get(name, None) for name in small}
    own = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("id") * 20 + i + 10**7)
    variant = F.concat(F.sequence(F.lit(1), F.lit(15)), F.array(F.col("id") + 1000))
    usage = spark.range(0, 20_000, 1, 8).select(
        F.lit("litellm_jsonl").alias("source_format"),
        F.col("id").cast("string").alias("prompt_hash"),
        F.when(F.col("id") % 3 == 0, variant).otherwise(own).alias("prompt_sketch"),
    )

    def plan_of(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        p = duplicates._distinct_prompts(usage)
        pairs = duplicates._pivot_pairs(p, duplicates._shared_values(p))
        assert "skew=true" in plan_of(pairs)
        assert "skew=true" in plan_of(duplicates._near_ids(duplicates.written(pairs, "t"), p, 0.5, 128))
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)

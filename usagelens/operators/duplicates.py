"""Exact and near-duplicate prompts, from hashes and sketches only.

A prompt is near-duplicate when its sketch Jaccard with any other prompt of the same source
reaches the threshold. Members of an exact group count as near by definition. The search is
complete, with no cap on bucket, candidate or check counts, and its work stays small because

1. only one copy of every exact group is searched;
2. prompts that share too few values with all others together have no partner and drop out before any
   sketch is looked up;
3. every other prompt that occurs once is first compared with the two pivots that its smallest values
   name most often, which settles templates however many variants they have;
4. only prompts still unsettled search all others, through prefix filtering: near prompts must share
   one of the first few values of any common value order. The order is rarest first, so boilerplate
   seldom brings two prompts together;
5. prompts that meet under a value are not all paired. Each is compared with one pivot of the value.
   Two prompts either share a value that the pivot lacks, and meet under it, or all they share is in
   the pivot; then what each has in common with the pivot bounds their likeness. Prompts whose bound
   cannot reach the threshold with any other drop out, so shared boilerplate costs linear work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.prompts import SKETCH_SIZE, sketch_jaccard
from usagelens.operators.grouped import rate
from usagelens.storage import written

# The near-duplicate threshold, the smallest values that name pivots, and the pivots compared.
NEAR_THRESHOLD = 0.5
PIVOT_VALUES = 16
PIVOTS = 2

_SLACK = 1e-9


def exact_groups(usage: DataFrame) -> DataFrame:
    """Copies of every distinct prompt. Counted before the shuffle, so a prompt may be hot."""
    return _grouped(usage, [])


def _grouped(usage: DataFrame, more: list[Column]) -> DataFrame:
    # Rows without a prompt form one group that is dropped by its count: a filter on the hash
    # itself would be pushed into the scan stage and make it compute the hash twice.
    return (
        usage.groupBy("source_format", "prompt_hash")
        .agg(F.count("prompt_hash").alias("n_records"), *more)
        .where("n_records > 0")
    )


def _distinct_prompts(usage: DataFrame) -> DataFrame:
    """One row per distinct prompt with a short id, stored for the passes that follow."""
    groups = _grouped(usage, [F.first("prompt_sketch").alias("sketch")])
    return written(groups.withColumn("pid", F.monotonically_increasing_id()), "prompts")


def _shared_values(prompts: DataFrame) -> DataFrame:
    """Sketch values of two or more prompts: how many, the most repeated, and the smallest one.

    The most repeated prompt is likely the template of its variants. The smallest is the one
    most like all others that add their own part to a shared boilerplate. Both are sought where pivots
    are looked up, among the first ``PIVOT_VALUES`` of sketches; other rows carry the value alone.
    """
    first = F.col("at") < PIVOT_VALUES
    values = (
        prompts.select(
            "source_format", "pid", "n_records", F.size("sketch").alias("n"),
            F.posexplode("sketch").alias("at", "v"),
        )
        .select("source_format", "v", *(F.when(first, F.col(c)).alias(c) for c in ("pid", "n_records", "n")))
        .groupBy("source_format", "v")
        .agg(
            F.count("*").alias("df"),
            F.max_by("pid", "n_records").alias("repeated"),
            F.min_by("pid", "n").alias("smallest"),
        )
        .where("df > 1")
    )
    return written(values, "values")


def _check_tasks(df: DataFrame) -> int:
    """Tasks for checking pairs. Pairs are small rows with much work, which adaptive execution
    would merge into few tasks by their size, so the number is given."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _near_ids(pairs: DataFrame, prompts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Ids found in a pair (a, b) whose sketches reach the threshold."""
    left = prompts.select(F.col("pid").alias("a"), F.col("sketch").alias("sketch_a"))
    right = prompts.select(F.col("pid").alias("b"), F.col("sketch").alias("sketch_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(sketch_jaccard(F.col("sketch_a"), F.col("sketch_b"), k) >= threshold)
        .select(F.explode(F.array("a", "b")).alias("pid"))
        .distinct()
    )


def _pivot_pairs(prompts: DataFrame, values: DataFrame) -> DataFrame:
    """Every unrepeated prompt with the ``PIVOTS`` pivots that its smallest values name most often.

    The number is fixed, as each pair looks up two sketches. What they leave unsettled is searched below.
    """
    pivots = values.select("source_format", "v", F.array("repeated", "smallest").alias("pivots"))
    named = (
        prompts.where("n_records = 1")
        .select(
            "source_format",
            F.col("pid").alias("a"),
            F.explode(F.slice("sketch", 1, PIVOT_VALUES)).alias("v"),
        )
        .join(pivots, ["source_format", "v"])
        .select("a", F.explode("pivots").alias("b"))
        .where("a <> b")
        # At most 32 pairs a prompt, so this is even; both counts and the lookup by a share it.
        .repartition(_check_tasks(prompts), "a")
        .groupBy("a", "b")
        .agg(F.count("*").alias("times"))
    )
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("times")).alias("order"), "b")))
    most = named.groupBy("a").agg(F.slice(ranked, 1, PIVOTS).alias("most"))
    return most.select("a", F.explode("most.b").alias("b"))


def _prefix_size(n: Column, threshold: float) -> Column:
    """A near partner shares at least ceil(t n) values, so one is among the first n - that + 1."""
    return n - F.ceil(n * threshold - _SLACK) + 1


def _postings(prompts: DataFrame, values: DataFrame, threshold: float) -> DataFrame:
    """The values that can bring a prompt to a partner, one row each, stored.

    Values are ordered by how many prompts hold them, then by value. Values held by one prompt
    come first and match nothing, so only their number matters; a prompt with too few shared
    values for any partner drops out.
    """
    cut = _prefix_size(F.col("n"), threshold)
    shared = (
        prompts.select("source_format", "pid", F.size("sketch").alias("n"), F.explode("sketch").alias("v"))
        .join(values.select("source_format", "v", "df"), ["source_format", "v"])
        # Plain rows take less room in the shuffle than lists of few.
        .repartition("pid")
        .groupBy("source_format", "pid", "n")
        # A sketch holds at most k values, which bounds the list.
        .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"))
        .withColumn("alone", F.col("n") - F.size("shared"))
    )
    kept = F.slice("shared", F.lit(1), F.greatest(cut - F.col("alone"), F.lit(0)).cast("int"))
    rows = shared.select("source_format", "pid", "n", F.explode(kept).alias("x"))
    return written(rows.select("source_format", "pid", "n", F.col("x.v").alias("v")), "postings")


def _live(prompts: DataFrame, postings: DataFrame) -> DataFrame:
    """The prompts that can have a partner at all, stored. Only their sketches are looked up from here on."""
    return written(prompts.join(postings.select("pid").distinct(), "pid", "left_semi"), "live")


def _pivot_facts(seekers: DataFrame, postings: DataFrame, prompts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Every prompt against the pivots of its values, the smallest prompt of each, stored.

    ``both``: values shared with the pivot; ``place``: where in the prompt's sketch the last of the
    first ceil(threshold k) shared ones stands; ``rest``: the values that the pivot lacks.
    """
    key = ["source_format", "v"]
    wanted = seekers.select(*key).distinct()
    lists = postings.join(wanted, key, "left_semi")
    pivots = lists.groupBy(*key).agg(F.count("*").alias("members"), F.min_by("pid", "n").alias("pivot"))
    pairs = lists.join(pivots.where("members > 1"), key).select("pivot", "pid").distinct()
    mine = prompts.select("pid", "sketch")
    of_pivot = prompts.select(F.col("pid").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
    shared = F.array_intersect("sketch", "pivot_sketch")  # in the sketch's order, smallest first
    facts = pairs.join(mine, "pid").join(of_pivot, "pivot").withColumn("shared", shared)
    nth = F.get("shared", F.lit(math.ceil(threshold * k - _SLACK) - 1))
    return written(
        facts.select(
            "pivot", "pid", F.size("sketch").alias("n"), F.size("shared").alias("both"),
            F.array_position("sketch", nth).alias("place"),
            F.array_except("sketch", "pivot_sketch").alias("rest"),
            (sketch_jaccard(F.col("sketch"), F.col("pivot_sketch"), k) >= threshold).alias("near"),
        ),
        "pivot-facts",
    )


def _can_reach(n_a, both_a, place_a, n_b, both_b, place_b, threshold: float, k: int) -> Column:
    """Whether two prompts can be near if all they share is in the pivot.

    Whole sketches share at most the smaller ``both``. Otherwise the estimate takes ceil(threshold k)
    shared values among the k smallest of the union. The last of them stands no earlier than
    ``place`` in either sketch, and its rank in the union is the sum of both places less those shared.
    """
    enough = math.ceil(threshold * k - _SLACK)
    whole = F.least(both_a, both_b) >= (n_a + n_b) * (threshold / (1 + threshold)) - _SLACK
    sampled = place_a + place_b - enough <= k
    return F.when((n_a < k) & (n_b < k), whole).otherwise(F.coalesce(sampled, F.lit(False)))


def _candidate_pairs(seekers: DataFrame, facts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs (a, b) of a seeker and another prompt of a common pivot that can still be near."""
    ids = seekers.select("pid").distinct()
    pid = F.col("pid")
    # A pair with the pivot itself is compared already.
    members = facts.where(pid != F.col("pivot"))
    bests = members.groupBy("pivot").agg(
        F.min("n").alias("n_b"), F.min("place").alias("place_b"), F.max("both").alias("both_b")
    )
    # Against the most favourable figures of the group; sketch sizes decide which rule can apply.
    alone = F.when(
        (F.col("n") < k) & (F.col("n_b") < k),
        (F.col("both") >= (F.col("n") + F.col("n_b")) * (threshold / (1 + threshold)) - _SLACK)
        | F.coalesce(F.col("place") + F.col("place_b") - math.ceil(threshold * k - _SLACK) <= k, F.lit(False)),
    ).otherwise(F.coalesce(F.col("place") + F.col("place_b") - math.ceil(threshold * k - _SLACK) <= k, F.lit(False)))
    hopeful = members.join(bests, "pivot").where(alone).select("pivot", "pid", "n", "both", "place")
    probe = hopeful.join(ids, "pid", "left_semi").select(
        "pivot", pid.alias("a"), F.col("n").alias("n_a"), F.col("both").alias("both_a"), F.col("place").alias("place_a")
    )
    figures = [F.col(c) for c in ("n_a", "both_a", "place_a", "n", "both", "place")]
    bounded = probe.join(hopeful, "pivot").where(pid != F.col("a")).where(_can_reach(*figures, threshold, k))

    rest = members.select("pivot", "pid", "n", F.explode("rest").alias("v"))
    met = rest.groupBy("pivot", "v").agg(F.count("*").alias("holders")).where("holders > 1").select("pivot", "v")
    rest = written(rest.join(met, ["pivot", "v"]), "rest")
    probe = rest.join(ids, "pid", "left_semi").select("pivot", "v", pid.alias("a"), F.col("n").alias("n_a"))
    fits = (F.least("n_a", "n") >= F.greatest("n_a", "n") * threshold - _SLACK) | (F.greatest("n_a", "n") >= k)
    apart = probe.join(rest, ["pivot", "v"]).where((pid != F.col("a")) & fits)

    ends = [F.least("a", "pid").alias("a"), F.greatest("a", "pid").alias("b")]
    return bounded.select(ends).union(apart.select(ends)).distinct()


def prompt_groups(
    usage: DataFrame,
    threshold: float = NEAR_THRESHOLD,
    k: int = SKETCH_SIZE,
) -> DataFrame:
    """(source_format, prompt_hash, n_records, is_near): every distinct prompt, flagged."""
    prompts = _distinct_prompts(usage)
    values = _shared_values(prompts)
    postings = _postings(prompts, values, threshold)
    live = _live(prompts, postings)
    near = written(_near_ids(_pivot_pairs(live, values), live, threshold, k), "near-pivot")
    settled = live.where("n_records > 1").select("pid").union(near)
    seekers = postings.join(settled, "pid", "left_anti")
    facts = _pivot_facts(seekers, postings, live, threshold, k)
    met = facts.where(F.col("near") & (F.col("pid") != F.col("pivot")))
    near = near.union(met.select(F.explode(F.array("pid", "pivot")).alias("pid")))
    seekers = seekers.join(near, "pid", "left_anti")
    pairs = written(_candidate_pairs(seekers, facts, threshold, k), "pairs")
    searched = _near_ids(pairs, live, threshold, k)
    near = near.union(searched).distinct().withColumn("found", F.lit(True))
    return (
        prompts.select("source_format", "prompt_hash", "n_records", "pid")
        .join(near, "pid", "left")
        .select(
            "source_format",
            "prompt_hash",
            "n_records",
            ((F.col("n_records") > 1) | F.coalesce("found", F.lit(False))).alias("is_near"),
        )
    )


def duplicate_stats(groups: DataFrame) -> DataFrame:
    """Analyzed, exact and near records and their rates, per source format."""
    n = F.col("n_records")
    return (
        groups.groupBy("source_format")
        .agg(
            F.sum(n).alias("analyzed_records"),
            F.sum(F.when(n > 1, n).otherwise(0)).alias("exact_duplicate_records"),
            F.sum(F.when(F.col("is_near"), n).otherwise(0)).alias("near_duplicate_records"),
        )
        .select(
            "source_format",
            "analyzed_records",
            "exact_duplicate_records",
            rate(F.col("exact_duplicate_records"), F.col("analyzed_records")).alias(
                "exact_duplicate_rate"
            ),
            "near_duplicate_records",
            rate(F.col("near_duplicate_records"), F.col("analyzed_records")).alias(
                "near_duplicate_rate"
            ),
        )
    )


def exact_stats(usage: DataFrame) -> DataFrame:
    """Exact duplicates alone, without reading the sketches' values."""
    flagged = exact_groups(usage).withColumn("is_near", F.lit(False))
    return duplicate_stats(flagged).drop("near_duplicate_records", "near_duplicate_rate")

"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Each source is cut into permuted blocks of documents. A source's target says how many of its words
the mix takes; whole passes over the source come first, then a prefix of its permuted blocks. The
exact block quotas of all sources are divided among output shards by a binary tree: a node gives its
left child a multivariate-hypergeometric draw of its quotas. Shards then take disjoint runs of each
source's permuted blocks and order their documents by hash.

Documents are dealt to blocks by two nested hashes, so no task orders a whole source: the prefix is
found over a source's blocks, then over the parts of one block, then over the documents of one part.

Edge cases: a null text has size 0; a null source is a source of its own, placed last; sources
without words have target 0; repeated rows count each on their own; an empty table gives an empty
result; columns of the input beyond doc_id, text and source are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.storage import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
BUDGET = 1.5  # words of the mix, as a share of all words
MOST_REPEATS = 2
BLOCKS = 1024  # most blocks of a source
PARTS = 1024  # parts of a block
BLOCK_WORDS = 16384  # a source has about one block for so many words
SHARDS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST_REPEATS
) -> DataFrame:
    """Rows (source, source_size) with weight and target.

    The budget is shared by weight. A target stops at ``most`` times its source's size and the
    excess is shared again by weight: with sources ordered by cap / weight, the first ones are held
    at their caps, and the rest divide what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), rank + 1)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget))
    s = sizes.withColumns({"weight": weight, "total": total})
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumns({
        "held": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(after),
    })
    share = (F.col("total") - F.col("held")) * F.col("weight") / F.col("open_weight")
    free = F.col("cap") > share
    # Once one source stays under its cap, so do all after it, at the same level a weight.
    level = F.when(free, (F.col("total") - F.col("held")) / F.col("open_weight"))
    first = F.first(level, ignorenulls=True).over(
        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    target = F.when(first.isNull(), F.col("cap")).otherwise(
        F.least("cap", first * F.col("weight"))
    )
    return s.select("source", "source_size", "weight", target.alias("target"))


def _hash(*cols) -> Column:
    return F.xxhash64(*cols)


def draw_plan(docs: DataFrame, seed: int = 0, carry=(), **shares) -> dict[str, DataFrame]:
    """Sizes, targets and the words drawn from each document.

    ``docs``: (doc_id, source, text) and the columns to ``carry`` along. Gives ``sizes`` (doc_id, source, size, block keys), ``sources``
    (source, source_size, target, blocks) and ``taken`` (doc_id, source, size, taken and the parts
    of a draw).
    """
    size = word_count(F.col("text"))
    key = _hash(F.lit(seed), "doc_id")
    sizes = written(
        docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *carry), "mix-sizes"
    )
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocks = F.least(F.lit(BLOCKS), 1 + F.floor(F.col("source_size") / BLOCK_WORDS)).cast("int")
    targets = source_targets(per, **shares).withColumns({
        "blocks": blocks,
        # Words the mix takes: whole passes, then a rest.
        "words": F.floor(F.col("target") + 0.5).cast("bigint"),
    }).withColumns({
        "passes": F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0),
    }).withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    sources = written(targets, "mix-sources")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    s, t = sizes.alias("s"), sources.alias("t")
    # One row a source: small next to the documents; Spark broadcasts it if its size allows.
    dealt = s.join(t, same(sizes, sources)).select(
        "s.doc_id", "s.source", "s.size", "s.key", "t.blocks", "t.passes", "t.rest", *(f"s.{c}" for c in carry),
        F.pmod("s.key", "t.blocks").cast("int").alias("block"),
        F.pmod(_hash(F.lit(seed + 1), "s.key"), F.lit(PARTS)).cast("int").alias("part"),
    )
    # Prefix over the blocks of a source.
    per_block = dealt.groupBy("source", "block").agg(
        F.sum("size").alias("block_size"), F.first("rest").alias("rest")
    )
    place = _hash(F.lit(seed + 2), "source", "block")
    run = Window.partitionBy("source").orderBy(place, "block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    per_block = written(per_block.withColumns({
        "before": F.coalesce(F.sum("block_size").over(run), F.lit(0)),
        "place": F.row_number().over(Window.partitionBy("source").orderBy(place, "block")) - 1,
    }), "mix-blocks")
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("block_size") > F.col("rest"))
    b = per_block.select(
        F.col("source").alias("b_source"), F.col("block").alias("b_block"), "before", "place",
        cut.alias("cut"), (F.col("before") < F.col("rest")).alias("drawn"),
    )
    dealt = dealt.join(
        b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))
    ).drop("b_source", "b_block")
    # In the one block of a source that the prefix ends in: the same over its parts.
    in_cut = dealt.where("cut")
    per_part = in_cut.groupBy("source", "part").agg(
        F.sum("size").alias("part_size"), F.first(F.col("rest") - F.col("before")).alias("left")
    )
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("earlier", F.coalesce(F.sum("part_size").over(run), F.lit(0)))
    p = per_part.select(
        F.col("source").alias("p_source"), F.col("part").alias("p_part"), "part_size",
        (F.col("left") - F.col("earlier")).alias("part_left"),
    )
    parted = in_cut.join(
        p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part"))
    ).drop("p_source", "p_part")
    run = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    part_extra = F.greatest(
        F.lit(0), F.least("size", F.col("part_left") - F.coalesce(F.sum("size").over(run), F.lit(0)))
    )
    keep = ["doc_id", "source", "size", "key", "block", "place", "passes", "drawn", *carry]
    whole = dealt.where("not cut").select(
        *keep, F.when(F.col("drawn"), F.col("size")).otherwise(F.lit(0)).alias("extra")
    )
    taken = whole.unionByName(parted.select(*keep, part_extra.cast("bigint").alias("extra")))
    return {
        "sizes": sizes,
        "sources": sources,
        "blocks": per_block,
        "taken": taken.withColumn("taken", F.col("passes") * F.col("size") + F.col("extra")),
    }


def mixed_sizes(docs: DataFrame, seed: int = 0, shards: int = SHARDS, **shares) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken.

    ``taken`` adds up the words of the document's copies in the mix, as they are placed on shards.
    """
    # Kept with the stored sizes, so that rows which share an id or are equal stay apart.
    rows = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    plan = draw_plan(rows, seed, ("row",), **shares)
    copies = placed_copies(plan, shards, seed, ("row",), **shares)
    taken = copies.groupBy(F.col("row").alias("of_row")).agg(F.sum("words").alias("taken"))
    sizes = plan["sizes"].join(taken, F.col("row") == F.col("of_row"), "left")
    sources = plan["sources"].select(F.col("source").alias("of"), "source_size", "target")
    return sizes.join(sources, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken")
    )


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8; error below 1e-12."""
    m = n + F.lit(8.0)
    series = (
        (m + 0.5) * F.log(m) - m + F.lit(0.9189385332046727)
        + 1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * F.pow(m, F.lit(5.0)))
    )
    product = F.lit(0.0)
    for i in range(1, 9):
        product = product + F.log(n + F.lit(float(i)))
    return series - product


def _hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` are in ``draws``, by inversion at the uniform ``u``.

    The sum runs over twelve standard deviations around the mean; outside lies less than 1e-30.
    """
    mean = F.when(total > 0, draws * good / total).otherwise(F.lit(0.0))
    wide = 12 * F.sqrt(mean + 1) + 2
    low = F.greatest(F.lit(0), draws + good - total, F.floor(mean - wide))
    high = F.least(good, draws, F.ceil(mean + wide))
    lf = _log_factorial

    def chance(x: Column) -> Column:
        bad, rest = total - good, draws - x
        return F.exp(
            lf(good) - lf(x) - lf(good - x) + lf(bad) - lf(rest) - lf(bad - rest)
            - lf(total) + lf(draws) + lf(total - draws)
        )

    start = F.struct(F.lit(0.0).alias("sum"), low.cast("bigint").alias("x"))
    walked = F.aggregate(
        F.sequence(low.cast("bigint"), high.cast("bigint")), start,
        lambda acc, x: F.when(acc["sum"] >= u, acc).otherwise(
            F.struct((acc["sum"] + chance(x)).alias("sum"), x.alias("x"))
        ),
    )
    return F.least(walked["x"], high.cast("bigint"))


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Divide (source, quota) blocks among ``shards``: (shard, source, quota), sums exact.

    A node of the tree holds a range of shards and a quota a source. Its left child gets blocks in
    proportion to its shards, drawn without replacement: source after source, a hypergeometric draw
    from what is left. The number of levels is log2 of the shards; the rows are one a node, and a
    node's array has one entry a source.
    """
    entry = F.struct(F.col("source"), F.col("quota").cast("bigint").alias("quota"))
    node = quotas.where("quota > 0").groupBy().agg(F.sort_array(F.collect_list(entry)).alias("own"))
    node = node.withColumns({"low": F.lit(0), "high": F.lit(shards)})
    for level in range((shards - 1).bit_length()):
        if level == 8:
            node = node.repartition("low")  # enough nodes now for more than one task
        width = F.col("high") - F.col("low")
        half = F.floor(width / 2).cast("int")
        total = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, e: a + e["quota"])
        left_size = F.floor(total * half / width).cast("bigint")
        kind = quotas.schema["source"].dataType.simpleString()
        none = F.array().cast(f"array<struct<source:{kind},quota:bigint>>")
        start = F.struct(total.alias("total"), left_size.alias("draws"), none.alias("out"))

        def step(acc, e):
            # A number from 0 to 1 that depends on node and source only.
            u = F.pmod(_hash(F.lit(seed), "low", "high", e["source"]), F.lit(1 << 52)) / float(1 << 52)
            x = _hypergeometric(e["quota"], acc["total"], acc["draws"], u)
            got = F.struct(e["source"].alias("source"), x.alias("quota"))
            return F.struct(
                (acc["total"] - e["quota"]).alias("total"), (acc["draws"] - x).alias("draws"),
                F.array_append(acc["out"], got).alias("out"),
            )

        left = F.aggregate("own", start, step)["out"]
        right = F.zip_with("own", "left", lambda a, b: F.struct(
            a["source"].alias("source"), (a["quota"] - b["quota"]).alias("quota")
        ))
        middle = F.col("low") + half
        children = F.when(width > 1, F.array(
            F.struct(F.col("low"), middle.alias("high"), F.col("left").alias("own")),
            F.struct(middle.alias("low"), F.col("high"), right.alias("own")),
        )).otherwise(F.array(F.struct("low", "high", "own")))
        node = node.withColumn("left", left).select(F.explode(children).alias("c")).select("c.*")
    leaf = node.select(F.col("low").alias("shard"), F.explode("own").alias("e"))
    return leaf.select("shard", "e.source", "e.quota").where("quota > 0")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 0, carry=(), **shares) -> DataFrame:
    """The mix itself: one row a drawn copy, (shard, order_key, doc_id, source, pass, words, carried).

    A source's draws are its blocks in permuted order, pass after pass. Each shard takes the next
    run of them, as many as the splitting tree gives it; inside a shard rows are ordered by
    ``order_key``. ``words`` is below the document's size only for the last draw of a source.
    More shards than blocks leave some without rows.
    """
    return placed_copies(draw_plan(docs, seed, carry, **shares), shards, seed, carry, **shares)


def placed_copies(
    plan: dict[str, DataFrame], shards: int = SHARDS, seed: int = 0, carry=(), most: float = MOST_REPEATS, **_
) -> DataFrame:
    """Rows of ``mixed_documents`` for a ``draw_plan`` with the same ``seed``, ``carry`` and ``most``."""
    src = plan["sources"].select(F.col("source").alias("of"), "passes")
    blocks = plan["blocks"].join(src, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    of_source = Window.partitionBy("source")
    passes = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(most))), lambda i: i)
    drawn = (F.col("pass") < F.col("passes")) | (
        (F.col("pass") == F.col("passes")) & (F.col("before") < F.col("rest"))
    )
    slots = blocks.withColumn("n", F.count("*").over(of_source)).withColumn("pass", F.explode(passes)).where(drawn)
    slots = written(slots.select(
        "source", "block", "pass", (F.col("pass") * F.col("n") + F.col("place")).alias("slot")
    ), "mix-slots")
    split = shard_quotas(slots.groupBy("source").agg(F.count("*").alias("quota")), shards, seed)
    end = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    split = split.withColumn("end", end).select(
        F.col("source").alias("of"), "shard", (F.col("end") - F.col("quota")).alias("start"), "end"
    )
    split = written(split, "mix-split")
    run = F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") >= F.col("start")) & (F.col("slot") < F.col("end"))
    placed = written(slots.join(split, run).select(
        F.col("source").alias("of"), F.col("block").alias("in_block"), F.col("pass").alias("in_pass"), "shard"
    ), "mix-placed")
    words = (
        F.when(F.col("pass") < F.col("passes"), F.col("size"))
        .when(F.col("pass") == F.col("passes"), F.col("extra")).otherwise(F.lit(0))
    )
    taken = plan["taken"].withColumn("pass", F.explode(passes)).withColumn("words", words).where("words > 0")
    hit = F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in_block")) & (
        F.col("pass") == F.col("in_pass")
    )
    order_key = _hash(F.lit(seed + 3), "shard", "pass", "key")
    return taken.join(placed, hit).select(
        "shard", order_key.alias("order_key"), "doc_id", "source", "pass", "words", *carry
    )

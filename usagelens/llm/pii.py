"""Personal data, and the terms that give it away, by information-theoretic sanitisation.

Protected entities are e-mail and IP addresses, card and phone numbers, found by fixed patterns. The
corpus then says how much a term reveals an entity: the share of the entity's information that comes with the term,

    PMI(t, e) / IC(e) = 1 - log2(df(t) / n(t, e)) / log2(N / df(e)),

from the distinct texts, N, that hold t, e, or both, wherever in them. Copies of a text count once. A pair seen in
two texts or more counts as it is; one seen in a single text says little, so there the term must also stand in a
sentence with the entity. From ``GENERALISE`` on, a term is replaced by its class wherever it stands in a text
with the entity, from ``REMOVE`` on it is removed. A text without an entity is left alone.

Entities of the same texts are one class, and so are terms: each text gives pairs of classes, not of their members.
A term can only disclose an entity that is rarer than it by little, so terms too common for all entities of their
texts are dropped before their texts are counted.

All of it is DataFrame functions. Places of matches come from the lengths of the pieces between them.
Patterns are anchored to the start of a run and use possessive repeats, so that no text, however long
a run of digits or letters it has, makes the matcher recurse or try a run from each of its places. Spans
are put together in runs, so that a text may hold many.

Edge cases: a null text is empty; repeated rows each get their result; a null doc_id is a value like
others; an empty table gives an empty result; further columns are kept where texts are replaced, else not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.storage import written

# What counts as an entity, as an equal of the plain patterns.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A run of fewer than 13 digits is no card, so it is not matched at all.
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = r"\p{L}[\p{L}\p{M}]++"
SENTENCE = r"(?<=[.!?])\s+|[\r\n]+"
SUPPORT = 2  # texts that a pair must be seen in to count without standing in one sentence
GENERALISE = 0.95
REMOVE = 0.99
FILTER_BITS = 1 << 22
RUN = 64  # spans put together at once
KEY = ("k1", "k2")  # names a text
SPANS = "array<struct<start:bigint,stop:bigint,value:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def in_runs(items: Column, start: Column, step, joined) -> Column:
    """A fold over ``items`` that keeps what it makes in runs: linear where a plain fold copies all of it each time.

    ``step(acc, item)`` adds to acc["out"]; ``joined(a, b)`` puts two outs together.
    """
    blank = start["out"]

    def add(own: Column, acc: Column, i: Column) -> Column:
        run = F.aggregate(F.slice(own, i + 1, F.lit(RUN)), acc.withField("out", blank), step)
        return let(run, lambda r: r.withField("out", joined(acc["out"], r["out"])))

    def folded(own: Column) -> Column:
        every = F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(RUN))
        return F.aggregate(every, start, lambda acc, i: add(own, acc, i))

    return let(items, folded)


def places(text: Column, pattern: str) -> Column:
    """Matches in order: array of (start, stop, value), in characters."""
    empty = F.array().cast(SPANS)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(acc, pair):
        begin = acc["at"] + pair["gap"]
        stop = begin + F.length(pair["value"])
        own = F.struct(begin.alias("start"), stop.alias("stop"), pair["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    def located(own: Column) -> Column:
        pairs = F.zip_with(
            F.slice(own["gaps"], F.lit(1), F.size(own["found"])), own["found"],
            lambda g, v: F.struct(g.cast("bigint").alias("gap"), v.alias("value")),
        )
        return F.when(F.size(own["found"]) > 0, in_runs(pairs, start, step, F.concat)["out"]).otherwise(empty)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return let(F.struct(found.alias("found"), gaps.alias("gaps")), located)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    size = F.length(_digits(value))
    if kind == "card":
        return F.when(size.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def entities(text: Column, kind: str) -> Column:
    """Valid matches of one kind: array of (kind, start, stop, value)."""
    hint = {"email": "@", "phone": "+"}.get(kind)
    possible = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9]")
    spans = F.filter(places(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    spans = F.transform(spans, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")
    ))
    empty = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,value:string>>")
    return F.when(possible, spans).otherwise(empty)


def named(span: Column) -> Column:
    """The entity of a match: one name for all ways to write it."""
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def text_keys(text: Column) -> dict[str, Column]:
    return {k: F.xxhash64(F.lit(i), text) for i, k in enumerate(KEY)}


def found_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, email, ip, card, phone, text) per row, stored; the text only where it holds an entity."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumns({**text_keys(F.col("text")), **{k: entities(F.col("text"), k) for k in KINDS}})
    some = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    return written(t.withColumn("text", F.when(some, F.col("text"))), "entities")


def _sentences(holders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, at, entity) and (k1, k2, at, term) of the sentences of distinct texts; terms stand outside entities."""
    rows = holders.select(*KEY, F.posexplode(F.split("text", SENTENCE)).alias("at", "sentence"))
    found = F.concat(*(entities(F.col("sentence"), k) for k in KINDS))
    names = rows.select(*KEY, "at", F.explode(F.array_distinct(F.transform(found, named))).alias("entity"))
    rest = F.col("sentence")
    for pattern in PATTERNS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.array_distinct(F.regexp_extract_all(F.lower(rest), F.lit(TERM), F.lit(0)))
    return written(names, "entity-sentences"), written(rows.select(*KEY, "at", F.explode(words).alias("term")), "term-sentences")


def _term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df_t): distinct texts that hold each of ``terms``.

    Words of the corpus pass a filter of ``FILTER_BITS`` bits first, a table of that bounded size, so
    that only words that may be asked for are shuffled.
    """
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    bits = terms.select(place("term").alias("place")).groupBy(F.expr("place div 64").alias("slot")).agg(
        F.bit_or(bit).alias("bits")
    )
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    seen = docs.where(F.col("text").isNotNull()).select(*(c.alias(k) for k, c in text_keys(F.col("text")).items()), F.explode(words).alias("term"))
    seen = seen.withColumn("place", place("term")).withColumn("slot", F.expr("place div 64"))
    seen = seen.join(F.broadcast(bits), "slot").where(F.col("bits").bitwiseAND(bit) != 0)
    held = seen.join(terms, "term").select("term", *KEY).distinct()
    return held.groupBy("term").agg(F.count("*").alias("df_t"))


def _classed(rows: DataFrame, name: str) -> DataFrame:
    """(``name``, class, df): members of the same texts share a class; ``rows``: distinct (k1, k2, name)."""
    marks = [F.bit_xor(F.xxhash64(F.lit(i), *KEY)).alias(f"x{i}") for i in (1, 2)]
    own = rows.groupBy(name).agg(F.count("*").alias("df"), *marks)
    return own.select(name, F.xxhash64("df", "x1", "x2").alias("class"), "df")


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(k1, k2, term, share): the terms of each text that disclose an entity of it, stored."""
    holders = found.where("text is not null").groupBy(*KEY).agg(F.first("text").alias("text"))
    entity_rows, term_rows = _sentences(holders)
    texts = found.select(*KEY).distinct().count()
    most = float(max(texts, 1)) ** (1 - GENERALISE)  # how much commoner than the pair a term may be

    names = entity_rows.select(*KEY, "entity").distinct()
    entity_class = written(_classed(names, "entity"), "entity-classes")
    of_text = written(names.join(entity_class, "entity").select(*KEY, F.col("class").alias("e"), F.col("df").alias("df_e")).distinct(), "text-classes")
    # No pair is seen in more texts than its entity is, which bounds the terms that can disclose any of a text's.
    widest = of_text.groupBy(*KEY).agg(F.max("df_e").alias("widest"))
    terms = term_rows.select(*KEY, "term").distinct()
    hopeful = terms.join(widest, list(KEY)).groupBy("term").agg(F.count("*").alias("held"), F.max("widest").alias("widest"))
    hopeful = written(hopeful.where(F.col("held") <= F.col("widest") * most).select("term", "widest"), "hopeful-terms")
    counts = _term_counts(docs, hopeful.select("term")).join(hopeful, "term").where(F.col("df_t") <= F.col("widest") * most)
    counts = written(counts.select("term", "df_t"), "term-counts")
    terms = written(terms.join(counts, "term"), "terms")
    term_class = _classed(terms.select(*KEY, "term"), "term").join(counts, "term")
    term_class = written(term_class.select("term", F.xxhash64("class", "df_t").alias("t"), "df_t"), "term-classes")
    of_terms = terms.select(*KEY, "term").join(term_class, "term").select(*KEY, "t", "df_t").distinct()

    pairs = of_terms.join(of_text, list(KEY)).groupBy("t", "e", "df_t", "df_e").agg(F.count("*").alias("n"))
    excess = F.log2(F.col("df_t") / F.col("n"))
    own = F.log2(F.lit(float(max(texts, 1))) / F.col("df_e"))
    pairs = pairs.withColumn("share", F.when(own > 0, 1 - excess / own).otherwise(F.lit(0.0)))
    pairs = written(pairs.where(F.col("share") >= GENERALISE).select("t", "e", "n", "share"), "pairs")

    members = terms.select(*KEY, "term").join(term_class.select("term", "t"), "term")
    often = members.join(of_text.select(*KEY, "e"), list(KEY)).join(pairs.where(F.col("n") >= SUPPORT), ["t", "e"])
    once = entity_rows.join(entity_class.select("entity", F.col("class").alias("e")), "entity").select(*KEY, "at", "e").distinct()
    once = once.join(term_rows.join(term_class.select("term", "t"), "term"), [*KEY, "at"])
    once = once.join(pairs.where(F.col("n") < SUPPORT), ["t", "e"])
    both = often.select(*KEY, "term", "share").unionByName(once.select(*KEY, "term", "share"))
    return written(both.groupBy(*KEY, "term").agg(F.max("share").alias("share")), "disclosing")


def term_spans(found: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(k1, k2, terms): all places of the disclosing terms of a text, for the texts that have any."""
    texts = found.where("text is not null").join(disclosing.select(*KEY).distinct(), list(KEY), "leftsemi")
    texts = texts.groupBy(*KEY).agg(F.first("text").alias("text"), *(F.first(k).alias(k) for k in KINDS))
    kinds = F.concat(*(F.transform(k, lambda s: F.struct(s["start"], s["stop"], F.lit("").alias("value"))) for k in KINDS))
    # In the order of their starts, a place is taken if it begins where no entity reaches.
    marks = F.array_sort(F.concat(kinds.cast(SPANS), places(F.col("text"), TERM)))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, s):
        free = (s["value"] != "") & (s["start"] >= acc["at"])
        reach = F.when(s["value"] == "", F.greatest(acc["at"], s["stop"])).otherwise(acc["at"])
        return F.struct(reach.alias("at"), F.when(free, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    free = in_runs(marks, start, step, F.concat)["out"]
    own = texts.select(*KEY, F.explode(free).alias("s")).select(*KEY, F.lower("s.value").alias("term"), "s.start", "s.stop")
    hit = own.join(disclosing, [*KEY, "term"])
    return hit.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "share"))).alias("terms"))


def with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` (k1, k2, ...) with their ``terms``, an empty array if none."""
    none = F.array().cast("array<struct<start:bigint,stop:bigint,share:double>>")
    return rows.join(terms, list(KEY), "left").withColumn("terms", F.coalesce("terms", none))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: counts by kind, the digest of the base spans, and all spans."""
    found = found_entities(docs)
    terms = term_spans(found, disclosing_terms(docs, found))
    f = with_terms(found.drop("text"), terms)
    place = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["stop"].cast("string"))
    base = F.transform(F.concat(*KINDS), lambda s: place(s["kind"], s))
    more = F.transform("terms", lambda s: place(F.lit("term"), s))
    return f.select(
        "doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", F.concat(base, more)).alias("spans"),
    )


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with labels in the place of ``spans`` (start, stop, label), sorted.

    A span that begins inside the one before only extends what is left out. Runs of spans are cut out of
    the text first, so that pieces are looked up in short texts.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def run(own: Column, acc: Column, i: Column) -> Column:
        part = F.slice(own, i + 1, F.lit(RUN))
        last = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["stop"])))
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (last - acc["at"]).cast("int"))

        def step(piece_text: Column):
            def one(a, s):
                between = F.substring(piece_text, (a["at"] - acc["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
                added = F.when(s["start"] >= a["at"], F.concat(between, s["label"])).otherwise(F.lit(""))
                return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.concat(a["out"], added).alias("out"))

            return one

        made = let(piece, lambda p: F.aggregate(part, acc.withField("out", F.lit("")), step(p)))
        return let(made, lambda r: r.withField("out", F.concat(acc["out"], r["out"])))

    def folded(own: Column) -> Column:
        every = F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(RUN))
        rest = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
        return F.aggregate(every, start, lambda acc, i: run(own, acc, i), rest)

    return let(spans, folded)


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with entities and disclosing terms replaced in ``text``; null texts stay null."""
    found = found_entities(docs)
    terms = written(term_spans(found, disclosing_terms(docs, found)), "terms")
    names = docs.columns
    inner = {c: f"in_{i}" for i, c in enumerate(names)}  # no clash with the columns made here
    d = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in inner.items()))
    text = F.col(inner["text"])
    d = with_terms(d.withColumns(text_keys(F.coalesce(text, F.lit("")))), terms)
    label = lambda s: s.alias("label")
    base = F.concat(*(entities(F.coalesce(text, F.lit("")), k) for k in KINDS))
    spans = F.concat(
        F.transform(base, lambda s: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), label(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        )),
        F.transform("terms", lambda s: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"),
            label(F.when(s["share"] >= REMOVE, F.lit("")).otherwise(F.lit("[TERM]"))),
        )),
    )
    d = d.withColumn("spans", F.sort_array(spans))
    clean = F.when(F.size("spans") > 0, replaced(text, F.col("spans"))).otherwise(text)
    return d.select(*(clean.alias("text") if c == "text" else F.col(a).alias(c) for c, a in inner.items()))

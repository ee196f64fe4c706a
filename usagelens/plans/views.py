"""Usage tables derived from the star-schema test tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.sources.normalize import normalize

# Model names handed out by id modulo 8; the eighth is null.
MODELS = (
    "gpt-4o",
    "gpt-4o-mini",
    "claude-3-opus-20240229",
    "claude-3-haiku-20240307",
    "gemini-1.5-pro",
    "o1-preview",
    "some-custom-model",
    None,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer files than cores is dealt out to them, as text work is heavy per row.

    Tables of many files, the normal case on a cluster, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def model_by(key) -> F.Column:
    return F.element_at(F.array(*map(F.lit, MODELS)), (key % 8 + 1).cast("int"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of_events(table(spark, sf_dir, "events"))


def log_of_events(e: DataFrame) -> DataFrame:
    """Events, batch or stream, as a per-request log without prompts."""
    fields = {
        "timestamp": F.when(F.col("event_id") % 97 != 0, F.col("ts")),
        "model": model_by(F.col("user_id")),
        "route": F.col("event_type"),
        "input_tokens": F.floor(F.col("value") * 100),
        "output_tokens": F.col("event_id") % 800,
        "cost_usd": F.col("value") / 1000,
        "is_error": F.coalesce(F.col("event_type") == "error", F.lit(False)),
        "status": F.col("event_type"),
    }
    return normalize(e, "litellm_jsonl", fields)


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a billing export."""
    items = table(spark, sf_dir, "lineitem")
    fields = {
        "timestamp": F.col("l_shipdate"),
        "model": model_by(F.col("l_suppkey")),
        "route": F.col("l_returnflag"),
        "input_tokens": F.floor("l_extendedprice"),
        "cost_usd": F.when(
            F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice") * F.col("l_discount")
        ),
        "n_requests": F.coalesce(F.nullif(F.floor("l_quantity"), F.lit(0)), F.lit(1)),
    }
    return normalize(items, "openai_csv", fields)


def document_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts of a request log."""
    docs = table(spark, sf_dir, "documents").select("text", "lang", "source", "n_chars")
    fields = {"model": F.col("source"), "route": F.col("lang"), "input_tokens": F.col("n_chars")}
    return normalize(docs, "litellm_jsonl", fields, prompt=F.col("text"))


# Shape of the templated prompts (vocabulary, templates, words a prompt).
VOCABULARY = 2000
TEMPLATES = 50
PROMPT_WORDS = 20


def _number(key: F.Column, below: int) -> F.Column:
    """A number that looks random, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint") % below


def templated_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 20-word prompt per event: 40 % template copies, 30 % one word changed, 30 % unique."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id"))
    slot = F.col("event_id") % 10
    template = F.concat(F.lit("t"), (F.col("event_id") % TEMPLATES).cast("string"), F.lit(":"))
    own = F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(":"))
    changed = F.when((slot >= 4) & (slot < 7), _number(F.concat(own, F.lit("at")), PROMPT_WORDS))

    def word(i: F.Column) -> F.Column:
        seed = F.when((slot >= 7) | F.coalesce(i == changed, F.lit(False)), own).otherwise(template)
        name = _number(F.concat(seed, i.cast("string")), VOCABULARY)
        return F.concat(F.lit("tok"), name.cast("string"))

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PROMPT_WORDS - 1)), word), " ")
    return normalize(e, "litellm_jsonl", {"model": model_by(F.col("user_id"))}, prompt=text)


def varied_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding, and a variant of it with one component negated under a negative id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    at = F.col("vec_id") % F.size("embedding")
    variant = F.transform("embedding", lambda x, i: F.when(i == at, -x).otherwise(x))
    return rows.union(rows.select(-F.col("vec_id") - 1, variant))

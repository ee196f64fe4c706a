"""Audits of output tables: leaked text, identifiers, and words of advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longest string an output may hold, identifier shapes, the allowed mail domain,
# and the words a report must not hold.
MAX_TEXT = 200
IDENTIFIER = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|org-[A-Za-z0-9]{8,}|sk-[A-Za-z0-9.]{2,}"
)
ALLOWED_MAIL = r"^[A-Za-z0-9._%+-]+@example\.com$"
ADVICE = ("recommend", "should ", "consider ", "savings", "switch to", "migrate")


def text_cells(df: DataFrame) -> DataFrame:
    """(column, text): the string cells of a table, one row each."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = [F.struct(F.lit(n).alias("column"), F.col(n).alias("text")) for n in names]
    return df.select(F.inline(F.array(*cells))).where("text is not null")


def _any_of(text: Column, fragments: list[str]) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for fragment in fragments:
        found = found | F.contains(lowered, F.lit(fragment.lower()))
    return found


def leak_audit(df: DataFrame, fragments: list[str]) -> DataFrame:
    """Per string column: cells, cells too long for an aggregate, cells with a given fragment."""
    return (
        text_cells(df)
        .groupBy("column")
        .agg(
            F.count("*").alias("cells"),
            F.count_if(F.length("text") >= MAX_TEXT).alias("long_cells"),
            F.count_if(_any_of(F.col("text"), fragments)).alias("leaking_cells"),
        )
    )


def unexpected_columns(df: DataFrame, allowed: list[str]) -> list[str]:
    return [c for c in df.columns if c not in allowed]


def identifier_scan(df: DataFrame) -> DataFrame:
    """(column, kind, hits): mail addresses, organisation ids and keys in the string cells."""
    hit = F.col("hit")
    kind = (
        F.when(F.contains(hit, F.lit("@")), "mail")
        .when(F.startswith(hit, F.lit("org-")), "organisation")
        .otherwise("key")
    )
    return (
        text_cells(df)
        .select("column", F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("hit"))
        .where(~F.rlike(hit, F.lit(ALLOWED_MAIL)))
        .groupBy("column", kind.alias("kind"))
        .agg(F.count("*").alias("hits"))
    )


def advice_cells(df: DataFrame) -> DataFrame:
    """Per string column: cells, and cells that hold a word of advice."""
    return (
        text_cells(df)
        .groupBy("column")
        .agg(
            F.count("*").alias("cells"),
            F.count_if(_any_of(F.col("text"), list(ADVICE))).alias("advising_cells"),
        )
    )

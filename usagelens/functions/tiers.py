"""Price tier of a model, from its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns of each tier, tried in this order.
TIER_PATTERNS = {
    "cheap": [
        r"(?<![a-z])mini",
        r"nano",
        r"(?<![a-z])lite(?![a-z])",
        r"haiku",
        r"flash",
        r"3\.5-turbo",
        r"35-turbo",
    ],
    "frontier": [
        r"opus",
        r"(?<![a-z0-9])o1(?![a-z])",
        r"(?<![a-z0-9])o3(?![a-z])",
        r"gpt-4\.5",
        r"gpt-5",
        r"ultra",
    ],
    "mid": [
        r"gpt-4",
        r"sonnet",
        r"gemini-1\.5-pro",
        r"gemini-pro",
        r"mistral-large",
    ],
}
UNKNOWN = "unknown"


def price_tier(model: Column) -> Column:
    name = F.lower(model)
    tier = F
    for label, patterns in TIER_PATTERNS.items():
        tier = tier.when(name.rlike("|".join(patterns)), F.lit(label))
    return tier.otherwise(F.lit(UNKNOWN))


def model_name(model: Column) -> Column:
    return F.coalesce(F.nullif(model, F.lit("")), F.lit(UNKNOWN))


def day_name(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(UNKNOWN))

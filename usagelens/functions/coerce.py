"""Tolerant cell coercion. Nothing here raises: what cannot be read becomes null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The text of a number, and the timestamp layouts in the order they are tried.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]{1,18}$"
EPOCH_SECONDS = r"^[0-9]{9,10}$"
EPOCH_MILLIS = r"^[0-9]{12,13}$"
BASIC_DATE = r"^[0-9]{8}$"
ISO_DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"
LOOSE_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
TIME_ZONE = r"([T ][0-9:.]+)(Z|[+-][0-9]{2}(:?[0-9]{2}){0,2})$"

# Fixed value: the mark a decoder puts in place of bytes that are not UTF-8.
UNDECODABLE = "\ufffd"

# Status words that mark a failed request.
ERROR_WORDS = ("failure", "error", "failed")
HTTP_ERROR_FROM = 400


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def drop_undecodable(c: Column) -> Column:
    """Drop bytes that are not UTF-8, and nothing else: a mark that was in the text itself stays."""
    own = F.replace(F.replace(c, F.lit("\x01"), F.lit("\x01E")), F.lit(UNDECODABLE), F.lit("\x01F"))
    clean = F.replace(F.make_valid_utf8(own), F.lit(UNDECODABLE), F.lit(""))
    whole = F.replace(F.replace(clean, F.lit("\x01F"), F.lit(UNDECODABLE)), F.lit("\x01E"), F.lit("\x01"))
    return F.when(F.is_valid_utf8(c), c).otherwise(whole)


def first_filled(candidates: Iterable[Column]) -> Column:
    """First candidate that is neither null nor blank, unstripped; null if there is none."""
    filled = [F.when(strip(c) != "", c) for c in candidates]
    return F.coalesce(*filled) if filled else F.lit(None).cast("string")


def _guarded(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text).try_cast("double")


# The ``..._of`` functions take text that is stripped already. Readers strip in a projection of
# its own, so a value is not stripped again at every place an expression names it.


def double_of(t: Column) -> Column:
    x = _guarded(strip(F.ltrim(F.replace(t, F.lit(","), F.lit("")), F.lit("$"))))
    return F.when(F.abs(x) < float("inf"), x)


def long_of(t: Column) -> Column:
    """Whole part of a number, cut toward zero. Plain integers take the short way."""
    plain = F.replace(t, F.lit(","), F.lit(""))
    return _integer(t).otherwise(_guarded(strip(plain)).try_cast("bigint"))


def _integer(t: Column) -> Column:
    # A failing cast costs an exception inside Spark, so only text that fits is cast.
    return F.when(t.rlike(INTEGER), t.try_cast("bigint"))


def timestamp_of(t: Column) -> Column:
    """Wall clock as written: an offset is dropped, never applied. Epochs are UTC."""
    day = F.substring(t, 1, 10)
    clock = F.regexp_replace(t, TIME_ZONE, "$1")
    dashed = F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
    return (
        F.when(
            t.rlike(ISO_DATE_TIME),
            F.coalesce(clock.try_cast("timestamp_ntz"), day.try_cast("timestamp_ntz")),
        )
        .when(t.rlike(EPOCH_SECONDS), _from_epoch(t.try_cast("bigint")))
        .when(t.rlike(EPOCH_MILLIS), _from_epoch(F.floor(t.try_cast("bigint") / 1000)))
        .when(t.rlike(BASIC_DATE), dashed.try_cast("timestamp_ntz"))
        .when(day.rlike(LOOSE_DATE), day.try_cast("timestamp_ntz"))
    )


def _from_epoch(seconds: Column) -> Column:
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def to_double(c: Column) -> Column:
    return double_of(strip(c))


def to_long(c: Column) -> Column:
    return long_of(strip(c))


def to_timestamp(c: Column) -> Column:
    return timestamp_of(strip(c))


def at_least_one(n: Column) -> Column:
    """Requests a row stands for; null and 0 both count as one."""
    return F.coalesce(F.nullif(n, F.lit(0)), F.lit(1)).cast("bigint")


def failed_in_words(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin(*ERROR_WORDS), F.lit(False))


def failed_over_http(c: Column) -> Column:
    """A status code of 400 or more, or a word for failure."""
    t = strip(c)
    code = _integer(t).otherwise(_guarded(t).try_cast("bigint"))
    return F.coalesce(code >= HTTP_ERROR_FROM, failed_in_words(c))

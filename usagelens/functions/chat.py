"""Reading JSON values whose shape is not known in advance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _typed(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def as_text(v: Column, path: str) -> Column:
    """Scalar or nested value as text; null when missing or JSON null."""
    return _typed(v, path, "string")


def string_only(v: Column, path: str) -> Column:
    """The value when it is a JSON string, else null."""
    inner = _typed(v, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", _typed(v, path, "string"))


def is_truthy(v: Column, path: str) -> Column:
    """False for missing, null, false, zero, and empty strings, lists and objects."""
    text = as_text(v, path)
    # Only text that may spell a false value needs the slower look at its JSON type.
    doubtful = text.isin("false", "[]", "{}") | F.coalesce(text.try_cast("double") == 0, F.lit(False))
    is_string = F.schema_of_variant(_typed(v, path, "variant")) == "STRING"
    return F.when(F.coalesce(text, F.lit("")) == "", False).when(doubtful, is_string).otherwise(True)


def first_truthy(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.when(is_truthy(v, p), as_text(v, p)) for p in paths])


def _variant_array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def message_text(v: Column, path: str = "$.messages") -> Column:
    """Text of a chat: every message's string content, or the text of its content blocks.

    Non-empty parts of all roles are joined by a line feed; null when nothing is left.
    """

    def parts(message: Column) -> Column:
        content = _typed(message, "$.content", "variant")
        blocks = F.transform(
            _variant_array(message, "$.content"), lambda b: string_only(b, "$.text")
        )
        plain = F.when(F.schema_of_variant(content) == "STRING", F.array(as_text(message, "$.content")))
        return F.coalesce(blocks, plain, F.array().cast("array<string>"))

    texts = F.flatten(F.transform(_variant_array(v, path), parts))
    kept = F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    return F.nullif(F.array_join(kept, "\n"), F.lit(""))

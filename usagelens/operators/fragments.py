"""Does any output cell hold a fragment of any prompt? An audit of all prompts against all cells.

A prompt is cut into blocks of ``width`` characters, one after the other; a cell gives the blocks at all of
its places. A cell that holds 2 * width - 1 characters or more of a prompt in a row holds one of its blocks
whole, wherever the fragment begins. Blocks are compared by salted digest, so no text leaves the stage that reads it.
Blocks of prompts pass a table of bits of the cells' blocks first, of a fixed size, so that only
blocks which some cell may hold are sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.prompts import DEFAULT_SALT
from usagelens.operators.audit import MAX_TEXT

WIDTH = 16
FILTER_BITS = 1 << 22
CHUNK = 256
DIGEST_BYTES = 16


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, "[ \t\r\n\f]+", " ")))


def _pieces(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def prompt_blocks(text: Column, width: int = WIDTH) -> Column:
    """Whole blocks of a text, one after the other; one scan of it."""
    return F.filter(_pieces(_plain(text), width), lambda b: F.length(b) == width)


def cell_blocks(text: Column, width: int = WIDTH) -> Column:
    """Blocks at all places of a cell. Long cells are cut first, so that places are looked up in short texts."""
    chunks = F.transform(F.array(_pieces(_plain(text), CHUNK)), lambda own: F.transform(
        own, lambda c, i: F.concat(c, F.substring(F.coalesce(F.get(own, i + 1), F.lit("")), 1, width - 1))
    ))[0]
    return F.array_distinct(F.flatten(F.transform(chunks, lambda c: F.when(F.length(c) >= width, F.transform(
        F.sequence(F.lit(1), F.length(c) - (width - 1)), lambda i: F.substring(c, i, F.lit(width))
    )).otherwise(F.array().cast("array<string>")))))


def leaf_strings(json: Column) -> Column:
    """All strings of a JSON text, keys among them, with their escapes undone."""
    quoted = F.regexp_extract_all(json, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'), F.lit(0))
    return F.transform(quoted, lambda q: F.from_json(F.concat(F.lit("["), q, F.lit("]")), "array<string>")[0])


def _place(block: Column) -> Column:
    return F.pmod(F.xxhash64(block), F.lit(FILTER_BITS))


def _digest(block: Column, salt: str) -> Column:
    """Half of a salted SHA-256 as bytes: still 128 bits, a quarter of the hex text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.lit(salt), block), 256)), 1, DIGEST_BYTES)


def fragment_hits(prompts: DataFrame, cells: DataFrame, width: int = WIDTH, salt: str = DEFAULT_SALT) -> DataFrame:
    """The distinct ``cell`` of ``cells`` (cell, text) that hold a block of one of ``prompts`` (text)."""
    block = F.col("block")
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    slot = F.expr("place div 64")
    wanted = cells.select("cell", F.explode(cell_blocks(F.col("text"), width)).alias("block"))
    # At most FILTER_BITS / 64 rows.
    bits = wanted.select(_place(block).alias("place")).groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits"))
    own = prompts.select(F.explode(prompt_blocks(F.col("text"), width)).alias("block"))
    own = own.select("block", _place(block).alias("place")).withColumn("slot", slot)
    passed = own.join(F.broadcast(bits), "slot").where(F.col("bits").bitwiseAND(bit) != 0)
    held = passed.select(_digest(block, salt).alias("digest")).distinct()
    return wanted.select("cell", _digest(block, salt).alias("digest")).join(held, "digest").select("cell").distinct()


def fragment_audit(prompts: DataFrame, cells: DataFrame, width: int = WIDTH, salt: str = DEFAULT_SALT) -> DataFrame:
    """Per ``column`` of ``cells`` (column, cell, text): cells, long ones, and those with a fragment of any prompt."""
    hits = fragment_hits(prompts, cells, width, salt).withColumn("leaks", F.lit(True))
    return cells.join(hits, "cell", "left").groupBy("column").agg(
        F.count("*").alias("cells"),
        F.count_if(F.length("text") >= MAX_TEXT).alias("long_cells"),
        F.count_if(F.coalesce("leaks", F.lit(False))).alias("leaking_cells"),
    )


def report_cells(lines: DataFrame) -> DataFrame:
    """(column, cell, text): every string of every report line, by metric; equal strings of a metric are one cell."""
    strings = F.explode(F.concat(F.array("key"), leaf_strings(F.col("value")))).alias("text")
    rows = lines.select(F.col("metric").alias("column"), strings).distinct()
    return rows.withColumn("cell", F.sha2(F.concat_ws("\x01", "column", "text"), 256))

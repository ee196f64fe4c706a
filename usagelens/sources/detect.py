"""Format of every file under a path, from its first non-blank line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.coerce import drop_undecodable, strip
from usagelens.functions.formats import format_of_line

# Schemes whose file heads Python can open in a task. Others are scanned as text.
HEAD_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
HEADS_PER_TASK = 256


def _head_reader(schemes: dict[str, str]):
    """A reader of first lines. As a closure it is shipped whole, so workers need no package."""

    def opened(path: str):
        from pyarrow import fs

        scheme, rest = path.split(":", 1)
        # The name is never part of a URI, so it may hold blanks and any mark.
        if scheme == "file":
            return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression="detect")
        host, _, name = rest.removeprefix("//").partition("/")
        store, _ = fs.FileSystem.from_uri(f"{schemes[scheme]}://{host}")
        return store.open_input_stream(f"/{name}" if scheme == "hdfs" else f"{host}/{name}", compression="detect")

    def head(path: str) -> bytes | None:
        parts: list[bytes] = []
        with opened(path) as f:
            while chunk := f.read(1 << 16):
                chunk = chunk if parts else chunk.lstrip()
                if chunk:
                    parts.append(chunk)
                if b"\n" in chunk or b"\r" in chunk:
                    break
        return keys_only(b"".join(parts).splitlines()[0]) if parts else None

    def keys_only(line: bytes) -> bytes:
        """A JSON line without its values: top-level keys and the keys of objects under them."""
        import json

        if not line.lstrip(b"\xef\xbb\xbf").startswith((b"{", b"[")):
            return line
        try:
            value = json.loads(line.decode("utf-8", "ignore"))
        except (ValueError, RecursionError):
            return line[:1]
        if not isinstance(value, dict):
            return b"[]"
        bare = {k: dict.fromkeys(v, 0) if isinstance(v, dict) else 0 for k, v in value.items()}
        return json.dumps(bare).encode()

    def read_heads(batches):
        for batch in batches:
            yield batch.assign(head=[head(p) for p in batch["path"]])

    return read_heads


def first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, head): the first non-blank line of every file, null for an empty file; of JSON, the keys.

    The listing reads no content. Heads are read in tasks, a block per file, so the cost
    follows the number of files and not their size.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(paths)
        .select("path", "length")
    )
    schemes = {r.s for r in listing.select(F.split("path", ":")[0].alias("s")).distinct().collect()}
    if schemes <= set(HEAD_SCHEMES):
        tasks = max(1, listing.count() // HEADS_PER_TASK)
        return (
            listing.select("path")
            .repartition(tasks)
            .mapInPandas(_head_reader(HEAD_SCHEMES), "path string, head binary")
            .select("path", strip(drop_undecodable(F.col("head").cast("string"))).alias("head"))
        )
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(paths)
        .select(
            F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias(
                "path"
            ),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("row_id"),
            strip(drop_undecodable(F.col("value"))).alias("line"),
        )
        .where("line <> ''")
    )
    return lines.groupBy("path").agg(
        F.min_by("line", F.struct("split_start", "row_id")).alias("head")
    )


def detect_formats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, head, format) with the format null where no rule matches."""
    return first_lines(spark, paths).withColumn("format", format_of_line(F.col("head")))

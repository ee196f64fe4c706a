"""Written tables for results that several jobs read.

A written table survives the loss of any executor, cuts the lineage, and is read
back with column pruning. It goes to the shared folder the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH = "usagelens.scratch"  # a setting that a running session can change

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get(SCRATCH, None) or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir or {SCRATCH} to a folder every executor can reach")
        root = _local_roots.setdefault(app, tempfile.mkdtemp(prefix="usagelens-"))
    return f"{root.rstrip('/')}/usagelens/{app}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and return the stored table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> None:
    """Remove this application's written tables. DataFrames that read them cannot be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Reading and writing tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schemas import schema, validate


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def library_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a photo library with its schema stated, not inferred."""
    return validate(spark.read.schema(schema(name)).parquet(f"{folder.rstrip('/')}/{name}.parquet"), name)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes aside and renames, so that readers see the old table or the new one; ``df`` may read the old one."""
    spark = df.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(aside)
    jvm = spark.sparkContext._jvm
    to, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(aside)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{aside}.old")
    if fs.exists(to):
        fs.rename(to, old)
    if not fs.rename(new, to):
        raise OSError(f"can't rename {aside}")
    fs.delete(old, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names, deleted when the driver ends.

    Only in local mode, as in tests, a folder of this machine stands in for one that is unset.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = at or "file://" + tempfile.mkdtemp(prefix="shutterlake-")
    path = f"{at.rstrip('/')}/shutterlake-core/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its lineage is cut, and the loss of an executor doesn't lose it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Files as sinks: copies of what differs in size, and rows written in batches that appear whole or not at all."""

from __future__ import annotations

import os
import posixpath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COPY, KEEP = "COPY", "KEEP"
#: Rows after which a buffer writes.
BATCH = 50


def copy_plan(source: DataFrame, target: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Each source file with action COPY, if the target has none of its name or one of another size, else KEEP."""
    there = target.select(path, F.col(size).alias("_size"))
    out = source.join(there, path, "left")
    return out.withColumn("action", F.when(F.col("_size").eqNullSafe(F.col(size)) & F.col("_size").isNotNull(), KEEP).otherwise(COPY)).drop("_size")


def copy(plan: DataFrame, from_folder: str, to_folder: str) -> DataFrame:
    """Copies the files that a plan (path, relative; action) says; a row for each with the bytes copied. A task run again copies again."""

    def run(batches):
        source, a = pafs.FileSystem.from_uri(from_folder)
        target, b = pafs.FileSystem.from_uri(to_folder)
        for batch in batches:
            sizes = []
            for path in batch.column(0).to_pylist():
                at = posixpath.join(b, path)
                target.create_dir(os.path.dirname(at), recursive=True)
                with source.open_input_stream(posixpath.join(a, path)) as reader, target.open_output_stream(at) as writer:
                    size = 0
                    while part := reader.read(1 << 20):
                        size += writer.write(part) or len(part)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return plan.where(F.col("action") == COPY).select("path").mapInArrow(run, "path string, bytes long")


class RowBuffer:
    """Collects rows and appends them to a table in batches; a batch is one write, which readers see whole or not at all.

    A failed write keeps its rows, so that ``flush`` can be tried again. Leaving the ``with`` block flushes what is left.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str, batch: int = BATCH):
        self.spark, self.path, self.ddl, self.batch = spark, path, ddl, batch
        self.rows: list[tuple] = []

    def add(self, *rows: tuple) -> None:
        self.rows += rows
        if len(self.rows) >= self.batch:
            self.flush()

    def write(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.mode("append").parquet(self.path)

    def flush(self) -> None:
        if self.rows:
            self.write(self.rows)
            self.rows = []

    def close(self) -> None:
        self.flush()

    def __enter__(self):
        return self

    def __exit__(self, *what) -> None:
        self.close()

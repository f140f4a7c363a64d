"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import flag

#: Tables with at most so many rows are joined by broadcast; larger ones by a shuffle.
MOST_BROADCAST = 500_000
#: The values of a join key that are hot: so many at most, with more than so many rows.
LEAST_HOT, MOST_HOT = 256, 500
#: Bits of a chunk of a bitmap, as a power of 2.
CHUNK = 16


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only in local mode, as in tests, a folder of this machine stands in for one that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get() if known.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shutterlake-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _located(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    at = f"{shared_dir(spark).rstrip('/')}/shutterlake/{name}-{uuid.uuid4().hex}"
    fs, path = _located(spark, at)
    fs.deleteOnExit(path)
    return at


class Scratch:
    """Written tables that only the making of a result needs; ``drop`` deletes them before the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        at = fresh(self.spark, name)
        self.paths.append(at)
        return _write(df, at)

    def keep_last(self) -> None:
        """The table written last is the result, and stays."""
        self.paths.pop()

    def drop(self) -> None:
        for at in self.paths:
            fs, path = _located(self.spark, at)
            fs.delete(path, True)
        self.paths.clear()


def _write(df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its lineage is cut, and the loss of an executor doesn't lose it."""
    return _write(df, fresh(df.sparkSession, name))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, broadcast in joins only if it has few rows."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap, of 2 to the power of ``bits`` whatever the table's size, of the top bits of its one column of 64-bit hashes."""
    h = F.col(hashes.columns[0])
    top = F.shiftrightunsigned(h, 64 - bits)
    chunks = hashes.select(F.shiftright(top, CHUNK).alias("chunk"), top.bitwiseAND((1 << CHUNK) - 1).cast("int").alias("bit")).distinct()
    step = 1 << (CHUNK - 3)

    def pack(key, table):
        flags = np.zeros(1 << CHUNK, bool)
        flags[table.column("bit").to_numpy()] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in chunks.groupBy("chunk").applyInArrow(pack, "chunk long, packed binary").toLocalIterator():
        out[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(r["packed"], np.uint8)
    return out


def in_bitmap(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in the bitmap; those that are, are."""
    bits = int(len(packed)).bit_length() + 2
    top = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[top >> 3] >> (7 - (top & 7)).astype(np.uint8)) & 1 > 0


def member(hashes: DataFrame, bits: int) -> Callable[[Column], Column]:
    """A function of a column of 64-bit hashes: false only for those that are not in ``hashes``."""
    handle = hashes.sparkSession.sparkContext.broadcast(bitmap(hashes, bits))

    def run(columns):
        for column in columns:
            yield pa.array(in_bitmap(handle.value, column.to_numpy(zero_copy_only=False).view(np.uint64)), pa.bool_())

    return flag(run)


def hot(table: DataFrame, key: str) -> list:
    """The values of a column with the most rows, ``MOST_HOT`` at most and each with more than ``LEAST_HOT``; any other has at most a ``MOST_HOT``-th of all rows."""
    counts = table.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > LEAST_HOT)
    return [r[0] for r in counts.orderBy(F.desc("n")).limit(MOST_HOT).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, values: list, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has each key once; rows of the hot ``values`` stay where they are."""
    if not values:
        return left.join(right, key, how)
    often = F.coalesce(F.col(key).isin(values), F.lit(False))
    few = left.where(often).join(F.broadcast(right.where(often)), key, how)
    return few.unionByName(left.where(~often).join(right.where(~often), key, how))


def running(df: DataFrame, order: list[Column], sums: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``before``, the number of rows before each in a total order, and for each column x of ``sums``, ``before_x``, their sum of x.

    Rows are dealt by range and numbered within each part; the driver gets one row for each part, to add the parts before it.
    """
    extra = ["before", *(f"before_{x}" for x in sums)]
    ready = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema, *[T.StructField(x, T.LongType()) for x in extra], T.StructField("part", T.IntegerType())])

    def run(batches):
        had = dict.fromkeys(extra, 0)
        part = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            own = [np.ones(n, np.int64), *(batch.column(x).to_numpy(zero_copy_only=False) for x in sums)]
            out = []
            for x, v in zip(extra, own):
                total = np.cumsum(v)
                out.append(pa.array(had[x] + total - v, pa.int64()))
                had[x] += int(total[-1]) if n else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(n, part, np.int32))], names=[*batch.schema.names, *extra, "part"])

    table = scratch.written(ready.mapInArrow(run, schema), name)
    parts = table.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"sum_{x}") for x in sums]).orderBy("part").collect()
    offsets, had = [], [0] * len(extra)
    for r in parts:
        offsets.append(had)
        had = [a + b for a, b in zip(had, r[1:])]
    # As Arrow, which the JVM takes without Python workers.
    columns = {"part": pa.array([r["part"] for r in parts], pa.int32())} | {f"add_{x}": pa.array([o[k] for o in offsets], pa.int64()) for k, x in enumerate(extra)}
    add = df.sparkSession.createDataFrame(pa.table(columns))
    return table.join(F.broadcast(add), "part").select(*df.columns, *[(F.col(x) + F.col(f"add_{x}")).alias(x) for x in extra])

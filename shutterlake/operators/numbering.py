"""Numbers and running counts over a whole table, without gathering it: rows are dealt by range and counted within each part."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def in_parts(df: DataFrame, order: list, name: str) -> DataFrame:
    """A written table with ``_part``: every row of a part comes before every row of the next one."""
    return checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


def offsets(table: DataFrame, count: Column) -> DataFrame:
    """_part and _before, the sum of ``count`` over all parts before it; the driver gets a row for each part."""
    rows, before = [], 0
    for r in table.groupBy("_part").agg(count.alias("n")).orderBy("_part").collect():
        rows.append((r["_part"], before))
        before += r["n"] or 0
    parts, sums = zip(*rows) if rows else ((), ())
    return table.sparkSession.createDataFrame(pa.table({"_part": pa.array(parts, pa.int32()), "_before": pa.array(sums, pa.int64())}))


def row_numbers(df: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """``df`` with the place of each row in a total order, from ``first`` on."""
    table = in_parts(df, order, "numbers")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return table.join(F.broadcast(offsets(table, F.count("*"))), "_part").withColumn(name, (within + F.col("_before") + (first - 1)).cast("long")).drop("_part", "_before")

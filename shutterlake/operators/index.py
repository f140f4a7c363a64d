"""A vector index as files: cells around centroids, changes in segments, exact search that skips cells which can't matter.

A commit writes one segment of upserted rows and tombstones; readers take the newest entry of each id. ``compact`` merges the
segments into a new base, with centroids fitted on a bounded sample. For unit vectors the angle to a cell's centroid and the
cell's radius bound every similarity inside it, so that search reads the most promising cells, and then only those whose bound
reaches the k-th best found.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import dot
from ..sources.tables import replace_table
from .cluster import spherical_kmeans
from .vectors import best_prototype, nearest

ROWS = "id long, person_id long, embedding array<double>"
SAMPLE, MOST_CELLS, PROBED = 20_000, 1024, 4
MOST_BROADCAST = 200_000


class VectorIndex:
    """Rows (id, person_id, embedding) under ``path``; changes show after ``commit``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._pending: list[DataFrame] = []
        self.refresh()

    def _exists(self, at: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, ddl: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(ddl).parquet(at) if self._exists(at) else self.spark.createDataFrame([], ddl)

    def refresh(self) -> None:
        """Sees what others committed."""
        self.base = self._read("base", f"{ROWS}, cell int")
        self.changes = self._read("changes", f"{ROWS}, gone boolean, number long")
        self.cells = [(r["cell"], np.array(r["centroid"]), r["radius"]) for r in self._read("cells", "cell int, centroid array<double>, radius double").collect()]

    def upsert(self, rows: DataFrame) -> None:
        """Adds or replaces rows by id; a null person is unassigned."""
        self._pending.append(rows.select("id", F.col("person_id").cast("long").alias("person_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(False).alias("gone")))

    def delete(self, ids: DataFrame) -> None:
        self._pending.append(ids.select("id", F.lit(None).cast("long").alias("person_id"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(True).alias("gone")))

    def commit(self) -> None:
        """Writes the changes as one segment, in order; a later change of an id holds."""
        if not self._pending:
            return
        last = self.changes.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        own = None
        for k, rows in enumerate(self._pending):
            rows = rows.withColumn("number", F.lit(last + 1 + k).cast("long"))
            own = rows if own is None else own.unionByName(rows)
        own.write.mode("append").parquet(f"{self.path}/changes")
        self._pending.clear()
        self.refresh()

    def _newest(self) -> DataFrame:
        """The newest change of each id."""
        return self.changes.groupBy("id").agg(F.max_by(F.struct("person_id", "embedding", "gone"), "number").alias("r")).select("id", "r.*")

    def rows(self) -> DataFrame:
        """The rows as of the last commit."""
        newest = self._newest()
        return self._standing(self.base).select("id", "person_id", "embedding").unionByName(newest.where("not gone").drop("gone"))

    def _standing(self, base: DataFrame) -> DataFrame:
        """Rows of the base that no change has replaced; the ids of few changes are brought to them."""
        ids = self.changes.select("id").distinct()
        return base.join(F.broadcast(ids) if self.changes.count() <= MOST_BROADCAST else ids, "id", "left_anti")

    def compact(self, cells: int | None = None) -> None:
        """Merges all segments into a base in cells, fitted on about SAMPLE rows; every row is indexed."""
        rows = self.rows().where("embedding is not null")
        n = rows.count()
        cells = min(MOST_CELLS, cells or max(1, int(n**0.5)))
        share = max(1, int(1_000_000 * min(1.0, SAMPLE / max(1, n))))
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)
        own = spherical_kmeans(sample, min(cells, max(1, sample.count())), 5) if n else None
        aside = f"{self.path}/.{uuid.uuid4().hex}"
        if own is None:
            rows.withColumn("cell", F.lit(0)).write.parquet(aside)
        else:
            from .albums import centroids

            at = centroids(sample.join(own, "id"), "cluster", "embedding").withColumnRenamed("cluster", "cell")
            placed = best_prototype(rows, at, "id", "embedding", "cell", "centroid").select("id", F.col("cell").cast("int").alias("cell"))
            rows.join(placed, "id").repartition("cell").write.partitionBy("cell").parquet(aside)
        base = self.spark.read.schema(f"{ROWS}, cell int").parquet(aside)
        if own is not None:
            angle = base.join(F.broadcast(at), "cell").select("cell", "centroid", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot("embedding", "centroid")))).alias("a"))
            replace_table(angle.groupBy("cell").agg(F.first("centroid").alias("centroid"), F.max("a").alias("radius")), f"{self.path}/cells")
        jvm, fs = self.spark._jvm, None
        to = jvm.org.apache.hadoop.fs.Path(f"{self.path}/base")
        fs = to.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(to, True)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(aside), to):
            raise OSError(f"can't rename {aside}")
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/changes"), True)
        self.refresh()

    def search(self, query: list[float], k: int, person: int | None = None, overfetch: int | None = None) -> DataFrame:
        """The k rows nearest to a unit vector, of a person if one is given: id, sim and rank.

        ``overfetch`` instead takes the k * overfetch nearest of all and then those of the person, which may leave fewer.
        """
        if overfetch is not None and person is not None:
            top = self.search(query, k * overfetch).drop("rank").join(self.rows().where(F.col("person_id") == person).select("id"), "id", "left_semi")
            top = top.orderBy(F.desc("sim"), "id").limit(k)
            return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), "id")))
        own = lambda df: df if person is None else df.where(F.col("person_id") == person)
        q = np.array(query, np.float64)
        bounds = {c: float(np.cos(max(0.0, np.arccos(np.clip(q @ at, -1, 1)) - r))) for c, at, r in self.cells}
        order = sorted(bounds, key=bounds.get, reverse=True)
        fresh = own(self._newest().where("not gone").drop("gone")).select("id", "embedding")
        inside = lambda cells: own(self._standing(self.base.where(F.col("cell").isin(cells)))).select("id", "embedding")
        if not order:
            return nearest(own(self.rows()), "id", "embedding", query, k)
        first = nearest(inside(order[:PROBED]).unionByName(fresh), "id", "embedding", query, k).collect()
        least = first[-1]["sim"] if len(first) == k else -2.0
        read = [c for i, c in enumerate(order) if i < PROBED or bounds[c] >= least - 1e-6]
        return nearest(inside(read).unionByName(fresh), "id", "embedding", query, k)

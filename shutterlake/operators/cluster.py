"""Clustering of vectors into persons and albums.

The greedy passes depend on the order of the faces (by id here): each face is compared with centroids that earlier faces have
moved. They therefore run as one stream of rows through one task, which holds the centroids only, never the faces. What doesn't
depend on order (reassignment, centroids, k-means) is distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .albums import most_central
from .joins import majority_owner

THRESHOLD, MIN_FACES, REASSIGNMENTS = 0.4, 2, 5


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v if n < 1e-10 else v / n


class Greedy:
    """Centroids that grow: a vector joins the most similar centroid above the threshold (the first of equals), or starts one."""

    def __init__(self, seeds: list[tuple[int, list[float], int]], threshold: float):
        self.ids = [s[0] for s in seeds if s[2] > 0]
        self.sizes = [s[2] for s in seeds if s[2] > 0]
        self.at = np.array([s[1] for s in seeds if s[2] > 0], np.float64)
        self.next = max([s[0] for s in seeds], default=0) + 1
        self.threshold = threshold

    def place(self, v: np.ndarray) -> tuple[int, bool]:
        n = len(self.ids)
        if n:
            sims = self.at[:n] @ v
            best = int(sims.argmax())
            if sims[best] > self.threshold:
                size = self.sizes[best]
                self.at[best] = unit((self.at[best] * size + v) / (size + 1))
                self.sizes[best] = size + 1
                return self.ids[best], False
        if n == len(self.at):
            self.at = np.concatenate([self.at.reshape(-1, len(v)), np.zeros((max(16, n), len(v)))])
        self.at[n] = v
        self.ids.append(self.next)
        self.sizes.append(1)
        self.next += 1
        return self.ids[-1], True


def greedy(faces: DataFrame, clusters: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """id, cluster_id and seeded for every face (id, embedding) with a vector, in the order of ids. clusters: (id, centroid, member_count)."""
    seeds = [] if clusters is None else [(r[0], r[1], r[2]) for r in clusters.select("id", "centroid", "member_count").orderBy("id").collect()]
    handle = faces.sparkSession.sparkContext.broadcast(seeds)

    def run(batches):
        state = Greedy(handle.value, threshold)
        for part in batches:
            if not len(part):
                continue
            got = [state.place(np.asarray(v, np.float64)) for v in part["embedding"]]
            yield pd.DataFrame({"id": part["id"], "cluster_id": [g[0] for g in got], "seeded": [g[1] for g in got]})

    own = faces.where("embedding is not null").select("id", "embedding")
    return own.repartition(1).sortWithinPartitions("id").mapInPandas(run, "id long, cluster_id long, seeded boolean")


def incremental(faces: DataFrame, clusters: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Assignment of unclustered faces; an unmatched face starts a person and a cluster of its own at once."""
    return greedy(faces, clusters, threshold)


def _assign(vectors: DataFrame, centroids: np.ndarray, ids: list[int], threshold: float | None, current: str | None) -> DataFrame:
    """The most similar centroid of each vector (the first of equals); below the threshold the current one stays."""
    handle = vectors.sparkSession.sparkContext.broadcast((centroids, np.array(ids, np.int64)))

    def run(batches):
        at, names = handle.value
        for part in batches:
            if not len(part):
                continue
            sims = np.stack(part["embedding"].to_numpy()).astype(np.float64) @ at.T
            best = sims.argmax(axis=1)
            new = names[best]
            if threshold is not None:
                new = np.where(sims[np.arange(len(new)), best] > threshold, new, part[current].to_numpy())
            yield pd.DataFrame({"id": part["id"], "new": new, "embedding": part["embedding"], "was": part[current] if current else new})

    columns = ["id", "embedding", *([current] if current else [])]
    return vectors.select(*columns).mapInPandas(run, "id long, new long, embedding array<double>, was long")


def _means(assigned: DataFrame, column: str) -> dict[int, np.ndarray]:
    """Sum vectors normalised, by cluster: summed where the rows are, so that only clusters come to the driver."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for part in batches:
            for c, own in part.groupby(column):
                sums[c] = sums.get(c, 0) + np.stack(own["embedding"].to_numpy()).astype(np.float64).sum(axis=0)
        if sums:
            yield pd.DataFrame({"c": list(sums), "v": [v.tolist() for v in sums.values()]})

    out: dict[int, np.ndarray] = {}
    for r in assigned.select(column, "embedding").mapInPandas(run, "c long, v array<double>").orderBy("c", "v").toLocalIterator():
        out[r["c"]] = out.get(r["c"], 0) + np.array(r["v"])
    return {c: unit(v) for c, v in out.items()}


def recluster(faces: DataFrame, threshold: float = THRESHOLD, least: int = MIN_FACES, rounds: int = REASSIGNMENTS) -> DataFrame:
    """Full reclustering of faces (id, embedding, locked, cluster_id, person_id): id, cluster_id (null: unclustered) and person_id.

    Locked faces keep their cluster and seed its centroid. Others are placed greedily, then reassigned up to ``rounds`` times; a
    face that is below the threshold everywhere keeps its place. New clusters of fewer than ``least`` faces dissolve. A new
    cluster goes to the person who had most of its faces before, if any. Old clusters without locked faces end. Excluded faces
    are for the caller to leave out.
    """
    own = faces.where("embedding is not null")
    locked = own.where("locked and cluster_id is not null")
    seeds = _means(locked.select("id", "embedding", "cluster_id"), "cluster_id")
    counts = {r["cluster_id"]: r["n"] for r in locked.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    spark = faces.sparkSession
    base = max([r[0] for r in faces.agg(F.coalesce(F.max("cluster_id"), F.lit(0))).collect()])
    start = spark.createDataFrame([(c, v.tolist(), counts[c]) for c, v in sorted(seeds.items())] + [(base, [], 0)], "id long, centroid array<double>, member_count int")
    free = own.where("not locked")
    placed = greedy(free, start, threshold).select("id", F.col("cluster_id").alias("at"))
    state = checkpointed(free.select("id", "embedding").join(placed, "id").union(locked.select("id", "embedding", F.col("cluster_id").alias("at"))), "recluster")
    fixed = locked.select("id", F.lit(True).alias("fixed"))
    for _ in range(rounds):
        means = _means(state, "at")
        ids = sorted(means)
        if not ids:
            break
        moved = _assign(state, np.stack([means[c] for c in ids]), ids, threshold, "at").join(fixed, "id", "left")
        state_next = checkpointed(moved.select("id", "embedding", F.when(F.col("fixed"), F.col("was")).otherwise(F.col("new")).alias("at"), "was"), "recluster")
        done = state_next.where("at <> was").limit(1).count() == 0
        state = state_next.drop("was")
        if done:
            break
    # New clusters have ids beyond all old ones.
    size = state.groupBy("at").agg(F.count("*").alias("n")).withColumn("old", F.col("at") <= base)
    kept = state.join(size, "at").where((F.col("n") >= least) | F.col("old")).select("id", F.col("at").alias("cluster_id"))
    before = faces.select("id", F.col("person_id").alias("person_before"))
    owner = majority_owner(kept.join(before, "id"), "cluster_id", "person_before").select("cluster_id", F.col("person_before").alias("person_id"))
    return faces.select("id").join(kept.join(owner, "cluster_id", "left"), "id", "left").select("id", "cluster_id", "person_id")


def covers(assigned: DataFrame, faces: DataFrame) -> DataFrame:
    """person_id and cover_face_id of a reclustering (id, cluster_id, person_id): the most central face of the person's largest cluster.

    Ties go to the lowest cluster and face.
    """
    own = assigned.where("cluster_id is not null").join(faces.select("id", "embedding"), "id")
    size = own.where("person_id is not null").groupBy("person_id", "cluster_id").agg(F.count("*").alias("n"))
    largest = size.groupBy("person_id").agg(F.max_by("cluster_id", F.struct(F.col("n"), -F.col("cluster_id"))).alias("cluster_id"))
    central = most_central(own, "cluster_id", "embedding", "id").select("cluster_id", F.col("id").alias("cover_face_id"))
    return largest.join(central, "cluster_id").select("person_id", "cover_face_id")


def spherical_kmeans(vectors: DataFrame, k: int | None = None, rounds: int = 20) -> DataFrame:
    """id and cluster (from 0) of vectors (id, embedding). The first k rows by id start; k is max(2, sqrt(n / 2)) if not given.

    A row keeps its cluster beside its vector; a round assigns once, in place, and is a written table.
    """
    own = vectors.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = own.count()
    k = k or max(2, int((n / 2.0) ** 0.5))
    first = own.orderBy("id").limit(k).collect()
    if not first:
        return own.select("id", F.lit(0).alias("cluster")).limit(0)
    at = np.array([r["embedding"] for r in first], np.float64)
    state = own.withColumn("at", F.lit(-1).cast("long"))
    for _ in range(rounds):
        moved = checkpointed(_assign(state, at, list(range(len(at))), None, "at").select("id", "embedding", F.col("new").alias("at"), "was"), "kmeans")
        done = moved.where("at <> was").limit(1).count() == 0
        state = moved.drop("was")
        if done:
            break
        means = _means(state, "at")
        at = np.stack([means.get(c, at[c]) for c in range(len(at))])
    return state.select("id", F.col("at").cast("int").alias("cluster"))

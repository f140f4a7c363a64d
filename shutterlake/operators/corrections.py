"""Corrections that a user makes to persons and faces, as new tables.

Invariants: no cluster is empty; a face that was moved by hand is locked; centroids are those of a cluster's faces, locked ones
included and excluded ones not; a person who lost all clusters is an orphan, unless another person was merged into them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rotated
from ..sources.tables import checkpointed
from .albums import centroids, most_central


def recomputed(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """Clusters with the centroid and size of their faces (with their vectors in ``embedding``); empty ones are gone."""
    own = faces.where("cluster_id is not null and not excluded")
    size = own.groupBy("cluster_id").agg(F.count("*").cast("int").alias("member_count"))
    mean = centroids(own, "cluster_id", "embedding")
    return clusters.drop("member_count", "centroid").join(size.join(mean, "cluster_id", "left"), clusters["id"] == F.col("cluster_id")).drop("cluster_id")


def moves(faces: DataFrame, moving: DataFrame) -> DataFrame:
    """For each cluster that loses faces: whether all of them go (then the cluster itself moves)."""
    own = faces.where("cluster_id is not null").join(moving.select("id", F.lit(True).alias("moving")), "id", "left")
    return own.groupBy("cluster_id").agg(F.count("*").alias("faces"), F.count("moving").alias("moved")).where("moved > 0").withColumn("whole", F.col("faces") == F.col("moved"))


def reassign(faces: DataFrame, clusters: DataFrame, moving: DataFrame, person_id: int, cluster_id: int | None = None, new_cluster_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(faces, clusters) after faces go to a person.

    A cluster that goes as a whole keeps its id and changes its person, unless a destination cluster is chosen. Faces of
    clusters that stay in part join the destination, or a new cluster. Moved faces are locked.
    """
    whole = moves(faces, moving).where("whole").select(F.col("cluster_id").alias("_whole"))
    tagged = faces.join(moving.select("id", F.lit(True).alias("_moving")), "id", "left").join(whole, F.col("cluster_id") == F.col("_whole"), "left")
    goal = F.lit(cluster_id if cluster_id is not None else new_cluster_id).cast("long")
    stays = F.col("_whole").isNotNull() & F.lit(cluster_id is None)
    out = tagged.withColumn("cluster_id", F.when(F.col("_moving") & ~stays, goal).otherwise(F.col("cluster_id")))
    out = out.withColumn("assignment_locked", F.col("assignment_locked") | F.coalesce("_moving", F.lit(False))).select(*faces.columns)
    owned = clusters.join(whole, clusters["id"] == F.col("_whole"), "left").withColumn("person_id", F.when(F.col("_whole").isNotNull(), F.lit(person_id).cast("long")).otherwise(F.col("person_id"))).select(*clusters.columns)
    if cluster_id is None and new_cluster_id is not None:
        made = out.where(F.col("cluster_id") == new_cluster_id).select(F.lit(new_cluster_id).cast("long").alias("id"), F.lit(person_id).cast("long").alias("person_id")).limit(1)
        owned = owned.unionByName(made, allowMissingColumns=True)
    return out, recomputed(owned, out)


def confirm(faces: DataFrame, face_id: int) -> DataFrame:
    return faces.withColumn("assignment_locked", F.col("assignment_locked") | (F.col("id") == face_id))


def exclude(faces: DataFrame, face_id: int, excluded: bool = True) -> DataFrame:
    """Excluding a face also takes it out of its cluster; including it again leaves it unclustered."""
    hit = F.col("id") == face_id
    return faces.withColumn("excluded", F.when(hit, excluded).otherwise(F.col("excluded"))).withColumn("cluster_id", F.when(hit, F.lit(None)).otherwise(F.col("cluster_id")))


def merge_persons(persons: DataFrame, clusters: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """Clusters go to the target unblended; the source points to it. Merging a person into themselves is an error."""
    if source == target:
        raise ValueError("a person can't be merged into themselves")
    moved = clusters.withColumn("person_id", F.when(F.col("person_id") == source, F.lit(target)).otherwise(F.col("person_id")))
    return persons.withColumn("merged_into_id", F.when(F.col("id") == source, F.lit(target)).otherwise(F.col("merged_into_id"))), moved


def remove_faces(faces: DataFrame, clusters: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faces, clusters, orphans) after faces leave their clusters. Orphans are judged after all of them have left."""
    out = faces.join(gone.select("id", F.lit(True).alias("_gone")), "id", "left").withColumn("cluster_id", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("cluster_id"))).select(*faces.columns)
    left = recomputed(clusters, out)
    orphans = clusters.select("person_id").distinct().join(left.select("person_id"), "person_id", "left_anti")
    return out, left, orphans


def orphans(persons: DataFrame, clusters: DataFrame) -> DataFrame:
    """Persons without clusters into whom nobody was merged."""
    out = persons.join(clusters.select(F.col("person_id").alias("id")), "id", "left_anti")
    return out.join(persons.where("merged_into_id is not null").select(F.col("merged_into_id").alias("id")), "id", "left_anti")


def resolve_redirects(persons: DataFrame, key: str = "id", into: str = "merged_into_id") -> DataFrame:
    """id and the person at the end of the chain of merges; a chain that runs in a circle, or to nobody, gives null.

    Pointers jump twice as far in each round, which is a written table and one join; a chain of n persons takes log n rounds.
    """
    step = checkpointed(persons.select(F.col(key).alias("id"), F.coalesce(F.col(into), F.col(key)).alias("at"), F.col(into).isNull().alias("ended")), "redirects")
    far = step.select(F.col("id").alias("at"), F.col("at").alias("far"), F.col("ended").alias("far_ended"))
    for _ in range(max(1, step.where("not ended").count().bit_length())):
        if step.where("not ended").limit(1).count() == 0:
            break
        step = checkpointed(step.join(far, "at", "left").select("id", F.when(F.col("ended"), F.col("at")).otherwise(F.col("far")).alias("at"), (F.col("ended") | F.coalesce("far_ended", F.lit(False))).alias("ended")), "redirects")
        far = step.select(F.col("id").alias("at"), F.col("at").alias("far"), F.col("ended").alias("far_ended"))
    return step.select("id", F.when(F.col("ended"), F.col("at")).alias("current_id"))


def rotate(photos: DataFrame, photo_id: int, by: int) -> DataFrame:
    """Turns a photo and clears what was derived from its pixels, tags included."""
    hit = F.col("id") == photo_id
    flags = [c for c in photos.columns if c.startswith("ai_") and c.endswith("_done")]
    out = photos.withColumn("orientation", F.when(hit, rotated("orientation", by)).otherwise(F.col("orientation")).cast("int"))
    return out.withColumns({c: F.when(hit, False).otherwise(F.col(c)) for c in flags})


def rotate_and_clear(photos: DataFrame, photo_id: int, by: int, **derived: tuple[DataFrame, str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(photos, the tables derived from them without the photo's rows); derived: name to (table, its photo column)."""
    return rotate(photos, photo_id, by), {name: df.where(~F.col(fk).eqNullSafe(F.lit(photo_id))) for name, (df, fk) in derived.items()}


def reassign_to_new(faces: DataFrame, clusters: DataFrame, persons: DataFrame, moving: DataFrame, name: str, person_id: int, cluster_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faces, clusters, persons) after faces go to a person who is made for them.

    Exactly one whole cluster moves intact; any other set of faces becomes the new cluster. The face nearest to the centroid
    is the person's cover.
    """
    gone = moves(faces, moving).agg(F.count("*").alias("n"), F.min("whole").alias("whole"), F.min("cluster_id").alias("c")).first()
    loose = faces.where("cluster_id is null").join(moving.select("id"), "id", "left_semi").limit(1).count()
    intact = gone["n"] == 1 and gone["whole"] and not loose
    if intact:
        out, left = reassign(faces, clusters, moving, person_id)
    else:
        out, left = reassign(faces, clusters, moving, person_id, cluster_id=cluster_id)
        made = out.where(F.col("cluster_id") == cluster_id).limit(1).select(F.lit(cluster_id).cast("long").alias("id"), F.lit(person_id).cast("long").alias("person_id"))
        left = recomputed(clusters.unionByName(made, allowMissingColumns=True), out)
    own = out.where(F.col("cluster_id") == (gone["c"] if intact else cluster_id))
    cover = most_central(own, "cluster_id", "embedding", "id").select(F.lit(person_id).cast("long").alias("id"), F.lit(name).alias("name"), F.col("id").alias("cover_face_id"))
    return out, left, persons.unionByName(cover, allowMissingColumns=True)


def destinations(persons: DataFrame, clusters: DataFrame, suggested: int | None) -> DataFrame:
    """A row for each prototype of every person who isn't merged away, the suggested one flagged; persons without one stay."""
    live = persons.where("merged_into_id is null").select(F.col("id").alias("person_id"), "name")
    own = clusters.select("person_id", F.col("id").alias("cluster_id"), "member_count")
    return live.join(own, "person_id", "left").withColumn("suggested", F.coalesce(F.col("cluster_id") == F.lit(suggested), F.lit(False)))

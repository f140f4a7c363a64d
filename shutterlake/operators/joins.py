"""Joins between photos, tags, faces, clusters and persons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def face_persons(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """face_id and person_id of every face that is in a cluster."""
    return faces.join(clusters, faces["cluster_id"] == clusters["id"]).select(faces["id"].alias("face_id"), clusters["person_id"])


def photo_persons(faces: DataFrame, clusters: DataFrame, persons: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """A row for each face of a person who has a cover face: photo, person, and the cover face's photo.

    Covers are looked up for persons, not for faces; ``covers`` are the faces to look among, if not all.
    """
    cover = (faces if covers is None else covers).select(F.col("id").alias("cover_face_id"), F.col("photo_id").alias("cover_photo_id"))
    known = persons.select(F.col("id").alias("person_id"), "cover_face_id").join(cover, "cover_face_id").select("person_id", "cover_photo_id")
    owned = clusters.select(F.col("id").alias("cluster_id"), "person_id").join(known, "person_id")
    return faces.select(F.col("id").alias("face_id"), "photo_id", "cluster_id").join(owned, "cluster_id").select("face_id", "photo_id", "person_id", "cover_photo_id")


def person_faces(faces: DataFrame, clusters: DataFrame, person_id) -> DataFrame:
    own = clusters.where(F.col("person_id") == person_id).select(F.col("id").alias("cluster_id"))
    return faces.join(own, "cluster_id", "left_semi")


def used_tags(tags: DataFrame, photo_tags: DataFrame, key: str) -> DataFrame:
    return tags.join(photo_tags, key, "left_semi")


def tags_of_photos(photo_tags: DataFrame, tags: DataFrame, photo: str, key: str, name: str) -> DataFrame:
    """An array of tag names, in order, for each photo."""
    return photo_tags.join(tags, key).groupBy(photo).agg(F.sort_array(F.collect_list(name)).alias("tags"))


def having_all(photo_tags: DataFrame, photo: str, tag: str, wanted: list) -> DataFrame:
    """Photos that have every wanted tag; none if no tag is wanted."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return photo_tags.select(photo).limit(0)
    own = photo_tags.where(F.col(tag).isin(wanted)).groupBy(photo).agg(F.countDistinct(tag).alias("_n"))
    return own.where(F.col("_n") == len(wanted)).select(photo)


def other_members(members: DataFrame, group: str) -> DataFrame:
    """Each member with the number of others in its group; a large group's rows are not gathered, its count is brought to them."""
    counts = members.where(F.col(group).isNotNull()).groupBy(group).agg((F.count("*") - 1).alias("others"))
    return members.join(counts, group)


def vectors_of(faces: DataFrame, embeddings: DataFrame, face: str = "face_id") -> DataFrame:
    """Faces with their vectors; faces without one drop out."""
    return faces.join(embeddings.select(F.col(face).alias("id"), "embedding"), "id")


def with_files(photos: DataFrame, thumbnails: DataFrame, files: DataFrame) -> DataFrame:
    """photos (id) with cached: whether a thumbnail is known (photo_id, cache_path) and its file is in the listing (path)."""
    there = thumbnails.where("cache_path is not null").join(files.select(F.col("path").alias("cache_path")).distinct(), "cache_path", "left_semi")
    return photos.join(there.select(F.col("photo_id").alias("id"), F.lit(True).alias("cached")).distinct(), "id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def shown(photos: DataFrame, tags: DataFrame, key: str, tag: str) -> DataFrame:
    """Each photo of a page with its tags as one text, in order, and how many photos the page shows."""
    text = tags.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(tag)), ", ").alias("tags"))
    return photos.join(text, key, "left").crossJoin(F.broadcast(photos.agg(F.count("*").alias("shown"))))


def in_order(ids: DataFrame, rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Rows by ranked ids; ids without a row drop out."""
    return ids.select(key, rank).join(rows, key).orderBy(rank)


def enriched(photos: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
    """A page with optional facts, each from a side that has one row for each key."""
    for side in sides:
        photos = photos.join(side, key, "left")
    return photos


def majority_owner(faces: DataFrame, group: str, owner: str) -> DataFrame:
    """The owner of most faces of each group; ties go to the lowest id."""
    n = faces.where(F.col(owner).isNotNull()).groupBy(group, owner).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.max_by(F.col(owner), F.struct(F.col("n"), -F.col(owner))).alias(owner), F.max("n").alias("n"))

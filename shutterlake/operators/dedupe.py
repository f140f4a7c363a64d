"""Exact duplicates: groups, folder pairs, differences, resolution, and the hash cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dropped
from .numbering import row_numbers


def hash_plan(photos: DataFrame, hashes: DataFrame, key: str, size: str, hashed_size: str) -> DataFrame:
    """Each photo with action REUSE if its hash is of its present size, else REHASH."""
    out = photos.join(hashes, key, "left")
    return out.withColumn("action", F.when(F.col(hashed_size) == F.col(size), "REUSE").otherwise("REHASH"))


def groups(photos: DataFrame, by: list[str], key: str) -> DataFrame:
    """Groups of at least two photos that agree in ``by`` (type and hash): the first id and the count."""
    return photos.dropna(subset=by).groupBy(*by).agg(F.min(key).alias("first_id"), F.count("*").alias("n")).where("n >= 2")


def members(photos: DataFrame, by: list[str], key: str) -> DataFrame:
    """The photos of each group, a row each; a group is never gathered into one row."""
    return photos.join(groups(photos, by, key), by)


def folder_pairs(photos: DataFrame, by: list[str], key: str, folder: str) -> DataFrame:
    """Pairs of folders (in order) and the number of groups that lie in exactly these two."""
    inside = photos.dropna(subset=by).groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(folder).alias("folders"), F.min(folder).alias("folder_a"), F.max(folder).alias("folder_b"))
    return inside.where("n >= 2 and folders = 2").groupBy("folder_a", "folder_b").agg(F.count("*").alias("group_count"), F.sum("n").alias("photos"))


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Folder pairs with their place, those with most groups first, then by folder."""
    return row_numbers(pairs, [F.desc("group_count"), F.col("folder_a"), F.col("folder_b")], "at")


def pair_sizes(photos: DataFrame, by: list[str], folder: str, size: str) -> DataFrame:
    """For each pair of folders: photos and bytes (null: 0) of its groups in either folder."""
    each = photos.dropna(subset=by).groupBy(*by, folder).agg(F.count("*").alias("c"), F.sum(F.coalesce(F.col(size), F.lit(0))).alias("b"))
    pair = each.groupBy(*by).agg(F.count("*").alias("folders"), F.sum("c").alias("n"), F.min(F.struct(folder, "c", "b")).alias("x"), F.max(F.struct(folder, "c", "b")).alias("y"))
    pair = pair.where("folders = 2 and n >= 2").select(F.col(f"x.{folder}").alias("folder_a"), F.col(f"y.{folder}").alias("folder_b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb"), F.col("x.b").alias("ba"), F.col("y.b").alias("bb"))
    return pair.groupBy("folder_a", "folder_b").agg(F.sum("ca").alias("photos_a"), F.sum("cb").alias("photos_b"), F.sum("ba").alias("bytes_a"), F.sum("bb").alias("bytes_b"))


def differing(photos: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """For each group of at least two: whether a field has more than one value, a missing value being one."""
    differs = lambda f: (F.countDistinct(f) + F.max(F.col(f).isNull().cast("int")) > 1).alias(f"{f}_differs")
    return photos.dropna(subset=by).groupBy(*by).agg(F.count("*").alias("n"), *[differs(f) for f in fields]).where("n >= 2")


def has_duplicates(counted: DataFrame, others: str = "others", compat: bool = False) -> DataFrame:
    """Flag of photos that have a duplicate; ``compat`` asks for two others at least."""
    return counted.withColumn("has_duplicates", F.col(others) > (1 if compat else 0))


def resolve(members_: DataFrame, group: str, key: str, strategy: str, checked: str, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members that stay, groups that end): a member goes if its strategy drops it and its file is in ``removed``;
    a group ends when fewer than two members remain."""
    gone = removed.select(key).distinct().withColumn("_removed", F.lit(True))
    out = members_.join(gone, key, "left").where(~(dropped(strategy, F.col(checked)) & F.coalesce("_removed", F.lit(False)))).drop("_removed")
    left = members_.groupBy(group).agg(F.count("*").alias("_all")).join(out.groupBy(group).agg(F.count("*").alias("_left")), group, "left")
    ended = left.where("coalesce(_left, 0) < 2").select(group)
    return out.join(ended, group, "left_anti"), ended


def replace_groups(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """The groups of a new run. A group that was there before keeps its decision; old groups that are gone drop out."""
    return new.drop("accepted").join(old.select(*by, "accepted"), by, "left")

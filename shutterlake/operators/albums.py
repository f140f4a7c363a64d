"""Automatic albums: events, places, persons, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import dot, half_up, l2_normalize
from ..sources.tables import checkpointed
from .numbering import in_parts, offsets


def sessions(photos: DataFrame, by: list[str], date: str, key: str, gap: str = "6 hours") -> DataFrame:
    """Photos with the number of their event in its group; a new one begins when the gap is exceeded (not when it is met).

    Without ``by`` the whole table is one sequence; it is dealt by date, and events are numbered on from part to part.
    """
    if not by:
        return _one_sequence(photos.where(F.col(date).isNotNull()), date, key, gap)
    w = Window.partitionBy(*by).orderBy(date, key)
    new = F.when(F.col(date) - F.lag(date).over(w) > F.expr(f"interval {gap}"), 1).otherwise(0)
    return photos.where(F.col(date).isNotNull()).withColumn("_new", new).withColumn("event", F.sum("_new").over(w)).drop("_new")


def _one_sequence(photos: DataFrame, date: str, key: str, gap: str) -> DataFrame:
    table = in_parts(photos, [F.col(date), F.col(key)], "sessions")
    last, before = [], None
    for r in table.groupBy("_part").agg(F.max(date).alias("last")).orderBy("_part").collect():
        last.append((r["_part"], before))
        before = r["last"]
    kind = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_last", photos.schema[date].dataType)])
    table = table.join(F.broadcast(photos.sparkSession.createDataFrame(last, kind)), "_part")
    w = Window.partitionBy("_part").orderBy(date, key)
    new = F.when(F.col(date) - F.coalesce(F.lag(date).over(w), F.col("_last")) > F.expr(f"interval {gap}"), 1).otherwise(0)
    table = checkpointed(table.withColumn("_new", new).drop("_last"), "sessions")
    return table.join(F.broadcast(offsets(table, F.sum("_new"))), "_part").withColumn("event", F.sum("_new").over(w) + F.col("_before")).drop("_new", "_part", "_before")


def event_albums(photos: DataFrame, by: list[str], date: str, key: str, gap: str = "6 hours", least: int = 5) -> DataFrame:
    """A row for each event of at least so many photos: name (its first date), cover (its first photo), start, end, n."""
    out = sessions(photos, by, date, key, gap).groupBy(*by, "event").agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count("*").alias("n"), F.min_by(key, F.struct(date, key)).alias("cover"))
    return out.where(F.col("n") >= least).withColumn("name", F.date_format("start", "yyyy-MM-dd"))


def event_album_photos(photos: DataFrame, by: list[str], date: str, key: str, gap: str = "6 hours", least: int = 5) -> DataFrame:
    own = sessions(photos, by, date, key, gap)
    w = Window.partitionBy(*by, "event")
    out = own.withColumn("n", F.count("*").over(w)).where(F.col("n") >= least)
    return out.withColumn("sort_order", F.row_number().over(w.orderBy(date, key)) - 1)


def event_albums_windowed(photos: DataFrame, by: list[str], date: str, gap: str = "6 hours", least: int = 5) -> DataFrame:
    """The same events by session windows, which combine before they shuffle and need no sort of a whole group."""
    out = photos.where(F.col(date).isNotNull()).groupBy(*by, F.session_window(F.col(date).cast("timestamp"), gap)).agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("session_window")


def location_albums(photos: DataFrame, lat: str, lon: str, key: str, digits: int = 2, least: int = 3) -> DataFrame:
    """Cells of 0.01 degrees with at least so many photos; halves round towards positive infinity."""
    cell = photos.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(half_up(lat, digits).alias("cell_lat"), half_up(lon, digits).alias("cell_lon"))
    return cell.agg(F.count("*").alias("n"), F.min(key).alias("cover")).where(F.col("n") >= least)


def person_albums(faces: DataFrame, person: str, photo: str) -> DataFrame:
    """The distinct photos of each person, numbered from 0."""
    return faces.select(person, photo).distinct().withColumn("sort_order", F.row_number().over(Window.partitionBy(person).orderBy(photo)) - 1)


def replaced(albums: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """All albums, those of one type replaced by the new ones; an empty new set removes the old ones too."""
    return albums.where(F.col("type") != kind).unionByName(new)


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """The normalised mean vector of each group, by position, so that no group is gathered; rows with a null vector don't count."""
    mean = vectors.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centroid"))
    return whole.withColumn("centroid", l2_normalize("centroid"))


def coherent(vectors: DataFrame, group: str, vector: str, key: str, least_size: int = 10, least_similarity: float = 0.6) -> DataFrame:
    """Groups that are large and alike enough: mean similarity to their centroid, size, first member."""
    near = vectors.where(F.col(vector).isNotNull()).join(centroids(vectors, group, vector), group).withColumn("sim", dot(vector, "centroid"))
    out = near.groupBy(group).agg(F.avg("sim").alias("mean_similarity"), F.count("*").alias("n"), F.min(key).alias("cover"))
    return out.where((F.col("n") >= least_size) & (F.col("mean_similarity") >= least_similarity))


def most_central(vectors: DataFrame, group: str, vector: str, key: str) -> DataFrame:
    """The member of each group that is nearest to its centroid; ties go to the lowest key."""
    near = vectors.where(F.col(vector).isNotNull()).join(centroids(vectors, group, vector), group).withColumn("sim", F.round(dot(vector, "centroid"), 9))
    return near.groupBy(group).agg(F.max_by(F.col(key), F.struct(F.col("sim"), -F.col(key))).alias(key), F.max("sim").alias("sim"))

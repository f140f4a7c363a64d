"""Browsing: pages of photos by folder, date, flag or name, timelines, and paging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point(df: DataFrame, key: str, value) -> DataFrame:
    """The row with a unique key; more than one is an error when it is read."""
    found = df.where(F.col(key) == F.lit(value))
    n = F.count("*").over(Window.partitionBy(key))
    return found.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{key} is not unique"))).otherwise(F.lit(True))).drop("_n")


def folder_page(photos: DataFrame, folder: str, value, order: str) -> DataFrame:
    return photos.where(F.col(folder) == value).orderBy(F.asc_nulls_last(order))


def taken_in(photos: DataFrame, date: str, year: int, month: int, day: int | None = None) -> DataFrame:
    """Photos of a month or day, as a half-open range, which reaches the scan."""
    start = datetime(year, month, day or 1)
    end = F.lit(start) + (F.expr("interval 1 day") if day else F.expr("interval 1 month"))
    return photos.where((F.col(date) >= F.lit(start).cast("timestamp_ntz")) & (F.col(date) < end.cast("timestamp_ntz")))


def undated(photos: DataFrame, date: str) -> DataFrame:
    return photos.where(F.col(date).isNull())


def located(photos: DataFrame, lat: str, lon: str) -> DataFrame:
    return photos.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def pending(df: DataFrame, flag: str, needs: str | None = None) -> DataFrame:
    """Rows whose flag is false (a null flag isn't pending) and whose prerequisite, if any, is true."""
    out = df.where(F.col(flag) == F.lit(False))
    return out.where(F.col(needs)) if needs else out


def worklist(*lists: DataFrame) -> DataFrame:
    """Union of worklists without repeats."""
    out = lists[0]
    for one in lists[1:]:
        out = out.unionByName(one)
    return out.dropDuplicates()


def unresolved(df: DataFrame, flag: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def same_name(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.where(F.lower(name) == F.lower(F.lit(value)))


def suggestions(df: DataFrame, name: str, prefix: str, most: int = 8, live: Column | None = None) -> DataFrame:
    """Names with a prefix in either case, in order, at most so many; wildcards in the prefix work as such."""
    out = df.where(F.col(name).ilike(prefix + "%"))
    return (out.where(live) if live is not None else out).orderBy(F.asc_nulls_last(name)).limit(most)


def unclustered(faces: DataFrame) -> DataFrame:
    """Faces that wait for a cluster: in none, and not excluded."""
    return faces.where(F.col("cluster_id").isNull() & ~F.col("excluded"))


def movable(faces: DataFrame) -> DataFrame:
    return faces.where(~F.col("assignment_locked") & ~F.col("excluded"))


def locked(faces: DataFrame) -> DataFrame:
    return faces.where(F.col("assignment_locked") & ~F.col("excluded"))


def arranged(df: DataFrame, by: str, order: list) -> DataFrame:
    """A list in groups: the group's place (nulls last) and each row's place in it, from 0."""
    place = df.select(by).distinct()
    place = place.withColumn("group_at", F.row_number().over(Window.orderBy(F.asc_nulls_last(by))) - 1)
    out = numbered(df, [by], order, "at")
    return out.join(F.broadcast(place.withColumnRenamed(by, "_by")), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def merge_candidates(persons: DataFrame, person_id: int) -> DataFrame:
    return persons.where((F.col("id") != person_id) & F.col("merged_into_id").isNull())


def timeline(photos: DataFrame, date: str) -> DataFrame:
    """Photos for each year, month and day."""
    parts = [F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day")]
    return photos.where(F.col(date).isNotNull()).groupBy(*parts).agg(F.count("*").alias("n"))


def timeline_rollup(photos: DataFrame, date: str) -> DataFrame:
    """The same with totals of months, years and all; level says how many parts are summed over."""
    dated = photos.where(F.col(date).isNotNull()).select(F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day"))
    return dated.rollup("year", "month", "day").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def by_year(photos: DataFrame, date: str, born: Column | None = None) -> DataFrame:
    """Photos for each year (null: undated); with a year of birth, the age in that year."""
    out = photos.groupBy(F.year(date).alias("year"), *([born.alias("born")] if born is not None else [])).agg(F.count("*").alias("n"))
    return out.withColumn("age", F.col("year") - F.col("born")) if born is not None else out


def numbered(df: DataFrame, by: list[str], order: list, name: str = "sort_order") -> DataFrame:
    """0-based position within a group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def rows_of(df: DataFrame, by: list[str], order: list, columns: int) -> DataFrame:
    """Grid row and column of each photo of a page."""
    out = numbered(df, by, order, "_at")
    return out.withColumn("grid_row", F.floor(F.col("_at") / columns)).withColumn("grid_column", F.col("_at") % columns).drop("_at")


def neighbours(df: DataFrame, by: list[str], order: list, key: str) -> DataFrame:
    """Previous and next key in a slideshow; the ends are their own neighbours."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.coalesce(F.lag(key).over(w), F.col(key))).withColumn("next", F.coalesce(F.lead(key).over(w), F.col(key)))


def before(df: DataFrame, by: list[str], order: list, column: str, name: str = "before") -> DataFrame:
    """The value of the row before, within a group."""
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*by).orderBy(*order)))


def details(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row (key, position, label, value) for each field that isn't null."""
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("label"), F.col(f).cast("string").alias("value")) for i, f in enumerate(fields)])
    return df.select(key, F.explode(pairs).alias("d")).select(key, "d.position", "d.label", "d.value").where("value is not null")


def tree(spark, nodes: DataFrame, key: str, parent: str, name: str, depth: int = 64) -> DataFrame:
    """Every node with its depth and path from its root."""
    view = f"_tree_{id(nodes)}"
    nodes.createOrReplaceTempView(view)
    return spark.sql(
        f"""WITH RECURSIVE t AS (
              SELECT {key}, {parent}, 0 AS depth, CAST({name} AS STRING) AS path FROM {view} WHERE {parent} IS NULL
              UNION ALL
              SELECT c.{key}, c.{parent}, t.depth + 1, concat(t.path, '/', c.{name}) FROM {view} c JOIN t ON c.{parent} = t.{key} WHERE t.depth < {depth})
            SELECT * FROM t"""
    )

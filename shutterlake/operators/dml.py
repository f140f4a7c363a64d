"""Changes to tables as new tables: Parquet has no MERGE, so each is a join and a union, written aside and renamed by the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ellipsis
from ..schemas import schema
from .numbering import row_numbers


def with_ids(new: DataFrame, order: list[str], after: int, id_col: str = "id") -> DataFrame:
    """Ids after the present maximum, by a stated order."""
    return row_numbers(new, [F.col(c) for c in order], id_col, after + 1)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose natural key isn't there yet are added."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def find_or_create(old: DataFrame, keys_wanted: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """The table with an id for every wanted key; old ids stay."""
    last = old.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    new = keys_wanted.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")
    return old.unionByName(with_ids(new, keys, last, id_col), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones with the same key; a key twice in ``new`` is an error when the result is read."""
    twice = new.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("key twice in the new rows"))).otherwise(F.lit(True)))
    return old.join(twice.select(*keys), keys, "left_anti").unionByName(new)


def update(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns take the values of the change set, where it has the key."""
    own = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = df.join(own, key, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def update_where(df: DataFrame, predicate: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(predicate, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def delete_where_in(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key isn't among the keys of a query."""
    return df.join(gone.select(F.col(gone.columns[0]).alias(key)).distinct(), key, "left_anti")


def of_run(groups: DataFrame, members: DataFrame, run: str, current, key: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of the current run only; the members of other runs' groups go first, as their references demand."""
    old = groups.where(~F.col(run).eqNullSafe(F.lit(current))).select(key)
    return delete_keys(groups, old, [key]), delete_where_in(members, group, old)


def insert_members(members: DataFrame, groups: DataFrame, group: str, ids: str, member: str) -> DataFrame:
    """``members`` and a row for each id of each group's list."""
    return members.unionByName(groups.select(group, F.explode(ids).alias(member)), allowMissingColumns=True)


def seeds(spark, rows: list[tuple], ddl: str) -> DataFrame:
    """Inline values as a table; ``insert_new`` adds those that aren't there yet."""
    return spark.createDataFrame(rows, ddl)


def cascade(keys: DataFrame, key: str, **tables: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """Each dependent table without the rows that refer to a deleted key."""
    return {name: df.join(keys.select(F.col(key).alias(fk)), fk, "left_anti") for name, (df, fk) in tables.items()}


def rescan(known: DataFrame, found: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Every found file with its outcome: IMPORTED, UPDATED (size differs) or SKIPPED_UNCHANGED."""
    out = found.join(known.select(path, F.col(size).alias("_known"), F.lit(True).alias("_there")), path, "left")
    kind = F.when(F.col("_there").isNull(), "IMPORTED").when(F.col("_known").eqNullSafe(F.col(size)), "SKIPPED_UNCHANGED").otherwise("UPDATED")
    return out.withColumn("outcome", kind).drop("_known", "_there")


def failed(df: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Error text (at most 1024 characters) and one more retry for the photos in ``errors`` (key, error)."""
    out = df.join(errors.select(key, F.col("error").alias("_error")), key, "left")
    return out.withColumns({"ai_last_error": F.coalesce(ellipsis("_error"), F.col("ai_last_error")), "ai_retry_count": F.col("ai_retry_count") + F.col("_error").isNotNull().cast("short")}).drop("_error")


def preference(prefs: DataFrame, key: str, default: str | None) -> DataFrame:
    """One row with the value of a preference, or the default."""
    return prefs.where(F.col("pref_key") == key).agg(F.coalesce(F.max("pref_value"), F.lit(default)).alias("pref_value"))


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def job_row(spark, job_id: int, status: str, started, ended=None, total: int = 0, processed: int = 0, groups: int | None = None, error: str | None = None) -> DataFrame:
    """A row of the run table; error texts are cut at 2048 characters."""
    return spark.createDataFrame([(job_id, status, started, ended, total, processed, groups, error[:2048] if error else None)], schema("duplicate_job"))


def jobs_ended(jobs: DataFrame, ended: DataFrame) -> DataFrame:
    """The run table after jobs ended (id, status COMPLETED, INTERRUPTED or FAILED, ended_at, error_message, cut at 2048 characters)."""
    changes = ended.withColumn("error_message", F.substring("error_message", 1, 2048))
    return update(jobs, changes, "id", ["status", "ended_at", "error_message"])

"""A durable queue of actions as a table: what is due, and the table after each step of an action's life.

PENDING actions that are due become IN_PROGRESS, then COMPLETED, or FAILED where nothing handles their type, or PENDING again
with one more retry and the error. After a crash, what was IN_PROGRESS is PENDING again. Payloads are JSON.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PENDING, IN_PROGRESS, COMPLETED, FAILED = "PENDING", "IN_PROGRESS", "COMPLETED", "FAILED"


def due(actions: DataFrame, now: datetime) -> DataFrame:
    """Pending actions without a time or whose time has come."""
    return actions.where((F.col("status") == PENDING) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit(now))))


def payload(*columns: str):
    """The JSON payload of an action made of these columns, as bytes."""
    return F.encode(F.to_json(F.struct(*columns)), "utf-8")


def read_payload(column: str, ddl: str):
    return F.from_json(F.decode(F.col(column), "utf-8"), ddl)


def added(actions: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """The queue with new actions (id, type, payload)."""
    made = new.select("id", "type", "payload").withColumns({"status": F.lit(PENDING), "retry_count": F.lit(0), "created_at": F.lit(now)})
    return actions.unionByName(made.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), allowMissingColumns=True)


def started(actions: DataFrame, ids: DataFrame) -> DataFrame:
    return _stepped(actions, ids.select("id").withColumn("_status", F.lit(IN_PROGRESS)))


def ended(actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue after outcomes (id, error, handled): completed without an error, failed if nothing handles the type, else to be tried again."""
    status = F.when(~F.col("handled"), FAILED).when(F.col("error").isNull(), COMPLETED).otherwise(PENDING)
    text = F.when(~F.col("handled"), F.coalesce("error", F.lit("No handler for type"))).otherwise(F.col("error"))
    return _stepped(actions, outcomes.select("id", status.alias("_status"), text.alias("_error"), (F.col("handled") & F.col("error").isNotNull()).cast("int").alias("_more")))


def reset(actions: DataFrame) -> DataFrame:
    """After a crash: what was in progress is pending again."""
    return actions.withColumn("status", F.when(F.col("status") == IN_PROGRESS, PENDING).otherwise(F.col("status")))


def _stepped(actions: DataFrame, steps: DataFrame) -> DataFrame:
    out = actions.join(steps, "id", "left")
    changed = {"status": F.coalesce("_status", "status")}
    if "_error" in steps.columns:
        changed |= {"last_error": F.coalesce("_error", "last_error"), "retry_count": F.col("retry_count") + F.coalesce("_more", F.lit(0))}
    return out.withColumns(changed).select(*actions.columns)


def work(actions: DataFrame, now: datetime, handlers: dict[str, Callable[[dict], None]], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs what is due, in the order of ids, one action at a time; ``save`` keeps the queue after each step and gives it back."""
    actions = save(reset(actions))
    spark = actions.sparkSession
    for r in due(actions, now).select("id", "type", "payload").orderBy("id").toLocalIterator():
        one = spark.createDataFrame([(r["id"],)], "id long")
        handler, error = handlers.get(r["type"]), None
        if handler is not None:
            actions = save(started(actions, one))
            try:
                handler(r.asDict())
            except Exception as e:  # an action's failure is its outcome
                error = str(e)
        outcome = spark.createDataFrame([(r["id"], error, handler is not None)], "id long, error string, handled boolean")
        actions = save(ended(actions, outcome))
    return actions

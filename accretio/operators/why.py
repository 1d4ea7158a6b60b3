"""Why a field has its value: the facts that changed it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def field_events(facts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, name, seq, value): one row for each field a fact carries."""
    pairs = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = facts.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), "seq", F.explode(pairs).alias("p"))
    return rows.select("key", "p.name", "seq", "p.value").where(F.col("value").isNotNull())


def changes(events: DataFrame) -> DataFrame:
    """Events that changed their field, with the value before: status transitions are those of ``status``."""
    before = F.lag("value").over(Window.partitionBy("key", "name").orderBy("seq"))
    return events.withColumn("before", before).where(~F.col("value").eqNullSafe(F.col("before")))


def attribution(events: DataFrame) -> DataFrame:
    """For each field of each entity: its value, the fact that last changed it, and how often it changed."""
    return changes(events).groupBy("key", "name").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("changed_by"), F.count("*").alias("changes"))

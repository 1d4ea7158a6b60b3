"""Ticks looked back on: what a snapshot holds, the newest ticks, a range's snapshot, the order of open windows.

A tick's payload is the snapshot it sealed: for each kind an object with items,
either an object by fold key or a list. Members whose names begin with an
underscore are no kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import rounded, tokens


def _weight(item: Column) -> Column:
    """An item's _n if that is a whole number, else 1."""
    shown = F.get_json_object(item, "$._n")
    return F.when(F.rlike(shown, F.lit("^-?[0-9]{1,18}$")), shown.cast("long")).otherwise(F.lit(1).cast("long"))


def snapshot_items(ticks: DataFrame, by: list[str]) -> DataFrame:
    """(*by, kind, key, item): each tick's items, key null in lists; a kind without items gives one row with no item."""
    kinds = ticks.select(*by, F.explode(tokens(F.col("payload"))).alias("kind", "__held")).where(~F.startswith("kind", F.lit("_")))
    found = kinds.select(*by, "kind", F.get_json_object("__held", "$.items").alias("__items")).where(F.col("__items").isNotNull())
    keyed = F.transform(F.map_entries(tokens(F.col("__items"))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("item")))
    listed = F.transform(F.from_json("__items", "array<string>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("item")))
    entries = F.when(F.startswith("__items", F.lit("{")), keyed).when(F.startswith("__items", F.lit("[")), listed)
    return found.where(entries.isNotNull()).select(*by, "kind", F.inline_outer(entries))


def payload_stats(ticks: DataFrame, by: list[str]) -> DataFrame:
    """(*by, kind, items, facts, compression, refs): how many items a snapshot has of each kind, the
    facts folded into them, facts an item, and items with references."""
    rows = snapshot_items(ticks, by)
    there = F.col("item").isNotNull()
    refs = F.coalesce(~F.get_json_object("item", "$._refs").isin("", "[]", "{}", "0", "false"), F.lit(False))
    counted = rows.groupBy(*by, "kind").agg(
        F.count_if(there).alias("items"),
        F.sum(F.when(there, _weight(F.col("item"))).otherwise(0)).alias("facts"),
        F.count_if(there & refs).alias("refs"),
    )
    return counted.withColumn("compression", F.when(F.col("items") > 0, rounded(F.col("facts") / F.col("items"), 1)))


def newest(ticks: DataFrame, start: int, end: int) -> DataFrame:
    """Ticks ``start`` to ``end`` (exclusive) counted from the newest, with their index; only ``end`` rows are ranked."""
    if not 0 <= start < end:
        raise ValueError(f"no ticks in {start}:{end}")
    first = ticks.orderBy(F.col("ts").desc(), F.col("tick_seq").desc()).limit(end)
    order = Window.orderBy(F.col("ts").desc(), F.col("tick_seq").desc())  # over end rows at most
    return first.withColumn("index", F.row_number().over(order) - 1).where(F.col("index") >= start)


def history(ticks: DataFrame, start: int, end: int) -> DataFrame:
    """The newest ticks, each with its kinds' item counts as a map."""
    shown = newest(ticks, start, end)
    per = payload_stats(shown, ["index"]).groupBy("index").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "items")))).alias("kind_counts"))
    return shown.drop("payload").join(per, "index", "left")


def range_fold(ticks: DataFrame, start: int, end: int) -> DataFrame:
    """(kind, key, item) of the newest tick of a range: what it sealed, not folded anew."""
    return snapshot_items(newest(ticks, start, end).where(F.col("index") == start), ["index"]).where(F.col("item").isNotNull()).drop("index")


def horizon_order(rows: DataFrame) -> DataFrame:
    """Open windows by how near they are to closing, with a rank from 1.

    rows, one for each declared boundary: name, mode (when, or a count's), count
    (facts a window takes), window_facts, never_sealed, pos (place of the
    declaration). Windows by count come first, by the share they have filled;
    then those that a fact closes, by their facts; those never sealed last.
    """
    stratum = F.when(F.col("never_sealed"), 2).when(F.col("mode") == "when", 1).otherwise(0)
    ratio = F.when(F.col("count") > 0, F.col("window_facts") / F.col("count")).otherwise(0.0)
    metric = F.when(stratum == 2, 0.0).when(stratum == 1, F.col("window_facts").cast("double")).otherwise(ratio)
    order = Window.orderBy("stratum", F.col("metric").desc(), "pos", "name")  # declared boundaries only
    return rows.withColumn("stratum", stratum).withColumn("metric", metric).withColumn("rank", F.row_number().over(order))

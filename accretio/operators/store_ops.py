"""Maintenance of logs: merge, slice, compact, rebirth, export, comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import in_kind
from ..schemas import FACT_COLUMNS, with_receipt


def merge(target: DataFrame, source: DataFrame) -> DataFrame:
    """The target, and after it the source's facts with ids it lacks, in (ts, id) order.

    On an id both have, the target's row stays. Merging twice changes nothing.
    """
    last = target.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
    new = source.join(target.select("id"), "id", "left_anti").drop("seq")
    return target.unionByName(with_receipt(new, ["ts", "id"], last).select(*target.columns))


def slice_where(since: float | None = None, before: float | None = None, kinds: list[str] = (), observers: list[str] = (), origins: list[str] = ()) -> Column:
    """From ``since`` on, strictly before ``before``, in any of the kinds and those below, of these observers and origins."""
    test = F.lit(True)
    if since is not None:
        test = test & (F.col("ts") >= since)
    if before is not None:
        test = test & (F.col("ts") < before)
    if kinds:
        some = F.lit(False)
        for k in kinds:
            some = some | in_kind(F.col("kind"), k)
        test = test & some
    if observers:
        test = test & F.col("observer").isin(*observers)
    if origins:
        test = test & F.col("origin").isin(*origins)
    return test


def slice_store(facts: DataFrame, **clauses) -> DataFrame:
    return facts.where(slice_where(**clauses))


def slice_ticks(ticks: DataFrame, since: float | None = None, before: float | None = None) -> DataFrame:
    """Ticks by time alone; their chain is dropped, as what it covers may be gone."""
    rows = ticks.where(slice_where(since, before))
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("prev_hash", "window_hash", "signature") if c in ticks.columns})


def compact(facts: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrite as few files, each sorted by kind and receipt, so that scans skip by their ranges."""
    files = max(1, -(-facts.count() // rows_per_file))
    facts.repartitionByRange(files, "kind", "seq").sortWithinPartitions("kind", "seq").write.mode("errorifexists").parquet(path)


def receive(target: DataFrame | None, source: DataFrame) -> DataFrame:
    """The source itself where there is no target, else the merge."""
    return source if target is None else merge(target, source)


def rebirth(facts: DataFrame, ticks: DataFrame | None = None, transform: Callable[[DataFrame], DataFrame] | None = None, vertex: str = "vertex") -> DataFrame:
    """A log anew: facts in receipt order through a transform, old ticks as tick.<name> facts
    after them, and a receipt fact at the end that counts both."""
    rows = (transform(facts) if transform else facts).select(*FACT_COLUMNS)
    born = with_receipt(rows.withColumnRenamed("seq", "old"), ["old"]).select(*FACT_COLUMNS)
    n = born.count()
    if ticks is not None:
        again = ticks.select(
            F.col("id"), F.concat(F.lit("tick."), F.col("name")).alias("kind"), "ts", F.lit(vertex).alias("observer"), "origin", "payload", F.col("tick_seq").alias("old")
        )
        born = born.unionByName(with_receipt(again, ["old"], n).select(*FACT_COLUMNS))
    total = born.agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    receipt = total.select(
        (F.col("n") + 1).alias("seq"), F.concat(F.lit("rebirth-"), F.col("n").cast("string")).alias("id"), F.lit("_rebirth").alias("kind"), "ts",
        F.lit(vertex).alias("observer"), F.lit("").alias("origin"), F.to_json(F.struct(F.col("n").alias("facts"))).alias("payload"),
    )
    return born.unionByName(receipt)


def difference(one: DataFrame, two: DataFrame, on: str = "id") -> DataFrame:
    """Rows that differ between two logs: (id, side) with side left, right or changed."""
    columns = [c for c in one.columns if c in two.columns and c != on]
    a = one.select(on, F.struct(*columns).alias("a"))
    b = two.select(on, F.struct(*columns).alias("b"))
    both = a.join(b, on, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(on, F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("changed").alias("side"))


def interleaved(facts: DataFrame, ticks: DataFrame) -> DataFrame:
    """Facts and ticks in one receipt order: (pos, type, id).

    A tick follows the fact its cursor names; without a cursor, or one that names
    nothing, it follows where the tick before it went; an empty cursor is the start.
    """
    places = facts.select(F.col("id").alias("fact_cursor"), F.col("seq").alias("place"))
    found = ticks.join(places, "fact_cursor", "left").withColumn("place", F.when(F.col("fact_cursor") == "", F.lit(0).cast("long")).otherwise(F.col("place")))
    order = Window.partitionBy("origin").orderBy("tick_seq").rowsBetween(Window.unboundedPreceding, 0)
    anchored = found.withColumn("place", F.coalesce(F.last("place", ignorenulls=True).over(order), F.lit(0).cast("long")))
    both = facts.select(F.lit("fact").alias("type"), "id", F.col("seq").alias("place"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("turn")).unionByName(
        anchored.select(F.lit("tick").alias("type"), "id", "place", F.lit(1).alias("rank"), F.col("tick_seq").alias("turn"))
    )
    return with_receipt(both, ["place", "rank", "turn"]).select(F.col("seq").alias("pos"), "type", "id")


def appended(log: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """New facts with the receipts after the log's last, in a given order; ids that the log has are left out.

    The rows to write: the log itself isn't read again but for ids and its head.
    """
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
    return with_receipt(rows.join(log.select("id"), "id", "left_anti"), order, last)


def push(facts: DataFrame, path: str, **clauses) -> None:
    """A slice written where another store can fetch it."""
    slice_store(facts, **clauses).write.mode("errorifexists").parquet(path)


def pull(target: DataFrame | None, path: str) -> DataFrame:
    """What another store pushed, received into this one."""
    spark = target.sparkSession if target is not None else None
    from pyspark.sql import SparkSession

    return receive(target, (spark or SparkSession.active()).read.parquet(path))


def rebirth_problems(source: DataFrame, target: DataFrame, ticks: DataFrame | None = None, transform: Callable[[DataFrame], DataFrame] | None = None, vertex: str = "vertex") -> DataFrame:
    """(seq, side): where a log isn't what the source gives through the transform, its receipt included.

    The rebirth is made again and held against the target, place by place; no
    rows mean that it is one.
    """
    return difference(rebirth(source, ticks, transform, vertex), target.select(*FACT_COLUMNS), "seq")

"""Schemas of the log, and views of other tables as a log of facts.

A fact is a row (seq, id, kind, ts, observer, origin, payload). ``seq`` is the
receipt order, the only order folds use; ``ts`` is event time in seconds. A
payload is JSON text. A table may carry payload fields as typed columns beside
it: operators take a field from a column of its name, if there is one, and from
the JSON otherwise.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACTS = "seq long, id string, kind string, ts double, observer string, origin string, payload string, signature string"
TICKS = (
    "tick_seq long, id string, name string, ts double, since double, origin string, payload string, "
    "prev_hash string, window_start string, fact_cursor string, window_hash string, signature string"
)
FACT_COLUMNS = ["seq", "id", "kind", "ts", "observer", "origin", "payload"]
RESERVED = "_decl."
#: Columns of the fact itself; a payload member of such a name is read from the JSON.
ENVELOPE = {"seq", "id", "kind", "ts", "observer", "origin", "payload", "signature"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str | Column) -> Column:
    """Epoch seconds, to the microsecond, of a timestamp with or without a zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def facts_of_events(events: DataFrame) -> DataFrame:
    """``events`` as facts, with value, cents and k (the key in props) as typed columns."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("id"),
        F.col("event_type").alias("kind"),
        seconds("ts").alias("ts"),
        F.col("user_id").cast("string").alias("observer"),
        F.lit("").alias("origin"),
        F.col("props").alias("payload"),
        F.col("value"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def in_ranges(rows: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` with the number of the range of ``key`` they are in; nulls come first.

    As many ranges as there are shuffle partitions, of about equal rows. Where
    ranges end is settled once, from approximate quantiles, so that every use of
    the result deals rows alike; equal keys share a range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = rows.select(F.col(key).cast("double").alias("__key")).where(F.col("__key").isNotNull())
    ends = numbers.approxQuantile("__key", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    splits = [-float("inf"), *sorted(set(ends)), float("inf")]
    if len(splits) < 3:
        return rows.withColumn(out, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    numbered = rows.withColumn("__key", F.coalesce(F.col(key).cast("double"), F.lit(-float("inf"))))
    placed = Bucketizer(splits=splits, inputCol="__key", outputCol="__range").transform(numbered)
    return placed.withColumn(out, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.col("__range").cast("int"))).drop("__key", "__range")


def with_receipt(rows: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """Rows with a dense ``seq`` from ``after`` + 1 on, in the given order; its first column is a number.

    Ranges of the order are numbered each in its own task; only one row per range
    is needed to know where each begins, so nothing is sorted in one place.
    """
    ranged = in_ranges(rows, order[0], "__part")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = ranged.withColumn("__rank", rank).join(F.broadcast(before), "__part")  # one row a range
    return numbered.withColumn("seq", (F.col("__before") + F.col("__rank") + after).cast("long")).drop("__part", "__rank", "__before")


def field(facts: DataFrame, name: str) -> Column:
    """A payload field as text: the column of that name, else the JSON's value (null if absent)."""
    return F.col(name) if typed(facts, name) else F.get_json_object("payload", f"$['{name}']")


def typed(facts: DataFrame, name: str) -> bool:
    """Whether a payload field has a typed column of its own."""
    return name in facts.columns and name not in ENVELOPE


def visible(facts: DataFrame) -> DataFrame:
    """Without the reserved kinds in which declarations are kept."""
    return facts.where(~F.startswith("kind", F.lit(RESERVED)))

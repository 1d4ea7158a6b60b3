"""Streams run to their end over events, against the same SQL as their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import Avg, Count, Spec, Sum
from ..schemas import facts_of_events
from ..sources.scratch import shared_dir
from ..streaming import live
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """events as an endless table of files; a single file is picked out by its name."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    return facts_of_events(rows)


def _run(rows: DataFrame, mode: str) -> DataFrame:
    """To the end of what there is, into a table in the shared folder."""
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/accretio-stream-{uuid.uuid4().hex}"
    query = rows.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/checkpoint")
    if mode == "append":
        query = query.format("parquet").option("path", f"{at}/out")
    else:
        query = query.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out"))
    query.start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


@R.query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq) AS r, count(*) OVER (PARTITION BY kind) AS c FROM {FACTS} f)
SELECT kind, CAST(floor((r - 1) / 50) AS BIGINT) AS tick, min(seq) AS since_seq, max(seq) AS at_seq, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS DOUBLE) AS amount FROM n
WHERE (floor((r - 1) / 50) + 1) * 50 <= c GROUP BY ALL""")
def stream_ticks(spark: SparkSession, d: str) -> DataFrame:
    """A tick each 50 facts of a kind, state carried from batch to batch."""
    return _run(live.counted_ticks(_stream(spark, d), 50, "cents"), "append")


@R.query("SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS total FROM {FACTS} f GROUP BY kind")
def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    return _run(live.running_fold(_stream(spark, d), Spec("k", (Count("n"), Sum("total", "cents")))), "complete").select("kind", "n", "total")


@R.query("SELECT kind, 'added' AS change, CAST(count(*) AS BIGINT) AS n_after, round(avg(cents), 6) AS mean_after FROM {FACTS} f GROUP BY kind")
def stream_follow(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a followed fold; with one batch of events, each kind is added once."""
    at = f"{shared_dir(spark)}/accretio-follow-{uuid.uuid4().hex}"
    versions: list[str] = []

    def write(state: DataFrame, changes: DataFrame) -> None:
        n = len(versions)
        state.write.parquet(f"{at}/state-{n}")
        changes.write.parquet(f"{at}/changes-{n}")
        versions.append(f"{at}/state-{n}")

    spec = Spec("k", (Count("n"), Avg("mean", "cents")))
    query = live.follow(_stream(spark, d), spec, lambda: spark.read.parquet(versions[-1]) if versions else None, write, ["n", "mean"])
    query.trigger(availableNow=True).option("checkpointLocation", f"{at}/checkpoint").start().awaitTermination()
    both = spark.read.parquet(*[v.replace("/state-", "/changes-") for v in versions])
    return both.select("kind", "change", "n_after", F.round("mean_after", 6).alias("mean_after"))

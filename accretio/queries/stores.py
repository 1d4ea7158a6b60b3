"""Stores and line logs written and read again, streaming folds over groups, and whole-log reads of a declaration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boundaries, folds, reads, store_ops
from ..sources import records
from ..sources.scratch import shared_dir, written
from .base import Registry, facts
from .flows import DECLARATION

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/accretio-{name}-{uuid.uuid4().hex}"


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "id", "kind", "ts", "observer", "origin", "payload")


@R.query("SELECT seq, kind, props AS payload, ts FROM {FACTS} f JOIN (SELECT event_id, props FROM events) e ON e.event_id = f.seq WHERE seq > (SELECT max(event_id) // 2 FROM events)")
def facts_raw_suffix(spark: SparkSession, d: str) -> DataFrame:
    """What a replay needs of the later half of the log."""
    rows = facts(spark, d)
    half = rows.agg(F.floor(F.max("seq") / 2).alias("m")).first()["m"]
    return reads.since_raw(rows, half)


@R.query("SELECT kind, CAST(count(*) AS BIGINT) AS n, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(length(id)) AS BIGINT) AS id_chars FROM {FACTS} f GROUP BY kind")
def compacted(spark: SparkSession, d: str) -> DataFrame:
    """The log rewritten by kind and receipt, and read again."""
    path = _new(spark, "compact")
    store_ops.compact(facts(spark, d), path)
    rows = spark.read.parquet(path)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum(F.length("id")).alias("id_chars"))


@R.query("SELECT id, kind, ts, observer FROM {FACTS} f WHERE seq % 2 = 0 OR kind IN ('click', 'view')")
def pushed_and_pulled(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of one store pushed, and pulled into another that has half of all facts."""
    rows, path = _plain(facts(spark, d)), _new(spark, "push")
    store_ops.push(rows, path, kinds=["click", "view"])
    return store_ops.pull(rows.where("seq % 2 = 0"), path).select("id", "kind", "ts", "observer")


@R.query("SELECT id, kind, ts FROM {FACTS} f")
def received(spark: SparkSession, d: str) -> DataFrame:
    """A store received where there was none, and once more, which changes nothing."""
    rows = _plain(facts(spark, d))
    return store_ops.receive(store_ops.receive(None, rows), rows).select("id", "kind", "ts")


@R.query("""SELECT row_number() OVER (ORDER BY seq) AS seq, id, kind, ts, observer, CASE WHEN seq % 3 = 0 THEN 'sig' END AS signature,
  CASE WHEN seq % 5 <> 0 THEN 'o' END AS origin FROM {FACTS} f""")
def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Facts, some signed and some without an origin, written as lines and read strictly."""
    rows = facts(spark, d).withColumn("signature", F.when(F.col("seq") % 3 == 0, "sig")).withColumn("origin", F.when(F.col("seq") % 5 != 0, "o"))
    path = _new(spark, "log")
    ordered = rows.repartitionByRange("seq").sortWithinPartitions("seq")
    records.fact_lines(ordered).write.text(path)
    again = records.facts(records.checked(records.read_log(spark, path)))
    return again.select("seq", "id", "kind", "ts", "observer", "signature", "origin")


@R.query("SELECT row_number() OVER (ORDER BY seq // 50, seq) AS seq, id, kind FROM {FACTS} f")
def batched_log(spark: SparkSession, d: str) -> DataFrame:
    """Facts in batches of fifty, a line each; receipts follow line and place."""
    rows = facts(spark, d).withColumn("batch", F.floor(F.col("seq") / 50))
    lines = records.batch_lines(rows, "batch")
    path = _new(spark, "batches")
    first = F.get_json_object(F.coalesce(F.get_json_object("value", "$.rows[0]"), F.col("value")), "$.id")
    keyed = written(lines.select("value", first.alias("first")), "lines")  # dealing by range reads its input twice
    keyed.repartitionByRange("first").sortWithinPartitions("first").select("value").write.text(path)
    return records.facts(records.checked(records.read_log(spark, path))).select("seq", "id", "kind")


@R.query("""SELECT kind, CAST(nullif(CASE WHEN seq % 4 <> 0 THEN 'o' ELSE '' END, '') AS VARCHAR) AS origin, seq,
  CAST(count(*) OVER (PARTITION BY kind, CASE WHEN seq % 4 <> 0 THEN 'o' END ORDER BY seq) AS BIGINT) AS number FROM {FACTS} f""")
def numbered_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Facts numbered within kind and origin, where no origin is a group too."""
    rows = facts(spark, d).withColumn("origin", F.when(F.col("seq") % 4 != 0, "o"))
    return boundaries.prefix_sum(rows, F.lit(1), "number", ["kind", "origin"]).select("kind", "origin", "seq", "number")


@R.query("SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN k % 2 = 0 THEN k ELSE -k END) AS BIGINT) AS balance FROM {FACTS} f GROUP BY kind")
def fold_custom(spark: SparkSession, d: str) -> DataFrame:
    """A fold of one's own: a count, and a balance to which even keys add and odd ones take."""

    def step(state: dict, payload: dict) -> dict:
        k = payload["k"]
        return {"n": state["n"] + 1, "balance": state["balance"] + (k if k % 2 == 0 else -k)}

    out = folds.custom(facts(spark, d), lambda: {"n": 0, "balance": 0}, step)
    return out.select("kind", *[F.get_json_object("state", f"$.{c}").cast("long").alias(c) for c in ("n", "balance")])


@R.query("""WITH f AS (SELECT * FROM {FACTS} f), c AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq DESC) AS r FROM f)
SELECT 'click' AS kind, 'items' AS target, 'by' AS fold, CAST(k AS VARCHAR) AS key, min(seq) AS pos, CAST(count(*) AS BIGINT) AS n FROM f WHERE kind = 'click' GROUP BY k
UNION ALL SELECT 'error', 'last', 'collect', NULL, seq, 1 FROM c WHERE kind = 'error' AND r <= 15
UNION ALL SELECT 'view', 'recent', 'window', NULL, row_number() OVER (ORDER BY seq), 1 FROM c WHERE kind = 'view' AND r <= 4""")
def vertex_items_log(spark: SparkSession, d: str) -> DataFrame:
    """A declaration's items over the whole log."""
    from ..plans import declarations, read

    items, _, _ = read.fold(facts(spark, d), declarations.vertex(DECLARATION))
    return items.select("kind", "target", "fold", "key", "pos", "n")


@R.query("SELECT kind, CAST(count(*) AS BIGINT) AS count FROM {FACTS} f WHERE kind IN ('signup', 'purchase') GROUP BY kind")
def vertex_unfolded_of_one(spark: SparkSession, d: str) -> DataFrame:
    """A read of one kind: what the declaration doesn't fold is the same."""
    from ..plans import declarations, read

    return read.fold(facts(spark, d), declarations.vertex(DECLARATION), kind="click")[2]

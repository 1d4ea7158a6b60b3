"""Folds, reads, statistics and store operations over events as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, reads, store_ops
from ..operators.folds import Avg, Collect, Count, Latest, Max, Min, Spec, Sum, Tail, TopN, Upsert
from ..schemas import table
from .base import Registry, facts

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


# folds ------------------------------------------------------------------------
@R.query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM {FACTS} f GROUP BY kind")
def fold_count(spark: SparkSession, d: str) -> DataFrame:
    return folds.scalars(facts(spark, d), Spec("k", (Count("n"),)))


@R.query("SELECT kind, arg_max(ts, seq) AS seen, CAST(0 AS BIGINT) AS seen_rejected FROM {FACTS} f GROUP BY kind")
def fold_latest(spark: SparkSession, d: str) -> DataFrame:
    return folds.scalars(facts(spark, d), Spec("k", (Latest("seen"),)))


@R.query("SELECT kind, CAST(sum(cents) AS BIGINT) AS total, CAST(0 AS BIGINT) AS total_rejected FROM {FACTS} f GROUP BY kind")
def fold_sum(spark: SparkSession, d: str) -> DataFrame:
    return folds.scalars(facts(spark, d), Spec("k", (Sum("total", "cents"),)))


@R.query("SELECT kind, least(0, min(cents)) AS least, min(cents) AS least_unseeded, CAST(0 AS BIGINT) AS least_rejected, CAST(0 AS BIGINT) AS least_unseeded_rejected FROM {FACTS} f GROUP BY kind")
def fold_min(spark: SparkSession, d: str) -> DataFrame:
    return folds.scalars(facts(spark, d), Spec("k", (Min("least", "cents"), Min("least_unseeded", "cents", None))))


@R.query("SELECT kind, greatest(0, max(cents)) AS most, CAST(0 AS BIGINT) AS most_rejected FROM {FACTS} f GROUP BY kind")
def fold_max(spark: SparkSession, d: str) -> DataFrame:
    return folds.scalars(facts(spark, d), Spec("k", (Max("most", "cents"),)))


@R.query("SELECT kind, round(avg(cents), 6) AS mean, CAST(sum(cents) AS DOUBLE) AS mean_sum, CAST(count(cents) AS BIGINT) AS mean_count, CAST(0 AS BIGINT) AS mean_rejected FROM {FACTS} f GROUP BY kind")
def fold_avg(spark: SparkSession, d: str) -> DataFrame:
    return folds.scalars(facts(spark, d), Spec("k", (Avg("mean", "cents"),))).withColumn("mean", F.round("mean", 6))


def _off_type(spark: SparkSession, d: str) -> DataFrame:
    """Payloads whose amount is a number, a text, a truth value, null or absent, by k."""
    k = F.col("k") % 5
    amount = F.when(k == 0, F.lit('"x"')).when(k == 1, F.lit("true")).when(k == 2, F.lit("null")).otherwise(F.col("k").cast("string"))
    text = F.when(k == 3, F.lit("{}")).otherwise(F.concat(F.lit('{"amount":'), amount, F.lit("}")))
    return facts(spark, d).withColumn("payload", text)


@R.query("""SELECT kind, CAST(coalesce(sum(k) FILTER (WHERE k % 5 = 4), 0) AS DOUBLE) AS total,
  CAST(count(*) FILTER (WHERE k % 5 IN (0, 1)) AS BIGINT) AS total_rejected FROM {FACTS} f GROUP BY kind""")
def fold_rejects(spark: SparkSession, d: str) -> DataFrame:
    return folds.scalars(_off_type(spark, d), Spec("k", (Sum("total", "amount"),))).withColumn("total", F.col("total").cast("double"))


@R.query("""SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY seq) AS INTEGER) AS pos, seq, cents FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq DESC) AS r FROM {FACTS} f) WHERE r <= 20""")
def fold_collect_last_n(spark: SparkSession, d: str) -> DataFrame:
    return folds.collect(facts(spark, d), Collect("items", 20)).select("kind", "pos", "seq", "cents")


@R.query("""SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY seq) AS INTEGER) AS pos, cents AS last_values FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq DESC) AS r FROM {FACTS} f) WHERE r <= 7""")
def fold_window_last_n(spark: SparkSession, d: str) -> DataFrame:
    return folds.tail(facts(spark, d), Tail("last_values", "cents", 7)).select("kind", "pos", "last_values")


@R.query("""SELECT kind, CAST(k AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n, min(seq) AS first_seq, max(seq) AS last_seq,
  arg_max(cents, seq) AS cents, arg_max(observer, seq) AS who,
  arg_max(cents, seq) FILTER (WHERE cents % 3 = 0) AS some FROM {FACTS} f GROUP BY kind, k""")
def fold_upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).withColumns({"some": F.when(F.col("cents") % 3 == 0, F.col("cents")), "who": F.col("observer")})
    return folds.upsert_fields(rows, Upsert("items", "k"), ["cents", "who", "some"])


def _open_schema(spark: SparkSession, d: str) -> DataFrame:
    """Payloads whose members come and go: b by thirds, c null by fifths, ref by sevenths."""
    seq = F.col("seq")
    parts = [
        F.concat(F.lit('"topic":"t'), (seq % 50).cast("string"), F.lit('"')),
        F.concat(F.lit('"a":'), seq.cast("string")),
        F.when(seq % 3 == 0, F.concat(F.lit('"b":'), F.col("cents").cast("string"))),
        F.when(seq % 5 == 0, F.lit('"c":null')).when(seq % 5 == 1, F.concat(F.lit('"c":'), seq.cast("string"))),
        F.when(seq % 7 == 0, F.concat(F.lit('"ref":"x:'), (seq % 4).cast("string"), F.lit(', y:1"'))),
    ]
    return facts(spark, d).withColumn("payload", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))).drop("k", "value", "cents")


@R.query("""WITH f AS (SELECT seq, kind, 't' || CAST(seq % 50 AS VARCHAR) AS key, cents FROM {FACTS} f)
SELECT kind, key, CAST(count(*) AS BIGINT) AS n, CAST(max(seq) AS VARCHAR) AS a,
  CAST(arg_max(cents, seq) FILTER (WHERE seq % 3 = 0) AS VARCHAR) AS b,
  CASE WHEN max(seq) FILTER (WHERE seq % 5 IN (0, 1)) % 5 = 1 THEN CAST(max(seq) FILTER (WHERE seq % 5 IN (0, 1)) AS VARCHAR) END AS c,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN seq % 7 = 0 THEN ['x:' || CAST(seq % 4 AS VARCHAR), 'y:1'] ELSE [] END)))), ','), '') AS refs
FROM f GROUP BY kind, key""")
def fold_upsert_open_schema(spark: SparkSession, d: str) -> DataFrame:
    rows = folds.upsert(_open_schema(spark, d), Upsert("items", "topic"))
    member = {c: F.element_at("fields", c).alias(c) for c in "abc"}
    return rows.select("kind", "key", "n", *member.values(), F.array_join("refs", ",").alias("refs"))


@R.query("""SELECT CAST(l_orderkey AS VARCHAR) AS key, array_to_string(list_sort(list_distinct(list('supplier:' || CAST(l_suppkey AS VARCHAR)))), ',') AS refs
FROM lineitem GROUP BY l_orderkey""")
def fold_refs_union(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("r"))
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("refs"))


@R.query("""SELECT c_mktsegment AS kind, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS pos,
  CAST(c_custkey AS VARCHAR) AS key, c_acctbal AS balance FROM customer QUALIFY pos <= 10""")
def fold_topn(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("balance"))
    return folds.top_n(rows, TopN("best", "cust", "balance", 10)).select("kind", "pos", "key", "balance")


@R.query("""SELECT c_mktsegment AS kind, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS pos,
  CAST(c_custkey AS VARCHAR) AS key, c_acctbal AS balance FROM customer QUALIFY pos <= 10""")
def fold_topn_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("balance"))
    return folds.top_n_exact(rows, TopN("best", "cust", "balance", 10)).select("kind", "pos", "key", F.col("by_value").alias("balance"))


@R.query("""SELECT l_partkey AS part, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS quantity,
  greatest(0, max(CAST(l_quantity AS BIGINT))) AS largest FROM lineitem GROUP BY l_partkey""")
def fold_composed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("quantity"))
    out = folds.scalars(rows, Spec("inventory", (Count("n"), Sum("quantity", "quantity"), Max("largest", "quantity"))), ["part"])
    return out.select("part", "n", F.col("quantity").cast("double").alias("quantity"), "largest")


@R.query("SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS total, round(avg(cents), 6) AS mean FROM {FACTS} f GROUP BY kind")
def fold_checkpoint_suffix(spark: SparkSession, d: str) -> DataFrame:
    """A checkpoint of the first 400 facts and the suffix after them, merged."""
    spec, rows = Spec("k", (Count("n"), Sum("total", "cents"), Avg("mean", "cents"))), facts(spark, d)
    out = folds.merged(folds.scalars(reads.at(rows, 400), spec), folds.scalars(rows.where("seq > 400"), spec), spec)
    return out.select("kind", "n", "total", F.round("mean", 6).alias("mean"))


# cursors and diffs ------------------------------------------------------------
@R.query("SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS total FROM {FACTS} f WHERE seq <= 500 GROUP BY kind")
def at_prefix_fold(spark: SparkSession, d: str) -> DataFrame:
    return folds.scalars(reads.at(facts(spark, d), 500), Spec("k", (Count("n"), Sum("total", "cents")))).drop("total_rejected")


@R.query("""SELECT kind, CAST(count(*) AS BIGINT) AS n, arg_max(ts, seq) AS seen FROM {FACTS} f
  WHERE ts <= (SELECT epoch(min(ts)) + 86400 FROM events) GROUP BY kind""")
def as_of_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d)
    first = rows.agg(F.min("ts")).first()[0]
    return folds.scalars(reads.as_of(rows, first + 86400), Spec("k", (Count("n"), Latest("seen")))).drop("seen_rejected")


@R.query("""WITH a AS (SELECT k, count(*) AS n FROM {FACTS} f WHERE seq <= 300 GROUP BY k), b AS (SELECT k, count(*) AS n FROM {FACTS} f WHERE seq <= 900 AND seq > 100 GROUP BY k)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CAST(a.n AS BIGINT) AS n_before, CAST(b.n AS BIGINT) AS n_after FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""")
def fold_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d)
    a = reads.at(rows, 300).groupBy("k").agg(F.count("*").alias("n"))
    b = rows.where("seq <= 900 and seq > 100").groupBy("k").agg(F.count("*").alias("n"))
    return reads.fold_diff(a, b, ["k"], ["n"])


# scans and lookups ------------------------------------------------------------
@R.query("SELECT seq, kind, ts FROM {FACTS} f WHERE seq > 700")
def facts_since(spark: SparkSession, d: str) -> DataFrame:
    return reads.since(facts(spark, d), 700).select("seq", "kind", "ts")


@R.query("SELECT seq, kind, ts FROM {FACTS} f WHERE ts BETWEEN (SELECT epoch(min(ts)) + 3600 FROM events) AND (SELECT epoch(min(ts)) + 90000 FROM events)")
def facts_between(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d)
    first = rows.agg(F.min("ts")).first()[0]
    return reads.facts_between(rows, first + 3600, first + 90000).select("seq", "kind", "ts")


@R.query("SELECT seq, id, kind FROM {FACTS} f WHERE kind = 'click' AND seq <= 800")
def facts_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return reads.by_kind(facts(spark, d), "click", 800).select("seq", "id", "kind")


@R.query("SELECT id, kind, seq, CAST(row_number() OVER (ORDER BY seq DESC) AS INTEGER) AS place, true AS truncated FROM {FACTS} f ORDER BY seq DESC LIMIT 50")
def facts_page_newest(spark: SparkSession, d: str) -> DataFrame:
    return reads.page(facts(spark, d), 50).select("id", "kind", "seq", "place", "truncated")


@R.query("SELECT id, kind, seq, CAST(row_number() OVER (ORDER BY seq) AS INTEGER) AS place, true AS truncated FROM {FACTS} f WHERE seq > 100 AND kind = 'view' ORDER BY seq LIMIT 25")
def facts_page_after(spark: SparkSession, d: str) -> DataFrame:
    return reads.page(facts(spark, d), 25, after=100, newest=False, kind="view").select("id", "kind", "seq", "place", "truncated")


@R.query("SELECT seq, ts FROM {FACTS} f WHERE kind = 'error' ORDER BY ts DESC, seq DESC LIMIT 30")
def recent_facts(spark: SparkSession, d: str) -> DataFrame:
    return reads.recent(facts(spark, d), "error", 30).select("seq", "ts")


@R.query("SELECT kind, arg_max(id, ts) AS id, max(ts) AS ts, arg_max(seq, ts) AS seq FROM {FACTS} f GROUP BY kind")
def latest_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return reads.latest_by_kind(facts(spark, d))


@R.query("SELECT kind, arg_max(id, ts) AS id, max(ts) AS ts, arg_max(seq, ts) AS seq FROM {FACTS} f WHERE k = 7 GROUP BY kind")
def latest_by_kind_where(spark: SparkSession, d: str) -> DataFrame:
    return reads.latest_by_kind(facts(spark, d), F.get_json_object("payload", "$.k") == "7")


@R.query("SELECT kind, bool_or(ts > 1704200000) AS found FROM {FACTS} f GROUP BY kind")
def has_kind_since(spark: SparkSession, d: str) -> DataFrame:
    return reads.has_kind_since(facts(spark, d), 1704200000.0)


@R.query("SELECT kind, CAST(k AS VARCHAR) AS key, arg_max(id, seq) AS id FROM {FACTS} f GROUP BY kind, k")
def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    return reads.resolve_entity(facts(spark, d), "k")


@R.query("SELECT id, seq, id = 'e0000012' AS exact FROM {FACTS} f WHERE starts_with(id, 'e0000012') ORDER BY seq LIMIT 2")
def fact_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return reads.by_id(facts(spark, d), "e0000012").select("id", "seq", "exact")


@R.query("SELECT id, CAST(row_number() OVER (ORDER BY seq) AS BIGINT) AS ordinal FROM {FACTS} f")
def receipt_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return reads.receipt_ordinals(facts(spark, d)).select("id", "ordinal")


# statistics ---------------------------------------------------------------------
@R.query("SELECT kind, CAST(count(*) AS BIGINT) AS count, min(ts) AS earliest, max(ts) AS latest FROM {FACTS} f GROUP BY kind")
def kind_stats(spark: SparkSession, d: str) -> DataFrame:
    return reads.kind_stats(facts(spark, d))


@R.query("SELECT kind, CASE WHEN k % 10 <> 0 THEN CAST(k AS VARCHAR) END AS key, CAST(count(*) AS BIGINT) AS count, max(ts) AS latest FROM {FACTS} f GROUP BY ALL")
def key_stats(spark: SparkSession, d: str) -> DataFrame:
    return reads.key_stats(facts(spark, d).withColumn("k", F.when(F.col("k") % 10 != 0, F.col("k"))), "k")


@R.query("SELECT observer, CAST(count(*) AS BIGINT) AS count, min(ts) AS earliest, max(ts) AS latest FROM {FACTS} f GROUP BY observer")
def observer_stats(spark: SparkSession, d: str) -> DataFrame:
    return reads.observer_stats(facts(spark, d))


@R.query("""SELECT kind, CAST(count(*) AS BIGINT) AS count, CAST(count(DISTINCT k) AS BIGINT) AS keys, min(ts) AS earliest, max(ts) AS latest,
  round_even(100.0 * count(*) / (SELECT count(*) FROM events), 1) AS share FROM {FACTS} f GROUP BY kind""")
def kind_shares(spark: SparkSession, d: str) -> DataFrame:
    return reads.kind_shares(facts(spark, d), "k")


@R.query("""WITH r AS (SELECT epoch(min(ts)) AS a, epoch(max(ts)) AS b FROM events)
SELECT kind, CAST(least(11, floor((ts - a) / (b - a) * 12)) AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS count FROM {FACTS} f, r GROUP BY ALL""")
def density_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d)
    a, b = rows.agg(F.min("ts"), F.max("ts")).first()
    return reads.density(rows, a, b, 12)


def _with_reserved(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).withColumn("kind", F.when(F.col("kind") == "error", F.lit("_decl.kind-defined")).otherwise(F.col("kind")))


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    """A tick each 97 facts, with the fact as its cursor."""
    rows = facts(spark, d).where(F.col("seq") % 97 == 96)
    return rows.select(F.floor(F.col("seq") / 97).alias("tick_seq"), F.concat(F.lit("t"), F.col("seq").cast("string")).alias("id"), F.concat(F.lit("w"), (F.floor(F.col("seq") / 97) % 3).cast("string")).alias("name"), "ts", "origin", F.col("id").alias("fact_cursor"), F.col("seq").alias("at_seq"))


TICKS = "(SELECT CAST(floor(seq / 97) AS BIGINT) AS tick_seq, 't' || CAST(seq AS VARCHAR) AS id, 'w' || CAST(CAST(floor(seq / 97) AS BIGINT) % 3 AS VARCHAR) AS name, ts, id AS fact_cursor, seq AS at_seq FROM {FACTS} f WHERE seq % 97 = 96)"


@R.query("""SELECT CAST(count(*) FILTER (WHERE kind <> 'error') AS BIGINT) AS visible, CAST(count(*) AS BIGINT) AS all_facts, CAST(0 AS BIGINT) AS signed,
  max(ts) FILTER (WHERE kind <> 'error') AS freshness, CAST((SELECT count(*) FROM """ + TICKS + """ t) AS BIGINT) AS ticks FROM {FACTS} f""")
def fact_totals(spark: SparkSession, d: str) -> DataFrame:
    return reads.totals(_with_reserved(spark, d), _ticks(spark, d))


@R.query("""SELECT kind, CAST(count(*) AS BIGINT) AS count, min(ts) AS earliest, max(ts) AS latest, 'fact' AS type FROM {FACTS} f GROUP BY kind
UNION ALL SELECT name, CAST(count(*) AS BIGINT), min(ts), max(ts), 'tick' FROM """ + TICKS + """ t GROUP BY name""")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return reads.summary(facts(spark, d), _ticks(spark, d))


@R.query("SELECT CAST(count(*) AS BIGINT) AS count, min(ts) AS earliest FROM {FACTS} f WHERE seq > (SELECT max(at_seq) FROM " + TICKS + " t)")
def live_edge(spark: SparkSession, d: str) -> DataFrame:
    return reads.live_edge(facts(spark, d), _ticks(spark, d))


@R.query("""WITH b AS (SELECT 'fact' AS type, kind AS name, ts, seq AS pos, 0 AS r FROM {FACTS} f UNION ALL SELECT 'tick', name, ts, tick_seq, 1 FROM """ + TICKS + """ t)
SELECT type, name, ts, pos, CAST((SELECT count(*) FROM b) AS BIGINT) AS total FROM b ORDER BY ts DESC, r DESC, pos DESC LIMIT 200""")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return reads.timeline(facts(spark, d), _ticks(spark, d), 200)


@R.query("""WITH m AS (SELECT seq AS mark, ts + 0.5 AS mts FROM {FACTS} f), t AS (SELECT * FROM """ + TICKS + """ t)
SELECT m.mark, m.mts AS mark_ts, t.tick_seq, t.name, t.ts AS tick_ts FROM m ASOF LEFT JOIN t ON m.mts >= t.ts""")
def tick_asof_floor(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d)
    marks = rows.select(F.col("seq").alias("mark"), (F.col("ts") + 0.5).alias("ts"))
    return reads.tick_floor(rows, _ticks(spark, d), marks)


@R.query("""WITH m AS (SELECT seq AS mark, ts + 0.5 AS mts FROM {FACTS} f), t AS (SELECT * FROM """ + TICKS + """ t)
SELECT m.mark, m.mts AS mark_ts, t.tick_seq, t.name, t.ts AS tick_ts FROM m ASOF LEFT JOIN t ON m.mts >= t.ts""")
def tick_asof_floor_all(spark: SparkSession, d: str) -> DataFrame:
    """As tick_asof_floor, with a mark at every fact."""
    rows = facts(spark, d)
    return reads.tick_floor(rows, _ticks(spark, d), rows.select(F.col("seq").alias("mark"), (F.col("ts") + 0.5).alias("ts")))


SHUFFLED = "(SELECT (seq * 7919) % (SELECT count(*) FROM events) AS seq2, * FROM {FACTS} f)"


def _shuffled(spark: SparkSession, d: str) -> DataFrame:
    """The facts received in another order than they happened."""
    rows = facts(spark, d)
    return rows.withColumn("seq", (F.col("seq") * 7919) % rows.count())


@R.query("SELECT seq2 AS seq, id, ts FROM " + SHUFFLED + " s WHERE seq2 > 200 AND seq2 <= 600 AND ts < (SELECT max(ts) FROM " + SHUFFLED + " s WHERE seq2 <= 200)")
def late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return reads.late_arrivals(_shuffled(spark, d), 200, 600).select("seq", "id", "ts")


@R.query("SELECT kind, arg_max(ts, seq2) AS seen FROM " + SHUFFLED + " s GROUP BY kind")
def fold_latest_received(spark: SparkSession, d: str) -> DataFrame:
    return folds.scalars(_shuffled(spark, d), Spec("k", (Latest("seen"),))).drop("seen_rejected")


@R.query("""WITH i AS (SELECT kind, seq, seq - row_number() OVER (PARTITION BY kind ORDER BY seq) AS island FROM {FACTS} f)
SELECT kind, '' AS origin, min(seq) AS first_seq, max(seq) AS last_seq, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY kind, island""")
def receipt_groups(spark: SparkSession, d: str) -> DataFrame:
    return reads.receipt_groups(facts(spark, d))


@R.query("SELECT kind, CAST(count(*) AS BIGINT) AS count FROM {FACTS} f WHERE kind NOT IN ('click', 'view') GROUP BY kind")
def unfolded_kinds(spark: SparkSession, d: str) -> DataFrame:
    return reads.unfolded_kinds(facts(spark, d), spark.sql("SELECT * FROM VALUES ('click'), ('view') AS t(kind)"))


@R.query("""WITH k AS (SELECT p_brand AS kind, p_type AS key, max(p_partkey) AS seq FROM part GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq DESC) AS r FROM k)
SELECT kind, split_part(key, '/', 1) AS prefix, CAST(count(*) AS BIGINT) AS keys FROM n WHERE r <= 20 GROUP BY ALL""")
def key_prefixes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_type").alias("path"), F.col("p_partkey").alias("seq"))
    return reads.prefixes(rows, "path", 20)


@R.query("""SELECT observer, CAST(count(*) AS BIGINT) AS count, CAST(count(DISTINCT kind) AS BIGINT) AS kinds, CAST(count(DISTINCT (kind, k)) AS BIGINT) AS touched,
  min(ts) AS first_ts, max(ts) AS last_ts FROM {FACTS} f GROUP BY observer""")
def confluence(spark: SparkSession, d: str) -> DataFrame:
    return reads.confluence(facts(spark, d), "k")


@R.query("SELECT CAST(k % 7 AS VARCHAR) AS root, CAST(count(*) AS BIGINT) AS count, CAST(count(DISTINCT observer) AS BIGINT) AS observers FROM {FACTS} f GROUP BY ALL")
def delegation(spark: SparkSession, d: str) -> DataFrame:
    return reads.delegation(facts(spark, d).withColumn("observer", F.concat_ws("/", (F.col("k") % 7).cast("string"), "observer"))).where("root is not null")


ORACLE_SQL["delegation"] = ORACLE_SQL["delegation"].replace("count(DISTINCT observer)", "count(DISTINCT CAST(k % 7 AS VARCHAR) || '/' || observer)")


# stores -------------------------------------------------------------------------
def _store(spark: SparkSession, d: str, odd: bool) -> DataFrame:
    rows = facts(spark, d).select("seq", "id", "kind", "ts", "observer", "origin", "payload", "cents")
    return rows.where(F.col("seq") % 3 != 0) if odd else rows.where(F.col("seq") % 2 == 0)


@R.query("""WITH a AS (SELECT * FROM {FACTS} f WHERE seq % 2 = 0), b AS (SELECT * FROM {FACTS} f WHERE seq % 3 <> 0 AND seq % 2 <> 0)
SELECT id, seq FROM a UNION ALL SELECT id, CAST((SELECT max(seq) FROM a) + row_number() OVER (ORDER BY ts, id) AS BIGINT) AS seq FROM b""")
def merge_stores(spark: SparkSession, d: str) -> DataFrame:
    return store_ops.merge(_store(spark, d, False), _store(spark, d, True)).select("id", "seq")


@R.query("""SELECT id, kind FROM {FACTS} f WHERE ts >= (SELECT epoch(min(ts)) + 1000 FROM events) AND ts < (SELECT epoch(min(ts)) + 200000 FROM events)
  AND kind IN ('click', 'error') AND observer <> '3' AND CAST(observer AS BIGINT) < 9""")
def slice_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d)
    first = rows.agg(F.min("ts")).first()[0]
    return store_ops.slice_store(rows, since=first + 1000, before=first + 200000, kinds=["click", "error"], observers=[str(i) for i in range(9) if i != 3]).select("id", "kind")


@R.query("SELECT id, CAST(0 AS INTEGER) AS store FROM {FACTS} f WHERE seq % 2 = 0 UNION ALL SELECT id, 1 FROM {FACTS} f WHERE seq % 3 <> 0")
def union_stores(spark: SparkSession, d: str) -> DataFrame:
    return reads.combined([_store(spark, d, False), _store(spark, d, True)]).select("id", "store")


@R.query("""SELECT id, CASE WHEN seq % 3 = 0 THEN 'left' WHEN seq % 2 = 1 THEN 'right' ELSE 'changed' END AS side FROM {FACTS} f
  WHERE (seq % 2 = 0 AND seq % 3 = 0) OR (seq % 2 = 1 AND seq % 3 <> 0) OR (seq % 2 = 0 AND seq % 3 <> 0 AND kind = 'view')""")
def store_difference(spark: SparkSession, d: str) -> DataFrame:
    other = F.coalesce(-F.col("cents") - 1, F.lit(0))  # differs from every number and from null; -cents alone leaves 0 as it is
    two = _store(spark, d, True).withColumn("cents", F.when(F.col("kind") == "view", other).otherwise(F.col("cents")))
    return store_ops.difference(_store(spark, d, False), two)


@R.query("""WITH b AS (SELECT 'fact' AS type, id, seq AS place, 0 AS r, 0 AS t FROM {FACTS} f UNION ALL SELECT 'tick', id, at_seq, 1, tick_seq FROM """ + TICKS + """ t)
SELECT CAST(row_number() OVER (ORDER BY place, r, t) AS BIGINT) AS pos, type, id FROM b""")
def export_order(spark: SparkSession, d: str) -> DataFrame:
    return store_ops.interleaved(facts(spark, d), _ticks(spark, d))


@R.query("""WITH n AS (SELECT row_number() OVER (ORDER BY seq) AS seq, id, kind FROM {FACTS} f WHERE kind <> 'error'),
t AS (SELECT (SELECT count(*) FROM n) + row_number() OVER (ORDER BY tick_seq) AS seq, id, 'tick.' || name AS kind FROM """ + TICKS + """ t),
b AS (SELECT * FROM n UNION ALL SELECT * FROM t)
SELECT CAST(seq AS BIGINT) AS seq, id, kind FROM b UNION ALL SELECT CAST(count(*) + 1 AS BIGINT), 'rebirth-' || CAST(count(*) AS VARCHAR), '_rebirth' FROM b""")
def rebirth_filtered(spark: SparkSession, d: str) -> DataFrame:
    ticks = _ticks(spark, d).withColumn("payload", F.lit("{}"))
    return store_ops.rebirth(facts(spark, d), ticks, lambda rows: rows.where("kind <> 'error'")).select("seq", "id", "kind")


# positions, previews, references ---------------------------------------------------
@R.query("SELECT tick_seq, name, t.ts, fact_cursor, at_seq AS cursor_seq, f.kind AS preview FROM " + TICKS + " t JOIN {FACTS} f ON f.id = t.fact_cursor WHERE name = 'w1' AND t.ts >= (SELECT epoch(min(ts)) + 50000 FROM events)")
def ticks_between(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d)
    first = rows.agg(F.min("ts")).first()[0]
    return reads.ticks_between(_ticks(spark, d), first + 50000, None, "w1", rows).select("tick_seq", "name", "ts", "fact_cursor", "cursor_seq", "preview")


@R.query("""SELECT 'head' AS address, max(seq) AS seq FROM {FACTS} f UNION ALL SELECT 'seq:12', 11 UNION ALL SELECT 'fact:e0000003', 30 UNION ALL SELECT 'tick:t193', 193
UNION ALL SELECT 'time', max(at_seq) FROM """ + TICKS + """ t WHERE ts <= (SELECT epoch(min(ts)) + 100000 FROM events) HAVING count(*) > 0""")
def positions(spark: SparkSession, d: str) -> DataFrame:
    """What head, seq:N, fact:PREFIX, tick:ID and a time mean."""
    rows, ticks = facts(spark, d), _ticks(spark, d)
    first = rows.agg(F.min("ts")).first()[0]
    out = None
    for name, address in (("head", "head"), ("seq:12", "seq:12"), ("fact:e0000003", "fact:e0000003"), ("tick:t193", "tick:t193"), ("time", str(first + 100000))):
        one = reads.position(rows, ticks, address).select(F.lit(name).alias("address"), "seq")
        out = one if out is None else out.unionByName(one)
    return out


@R.query("SELECT CAST(count(*) AS BIGINT) AS facts, CAST(count(*) FILTER (WHERE kind <> 'error') AS BIGINT) AS visible, CAST(count(DISTINCT kind) AS BIGINT) AS kinds, arg_max(id, seq) AS last_id, max(ts) AS latest FROM {FACTS} f WHERE seq <= 640")
def cut_summary(spark: SparkSession, d: str) -> DataFrame:
    return reads.cut_summary(_with_reserved(spark, d), 640)


@R.query("""WITH e AS (SELECT kind, k, arg_max(id, seq) AS fact_id FROM {FACTS} f GROUP BY kind, k)
SELECT o_orderkey, e.fact_id FROM orders LEFT JOIN e ON e.kind = 'view' AND e.k = o_custkey""")
def reference_resolution(spark: SparkSession, d: str) -> DataFrame:
    """References of orders to entities by key; those that name none are deferred."""
    o = table(spark, d, "orders").select("o_orderkey", F.lit("view").alias("kind"), F.col("o_custkey").cast("string").alias("key"))
    return reads.resolved_references(o, facts(spark, d), "k").select("o_orderkey", "fact_id")


@R.query("""SELECT id, CAST((SELECT max(seq) FROM events_a) + row_number() OVER (ORDER BY ts, id) AS BIGINT) AS seq FROM events_b""")
def append_facts(spark: SparkSession, d: str) -> DataFrame:
    """New facts take the receipts after the log's head; known ids are left out."""
    return store_ops.appended(_store(spark, d, False), _store(spark, d, True).drop("seq"), ["ts", "id"]).select("id", "seq")


ORACLE_SQL["append_facts"] = ORACLE_SQL["append_facts"].replace("events_a", ORACLE_SQL["fold_count"].split("FROM ", 1)[1].split(" f GROUP")[0] + " a WHERE seq % 2 = 0").replace(
    "events_b", ORACLE_SQL["fold_count"].split("FROM ", 1)[1].split(" f GROUP")[0] + " b WHERE seq % 3 <> 0 AND seq % 2 <> 0"
)


@R.query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN role || ' x' WHEN 2 THEN role || ' y' ELSE CAST(turn AS VARCHAR) END AS said,
  CASE turn % 4 WHEN 0 THEN text || ' ' || role ELSE role END AS whole FROM conversations""")
def spoken_text(spark: SparkSession, d: str) -> DataFrame:
    """Members that are text, lists of text, lists of objects with text, and numbers; and a payload's whole text."""
    from ..functions.values import payload_text, spoken

    c = table(spark, d, "conversations")
    which = F.col("turn") % 4
    quoted = F.expr("substring(to_json(struct(role)), 9, length(to_json(struct(role))) - 9)")
    said = F.when(which == 0, F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")).when(which == 1, F.concat(F.lit("["), quoted, F.lit(',"x"]')))
    said = said.when(which == 2, F.concat(F.lit('[{"text":'), quoted, F.lit('},{"text":"y"}]'))).otherwise(F.col("turn").cast("string"))
    payload = F.concat(F.lit('{"said":'), said, F.lit("}"))
    whole = F.when(which == 0, F.to_json(F.struct(F.col("text").alias("a"), F.col("role").alias("b"), F.lit("").alias("c")))).otherwise(F.to_json(F.struct("role")))
    return c.select("conv_id", "turn", spoken(payload, "said").alias("said"), payload_text(whole).alias("whole"))

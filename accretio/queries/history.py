"""Snapshots looked back on, open windows in order, namespaces, peers and members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, history, search, store_ops, surface
from ..plans import peers
from ..schemas import table
from .base import Registry, facts
from .entities import EDGES, _graph

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

# Each 97 facts of the log are a window whose snapshot holds keys by kind, a list and an empty kind.
KEYS = "(SELECT CAST(floor(seq / 97) AS BIGINT) AS win, kind, k, CAST(count(*) AS BIGINT) AS n, max(ts) AS ts FROM {FACTS} f GROUP BY ALL)"
STATS = """(SELECT win, kind, CAST(count(*) AS BIGINT) AS items, CAST(sum(n) AS BIGINT) AS facts, CAST(count(*) FILTER (WHERE k % 3 = 0) AS BIGINT) AS refs FROM """ + KEYS + """ k GROUP BY ALL
UNION ALL SELECT win, 'list', 2, 3, 0 FROM """ + KEYS + """ k GROUP BY win UNION ALL SELECT win, 'none', 0, 0, 0 FROM """ + KEYS + """ k GROUP BY win)"""
WINDOWS = "(SELECT win, max(ts) AS ts, row_number() OVER (ORDER BY max(ts) DESC, win DESC) - 1 AS index FROM " + KEYS + " k GROUP BY win)"


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """(tick_seq, ts, payload): a tick for each window, with what it sealed."""
    rows = facts(spark, d).groupBy(F.floor(F.col("seq") / 97).alias("tick_seq"), "kind", F.col("k").cast("string").alias("key")).agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    refs = F.when(F.col("key").cast("long") % 3 == 0, F.array(F.lit("part:1"))).otherwise(F.array().cast("array<string>"))
    item = F.struct(F.col("n").alias("_n"), refs.alias("_refs"))
    kinds = rows.groupBy("tick_seq", "kind").agg(F.map_from_entries(F.collect_list(F.struct("key", item.alias("item")))).alias("items"), F.max("ts").alias("ts"))
    ticks = kinds.groupBy("tick_seq").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("items").alias("held"))))).alias("sealed"), F.max("ts").alias("ts"))
    more = F.lit(',"list":{"items":[{"_n":2,"_refs":[]},5]},"none":{"items":{}},"flat":3,"_boundary":{"items":[1]}}')
    return ticks.select("tick_seq", "ts", F.concat(F.expr("left(sealed, length(sealed) - 1)"), more).alias("payload"))


@R.query("SELECT win AS tick_seq, kind, items, facts, refs, CASE WHEN items > 0 THEN round_even(facts / items, 1) END AS compression FROM " + STATS + " s")
def tick_payload_stats(spark: SparkSession, d: str) -> DataFrame:
    return history.payload_stats(_snapshots(spark, d), ["tick_seq"])


@R.query("SELECT CAST(index AS INTEGER) AS index, w.win AS tick_seq, w.ts, kind, items FROM " + WINDOWS + " w JOIN " + STATS + " s ON s.win = w.win WHERE index BETWEEN 2 AND 11")
def tick_history(spark: SparkSession, d: str) -> DataFrame:
    """The third to the twelfth newest tick with their kinds' counts."""
    return history.history(_snapshots(spark, d), 2, 12).select("index", "tick_seq", "ts", F.explode("kind_counts").alias("kind", "items"))


@R.query("SELECT kind, CAST(k AS VARCHAR) AS key, n FROM " + KEYS + " k WHERE win = (SELECT win FROM " + WINDOWS + " w WHERE index = 1) UNION ALL SELECT 'list', NULL, 2 UNION ALL SELECT 'list', NULL, NULL")
def tick_range_fold(spark: SparkSession, d: str) -> DataFrame:
    """What the newest tick of a range sealed."""
    rows = history.range_fold(_snapshots(spark, d), 1, 4)
    return rows.select("kind", "key", F.get_json_object("item", "$._n").cast("long").alias("n"))


@R.query("""WITH o AS (SELECT kind AS name, count(*) AS c, min(seq) AS pos FROM {FACTS} f GROUP BY kind),
w AS (SELECT name, pos, c % 97 AS facts, CASE WHEN name IN ('click', 'error') THEN 'when' ELSE 'every' END AS mode, name = 'signup' AS never FROM o),
s AS (SELECT *, CASE WHEN never THEN 2 WHEN mode = 'when' THEN 1 ELSE 0 END AS stratum, CASE WHEN never THEN 0 WHEN mode = 'when' THEN facts ELSE facts / 97 END AS metric FROM w)
SELECT name, CAST(stratum AS INTEGER) AS stratum, CAST(row_number() OVER (ORDER BY stratum, metric DESC, pos, name) AS INTEGER) AS rank FROM s""")
def horizon_order(spark: SparkSession, d: str) -> DataFrame:
    """Kinds as boundaries: two that a fact closes, one never sealed, the others by count."""
    rows = facts(spark, d).groupBy(F.col("kind").alias("name")).agg((F.count("*") % 97).alias("window_facts"), F.min("seq").alias("pos"))
    rows = rows.select("name", "pos", "window_facts", F.when(F.col("name").isin("click", "error"), "when").otherwise("every").alias("mode"), F.lit(97).alias("count"), (F.col("name") == "signup").alias("never_sealed"))
    return history.horizon_order(rows).select("name", "stratum", "rank")


@R.query("""WITH p AS (SELECT p_brand AS kind, CASE WHEN p_partkey % 3 = 0 OR (p_brand < 'Brand#3' AND p_partkey % 7 <> 0) THEN NULL ELSE split_part(p_type, ' ', 1) END AS ns FROM part),
g AS (SELECT kind, count(*) - count(ns) <= 2 * count(ns) AND count(ns) > 0 AS grouped FROM p GROUP BY kind)
SELECT p.kind, CASE WHEN grouped THEN ns END AS namespace, CAST(count(*) AS BIGINT) AS items FROM p JOIN g ON g.kind = p.kind GROUP BY ALL""")
def namespaces(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a brand by the first word of their type; brands with few keyed so stay whole."""
    p = table(spark, d, "part")
    bare = (F.col("p_partkey") % 3 == 0) | ((F.col("p_brand") < "Brand#3") & (F.col("p_partkey") % 7 != 0))
    path = F.concat_ws("/", F.split_part("p_type", F.lit(" "), F.lit(1)), F.col("p_partkey").cast("string"))
    return surface.namespaces(p.select(F.col("p_brand").alias("kind"), F.when(bare, F.col("p_partkey").cast("string")).otherwise(path).alias("key")))


@R.query("""WITH RECURSIVE w AS (SELECT src AS head, dst AS tail, [src, dst] AS path FROM """ + EDGES + """ e UNION SELECT w.head, e.dst, list_append(w.path, e.dst) FROM w JOIN """ + EDGES + """ e ON e.src = w.tail),
b AS (SELECT head, path FROM w QUALIFY row_number() OVER (PARTITION BY head ORDER BY len(path) DESC, path) = 1)
SELECT array_to_string(path, ' > ') AS chain, CAST(len(path) AS INTEGER) AS length FROM b WHERE head NOT IN (SELECT path[2] FROM b) ORDER BY len(path) DESC, path LIMIT 10""")
def top_chains(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_chains(_graph(spark, d)).select(F.array_join("path", " > ").alias("chain"), "length")


@R.query("""SELECT CAST(seq AS BIGINT) AS seq, 'changed' AS side FROM (SELECT row_number() OVER (ORDER BY seq) AS seq, kind, k FROM {FACTS} f WHERE kind <> 'error') n WHERE kind = 'view' AND k = 7
UNION ALL SELECT CAST(count(*) + 1 AS BIGINT), 'left' FROM {FACTS} f WHERE kind <> 'error'""")
def rebirth_problems(spark: SparkSession, d: str) -> DataFrame:
    """A rebirth without its receipt, and with some facts of another observer."""
    source = facts(spark, d)

    def transform(rows: DataFrame) -> DataFrame:
        return rows.where("kind <> 'error'")

    target = store_ops.rebirth(source.withColumn("observer", F.when((F.col("kind") == "view") & (F.col("k") == 7), F.lit("nobody")).otherwise(F.col("observer"))), None, transform)
    return store_ops.rebirth_problems(source, target.where("kind <> '_rebirth'"), None, transform)


@R.query("""WITH a AS (SELECT * FROM {FACTS} f WHERE seq % 2 = 0 AND kind = 'click' ORDER BY ts DESC, seq DESC LIMIT 30), b AS (SELECT * FROM {FACTS} f WHERE seq % 2 = 1 AND kind = 'click' ORDER BY ts DESC, seq DESC LIMIT 30)
SELECT id, CAST(member AS INTEGER) AS member FROM (SELECT *, 0 AS member FROM a UNION ALL SELECT *, 1 FROM b) ORDER BY ts DESC, member, seq DESC LIMIT 40""")
def search_together(spark: SparkSession, d: str) -> DataFrame:
    """Two members' newest hits, and the newest of both."""
    rows = facts(spark, d)
    found = [search.substring(rows.where(F.col("seq") % 2 == side), "kind", "LIC").orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(30) for side in (0, 1)]
    return search.together(found, 40).select("id", "member")


# peers and members -------------------------------------------------------------
def _peers(spark: SparkSession, d: str) -> DataFrame:
    """Customers see their nation and say their segment; one in five sees all, one in seven says all."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("observer"),
        F.when(F.col("c_custkey") % 5 != 0, F.array(F.col("c_nationkey").cast("string"))).alias("horizon"),
        F.when(F.col("c_custkey") % 7 != 0, F.array("c_mktsegment")).alias("potential"),
    )


PEERS = "(SELECT c_custkey AS key, CASE WHEN c_custkey % 5 <> 0 THEN [CAST(c_nationkey AS VARCHAR)] END AS horizon, CASE WHEN c_custkey % 7 <> 0 THEN [c_mktsegment] END AS potential FROM customer)"


def _more(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where(F.col("c_custkey") % 2 == 0)
    kinds = F.array(F.lit("BUILDING"), F.lit("extra"))
    return c.select(F.col("c_custkey").cast("string").alias("observer"), F.lit(None).cast("array<string>").alias("horizon"), kinds.alias("potential"))


@R.query("""SELECT CAST(key AS VARCHAR) AS observer, array_to_string(horizon, ',') AS horizon,
  array_to_string(list_sort(CASE WHEN potential IS NULL THEN NULL WHEN key % 2 = 0 THEN list_distinct(list_concat(potential, ['BUILDING', 'extra'])) ELSE potential END), ',') AS potential FROM """ + PEERS + " p")
def peers_granted(spark: SparkSession, d: str) -> DataFrame:
    rows = peers.granted(_peers(spark, d), _more(spark, d))
    return rows.select("observer", *[F.array_join(s, ",").alias(s) for s in peers.SIDES])


@R.query("""SELECT CAST(key AS VARCHAR) AS observer, array_to_string(horizon, ',') AS horizon,
  array_to_string(CASE WHEN key % 2 = 1 THEN potential WHEN potential IS NULL THEN ['BUILDING', 'extra'] ELSE list_filter(potential, lambda x: x = 'BUILDING') END, ',') AS potential FROM """ + PEERS + " p")
def peers_restricted(spark: SparkSession, d: str) -> DataFrame:
    rows = peers.restricted(_peers(spark, d), _more(spark, d))
    return rows.select("observer", *[F.array_join(s, ",").alias(s) for s in peers.SIDES])


@R.query("""SELECT o_orderkey AS seq FROM orders JOIN """ + PEERS + """ p ON p.key = o_custkey WHERE o_custkey % 3 = 0 AND (potential IS NULL OR list_contains(potential, CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END))""")
def peers_delegated(spark: SparkSession, d: str) -> DataFrame:
    """Orders as facts of their customers' delegates, of which one in three customers has one."""
    have = _peers(spark, d)
    names = table(spark, d, "customer").where(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").cast("string").alias("observer"), F.lit("desk").alias("child"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "BUILDING").otherwise("MACHINERY")
    said = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.col("o_custkey").cast("string"), F.lit("/desk")).alias("observer"), kind.alias("kind"))
    return peers.sayable(said, peers.delegated(have, names)).select("seq")


@R.query("""SELECT seq, 'shop' AS member FROM {FACTS} f WHERE kind IN ('purchase', 'view', 'click') AND NOT (k = 3 AND kind = 'purchase')
UNION ALL SELECT seq, 'shop/web' FROM {FACTS} f WHERE kind IN ('view', 'click') UNION ALL SELECT seq, 'ops' FROM {FACTS} f WHERE starts_with(kind, 'e')""")
def forwarded(spark: SparkSession, d: str) -> DataFrame:
    """Two members, one with a member of its own; a shop's own purchases don't come back to it."""
    members = (peers.Member("shop", ("purchase",), (), (peers.Member("web", ("view", "click")),)), peers.Member("ops", (), (("e*", "errors"),)))
    made = facts(spark, d).withColumn("maker", F.when((F.col("k") == 3) & (F.col("kind") == "purchase"), F.lit("shop")))
    return peers.forwarded(made, members, "maker").select("seq", "member")

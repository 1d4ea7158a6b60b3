"""Surfaces and graphs over folded entities: parts, orders, customers, nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, surface
from ..schemas import table
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

# Parts as items: a part is cited by each line that orders it; one line in three by
# its bare key.
ITEMS = """(SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS BIGINT) AS n, p_brand, p_type, p_partkey AS pos, CAST(p_partkey AS DOUBLE) AS ts,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'Open' ELSE 'done' END AS status FROM part)"""
INBOUND = "(SELECT i.*, (SELECT CAST(count(*) AS BIGINT) FROM lineitem l WHERE l.l_partkey = i.pos) AS inbound FROM " + ITEMS + " i)"
SALIENT = "(SELECT *, n + inbound AS salience FROM " + INBOUND + " b)"
QUANTILES = "(SELECT max(salience) FILTER (WHERE r = CAST(floor(0.5 * (c - 1) + 0.5) AS BIGINT)) AS q50, max(salience) FILTER (WHERE r = CAST(floor(0.9 * (c - 1) + 0.5) AS BIGINT)) AS q90 FROM (SELECT salience, row_number() OVER (ORDER BY salience) - 1 AS r, count(*) OVER () AS c FROM " + SALIENT + " s))"
TIERED = "(SELECT s.*, CASE WHEN salience >= q90 THEN 'high' WHEN salience >= q50 THEN 'mid' ELSE 'tail' END AS tier FROM " + SALIENT + " s, " + QUANTILES + " q)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    status = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 2 == 0, F.lit("Open")).otherwise(F.lit("done"))
    return p.select(
        F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("long").alias("n"), "p_brand", "p_type",
        F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("double").alias("ts"), status.alias("status"),
    )


def _edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    bare = F.col("l_linenumber") % 3 == 0
    return lines.select(F.when(bare, F.lit("")).otherwise(F.lit("part")).alias("kind"), F.col("l_partkey").cast("string").alias("key"), F.when(bare, F.lit("names")).otherwise(F.lit("orders")).alias("predicate"))


def _salient(spark: SparkSession, d: str) -> DataFrame:
    return surface.with_salience(surface.inbound(_items(spark, d), _edges(spark, d)))


@R.query("SELECT key, inbound FROM " + INBOUND + " i")
def graph_inbound(spark: SparkSession, d: str) -> DataFrame:
    return surface.inbound(_items(spark, d), _edges(spark, d)).select("key", "inbound")


@R.query("SELECT CAST(l_partkey AS VARCHAR) AS key, CASE WHEN l_linenumber % 3 = 0 THEN 'names' ELSE 'orders' END AS predicate, CAST(count(*) AS BIGINT) AS inbound FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY ALL")
def graph_inbound_predicates(spark: SparkSession, d: str) -> DataFrame:
    return surface.inbound_predicates(_items(spark, d), _edges(spark, d)).select("key", "predicate", "inbound")


@R.query("SELECT q50, q90 FROM " + QUANTILES + " q")
def tier_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return surface.tier_thresholds(_salient(spark, d)).select("q50", "q90")


@R.query("SELECT key, salience, tier FROM " + TIERED + " t")
def surface_tiers(spark: SparkSession, d: str) -> DataFrame:
    return surface.with_tiers(_salient(spark, d)).select("key", "salience", "tier")


@R.query("SELECT p_brand, CASE max(CASE tier WHEN 'high' THEN 3 WHEN 'mid' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'mid' ELSE 'tail' END AS tier FROM " + TIERED + " t GROUP BY p_brand")
def tier_max(spark: SparkSession, d: str) -> DataFrame:
    return surface.tier_max(surface.with_tiers(_salient(spark, d)), ["p_brand"])


@R.query("SELECT key, salience FROM " + SALIENT + " s ORDER BY salience DESC, pos LIMIT 100")
def budget_limit(spark: SparkSession, d: str) -> DataFrame:
    return surface.budget(_salient(spark, d), limit=100).select("key", "salience")


@R.query("SELECT key, ts FROM " + ITEMS + " s ORDER BY ts DESC, pos LIMIT 60")
def budget_last(spark: SparkSession, d: str) -> DataFrame:
    return surface.budget(_items(spark, d), last=60).select("key", "ts")


@R.query("SELECT key FROM (SELECT *, n % 4 AS s FROM " + ITEMS + " i) WHERE s >= 2")
def salience_window(spark: SparkSession, d: str) -> DataFrame:
    return surface.salience_window(_items(spark, d).withColumn("salience", F.col("n") % 4)).select("key")


@R.query("SELECT key FROM " + ITEMS + " i ORDER BY pos LIMIT 1")
def salience_window_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Nothing is salient enough: the first of the most salient stays."""
    return surface.salience_window(_items(spark, d).withColumn("salience", F.lit(1))).select("key")


@R.query("SELECT p_brand, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY p_brand")
def count_by(spark: SparkSession, d: str) -> DataFrame:
    return surface.count_by(_items(spark, d), "p_brand")


@R.query("SELECT key FROM " + ITEMS + " i WHERE lower(p_brand) IN ('brand#1', 'brand#3') AND lower(coalesce(status, '')) IN ('open')")
def predicate_where(spark: SparkSession, d: str) -> DataFrame:
    return surface.filtered(_items(spark, d), where={"p_brand": "BRAND#1,Brand#3", "status": "open"}).select("key")


@R.query("SELECT key FROM " + ITEMS + " i WHERE starts_with(key, '1') OR starts_with(key, '25')")
def key_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return surface.filtered(_items(spark, d), kind="part", key="1,25").select("key")


@R.query("SELECT key FROM " + ITEMS + " i WHERE status IS NULL OR lower(status) = 'open' OR key IN ('7', '9')")
def lifecycle_hide(spark: SparkSession, d: str) -> DataFrame:
    lifecycles = spark.sql("SELECT 'part' AS kind, array('open', 'waiting') AS active")
    return surface.hide_inactive(_items(spark, d), lifecycles, protect=["7", "9"]).select("key")


@R.query("SELECT key, CASE WHEN key = '12' THEN 'whole' ELSE 'brief' END AS granularity FROM " + ITEMS + " i")
def granularity(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("key", surface.granularity(F.col("key"), "12").alias("granularity"))


@R.query("SELECT key, 5000.0 * 86400 - ts * 86400 * 3 > 604800 AS stale FROM " + ITEMS + " i")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("key", surface.is_stale(F.col("ts") * 86400 * 3, 5000.0 * 86400).alias("stale"))


KEYED = "(SELECT t.*, CASE WHEN pos % 11 = 0 THEN NULL ELSE p_brand || '/' || p_type END AS path FROM " + TIERED + " t)"


@R.query("""SELECT CASE WHEN path IS NULL THEN '(no field)' ELSE split_part(substr(path, 7), '/', 1) END AS segment, CAST(count(*) AS BIGINT) AS items, CAST(sum(n) AS BIGINT) AS entries,
  CASE max(CASE tier WHEN 'high' THEN 3 WHEN 'mid' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'mid' ELSE 'tail' END AS tier
FROM """ + KEYED + """ k WHERE path IS NULL OR starts_with(path, 'Brand#') GROUP BY 1""")
def rollup_namespace(spark: SparkSession, d: str) -> DataFrame:
    rows = surface.with_tiers(_salient(spark, d))
    path = F.when(F.col("pos") % 11 == 0, F.lit(None)).otherwise(F.concat_ws("/", "p_brand", "p_type"))
    return surface.rollup(rows.withColumn("key", path), "Brand#")


@R.query("""SELECT name, CAST(count(*) AS BIGINT) AS facts, CAST(count(DISTINCT split_part(replace(value, '/', ':'), ':', 1)) AS BIGINT) AS targets, CAST(count(DISTINCT kind) AS BIGINT) AS sources FROM (
  SELECT o_orderpriority AS kind, 'buyer' AS name, 'customer:' || o_custkey AS value FROM orders UNION ALL SELECT o_orderstatus, 'of', CASE WHEN o_orderkey % 2 = 0 THEN 'nation/' ELSE 'customer:' END || o_custkey FROM orders)
GROUP BY name""")
def promotion_candidates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.col("o_custkey").cast("string")
    one = o.select(F.col("o_orderpriority").alias("kind"), F.lit("buyer").alias("name"), F.concat(F.lit("customer:"), key).alias("value"))
    two = o.select(F.col("o_orderstatus").alias("kind"), F.lit("of").alias("name"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("nation/")).otherwise(F.lit("customer:")), key).alias("value"))
    three = o.select(F.col("o_orderstatus").alias("kind"), F.lit("note").alias("name"), F.concat(F.lit("planet:"), key).alias("value"))
    return surface.promotion_candidates(one.unionByName(two).unionByName(three), ["customer", "nation"])


@R.query("SELECT p_brand, key, CAST(ceil(n * 8.0 / max(n) OVER (PARTITION BY p_brand)) AS INTEGER) AS level FROM " + ITEMS + " i")
def spark_levels(spark: SparkSession, d: str) -> DataFrame:
    return surface.spark_levels(_items(spark, d), "n", ["p_brand"]).select("p_brand", "key", "level")


@R.query("SELECT l_orderkey, l_linenumber, coalesce(tier, '') AS tier FROM lineitem LEFT JOIN (SELECT pos, tier FROM " + TIERED + " t WHERE pos % 2 = 0) t ON t.pos = l_partkey")
def tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("part").alias("kind"), F.col("l_partkey").cast("string").alias("key"))
    return surface.tier_lookup(lines, surface.with_tiers(_salient(spark, d)).where("pos % 2 = 0")).select("l_orderkey", "l_linenumber", "tier")


# graph: customers and suppliers lead to nations, nations to regions --------------------------
def _nodes(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("kind"), F.col(key).cast("string").alias("key"))

    rows = of("customer", "c_custkey").unionByName(of("supplier", "s_suppkey")).unionByName(of("nation", "n_nationkey"))
    return rows.unionByName(of("region", "r_regionkey").where("key <> '4'"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").cast("string").alias("key"), F.array(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))).alias("refs"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").cast("string").alias("key"), F.array(F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string"))).alias("refs"))
    n = table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_regionkey").alias("in"))
    return graph.references(c.unionByName(s)).unionByName(graph.declared_edges(n, "in", "region"))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolved(_refs(spark, d), _nodes(spark, d))


EDGES = """(SELECT 'customer:' || c_custkey AS src, 'ref' AS predicate, 'nation:' || c_nationkey AS dst FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'ref', 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'in', 'region:' || n_regionkey FROM nation WHERE n_regionkey <> 4)"""
NODES = """(SELECT 'customer' AS kind, 'customer:' || c_custkey AS name FROM customer UNION ALL SELECT 'supplier', 'supplier:' || s_suppkey FROM supplier
UNION ALL SELECT 'nation', 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region', 'region:' || r_regionkey FROM region WHERE r_regionkey <> 4)"""


@R.query("SELECT * FROM " + EDGES + " e")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).select("src", "predicate", "dst")


@R.query("SELECT 'nation:' || n_nationkey AS src, 'in' AS predicate, 'region:4' AS ref FROM nation WHERE n_regionkey = 4")
def graph_dangling(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling(_refs(spark, d), _nodes(spark, d))


@R.query("SELECT dst AS name, CAST(count(*) AS BIGINT) AS inbound FROM " + EDGES + " e GROUP BY dst ORDER BY inbound DESC, name LIMIT 10")
def graph_hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.hubs(_graph(spark, d), 10)


@R.query("SELECT name, kind FROM " + NODES + " n WHERE name NOT IN (SELECT src FROM " + EDGES + " e UNION ALL SELECT dst FROM " + EDGES + " e)")
def graph_orphans(spark: SparkSession, d: str) -> DataFrame:
    return graph.orphans(_nodes(spark, d), _graph(spark, d)).select("name", "kind")


@R.query("SELECT n.kind, CAST(count(*) AS BIGINT) AS nodes, CAST((SELECT count(*) FROM " + EDGES + " e WHERE split_part(src, ':', 1) = n.kind) AS BIGINT) AS edges FROM " + NODES + " n GROUP BY n.kind")
def graph_census(spark: SparkSession, d: str) -> DataFrame:
    return graph.census(_nodes(spark, d), _graph(spark, d))


@R.query("""WITH RECURSIVE w AS (SELECT 'customer:' || c_custkey AS name, 0 AS depth FROM customer
UNION SELECT e.dst, w.depth + 1 FROM w JOIN """ + EDGES + """ e ON e.src = w.name WHERE w.depth < 2)
SELECT name, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY name""")
def ref_walk(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("name"))
    return graph.walk(_graph(spark, d), starts, 2)


@R.query("""WITH RECURSIVE w AS (SELECT 'customer:' || c_custkey AS name, 0 AS depth FROM customer UNION SELECT 'supplier:' || s_suppkey, 0 FROM supplier
UNION SELECT e.dst, w.depth + 1 FROM w JOIN """ + EDGES + """ e ON e.src = w.name WHERE w.depth < 2)
SELECT name, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY name""")
def ref_walk_all(spark: SparkSession, d: str) -> DataFrame:
    """As ref_walk, from every customer and supplier."""
    starts = _nodes(spark, d).where(F.col("kind").isin("customer", "supplier"))
    return graph.walk(_graph(spark, d), starts.select(F.concat_ws(":", "kind", "key").alias("name")), 2)


@R.query("""WITH RECURSIVE w AS (SELECT DISTINCT src AS name, 0 AS length FROM """ + EDGES + """ e UNION SELECT e.dst, w.length + 1 FROM w JOIN """ + EDGES + """ e ON e.src = w.name)
SELECT name, CAST(max(length) AS INTEGER) AS length FROM w GROUP BY name""")
def longest_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.longest_chains(_graph(spark, d))


def _ring(spark: SparkSession, d: str) -> DataFrame:
    """Nations lead on within their region, and back from its last to its first; customers lead in."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    a, b = n.select(F.col("n_nationkey").alias("x"), "n_regionkey"), n.select(F.col("n_nationkey").alias("y"), "n_regionkey")
    up = a.join(b, "n_regionkey").where("x < y").select(F.col("x").cast("string").alias("src"), F.col("y").cast("string").alias("dst"))
    ends = n.groupBy("n_regionkey").agg(F.max("n_nationkey").cast("string").alias("src"), F.min("n_nationkey").cast("string").alias("dst")).select("src", "dst")
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.col("c_nationkey").cast("string").alias("dst"))
    return up.unionByName(ends).unionByName(c)


@R.query("SELECT CAST(n_nationkey AS VARCHAR) AS name, min(CAST(n_nationkey AS VARCHAR)) OVER (PARTITION BY n_regionkey) AS component FROM nation")
def graph_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(_ring(spark, d))

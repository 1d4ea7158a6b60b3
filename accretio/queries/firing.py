"""A vertex's boundaries together: which goes first, what is due after a replay, ticks by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import declarations, firing
from .base import Registry, facts

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

DECLARATION = """
name "shop"
loops {
  signup { fold { n "inc" }; boundary every=10 }
  error { fold { n "inc" }; boundary every=6 }
  click { fold { n "inc" }; boundary after=25 }
  purchase { fold { n "inc" }; boundary when="click" s="7" }
  view { fold { n "inc"; total "sum" "cents" }; boundary when="error" { condition "total" ">=" 60000; condition "n" ">" 3 } }
}
boundary when="signup" s="5"
"""

RULED = """(SELECT seq, id, ts, kind, k, cents, CASE WHEN (kind = 'signup' AND r % 10 = 0) OR (kind = 'error' AND r % 6 = 0) OR (kind = 'click' AND r = 25) THEN 'count'
  WHEN kind = 'signup' AND k = 5 THEN 'vertex' WHEN kind = 'click' AND k = 7 THEN 'when' END AS rule FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq) AS r FROM {FACTS} f))"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).withColumn("payload", F.to_json(F.struct(F.col("k").cast("string").alias("s"))))


@R.query("SELECT seq, id, ts, CASE rule WHEN 'count' THEN kind WHEN 'vertex' THEN 'shop' ELSE 'purchase' END AS name, rule FROM " + RULED + " r WHERE rule IS NOT NULL")
def firing_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Counts before the vertex's boundary before a kind's; one tick a fact."""
    v = declarations.vertex(DECLARATION)
    v.kinds["view"].boundary = None
    return firing.live(_facts(spark, d), v)


@R.query("""WITH RECURSIVE s AS (SELECT *, sum(CASE WHEN kind = 'view' THEN cents ELSE 0 END) OVER o AS upto, count(*) FILTER (WHERE kind = 'view') OVER o AS n FROM """ + RULED + """ r WINDOW o AS (ORDER BY seq)),
c AS (SELECT seq, upto, n FROM s WHERE kind = 'error' AND rule IS NULL),
t AS (SELECT * FROM (SELECT min(seq) AS seq, min(upto) AS upto, min(n) AS n FROM c WHERE upto >= 60000 AND n > 3) WHERE seq IS NOT NULL
  UNION ALL SELECT * FROM (SELECT min(c.seq), min(c.upto), min(c.n) FROM c, t WHERE c.upto - t.upto >= 60000 AND c.n - t.n > 3) x WHERE x.min IS NOT NULL)
SELECT seq, 'view' AS name FROM t""".replace("min(c.seq), min(c.upto), min(c.n)", "min(c.seq) AS min, min(c.upto) AS u, min(c.n) AS n"))
def firing_conditions(spark: SparkSession, d: str) -> DataFrame:
    """A kind that closes on two conditions of its state since it last closed, where no count went before."""
    return firing.live(_facts(spark, d), declarations.vertex(DECLARATION)).where("name = 'view'").select("seq", "name")


DUE = """WITH l AS (SELECT quantile_disc(seq, 0.5) AS mid FROM {FACTS} f), s AS (SELECT max(ts) AS since FROM {FACTS} f WHERE seq IN (SELECT mid FROM l)),
p AS (SELECT f.* FROM {FACTS} f, s WHERE ts >= since), w AS (SELECT min(seq) AS done FROM p WHERE kind = 'signup' AND k = 5),
t AS (SELECT sum(cents) AS total, count(*) AS n FROM {FACTS} f WHERE kind = 'view'),
o AS (SELECT min(seq) AS seq, 'purchase' AS name FROM p WHERE kind = 'click' AND k = 7 UNION ALL SELECT min(seq), 'view' FROM p, t WHERE kind = 'error' AND total >= 60000 AND n > 3)
SELECT o.seq, name, 'when' AS rule FROM o, w WHERE o.seq IS NOT NULL AND (w.done IS NULL OR o.seq < w.done) UNION ALL SELECT done, 'shop', 'vertex' FROM w WHERE done IS NOT NULL"""


def _ticks(f: DataFrame) -> DataFrame:
    """One tick, at the fact in the middle of the log."""
    middle = f.agg(F.expr("percentile_disc(0.5) within group (order by seq)").cast("long").alias("at"))
    return f.join(F.broadcast(middle), F.col("seq") == F.col("at")).select("seq", "ts")


@R.query(DUE)
def firing_pending(spark: SparkSession, d: str) -> DataFrame:
    """What is due after a replay since the last tick: once a kind, up to the vertex's boundary, on the whole log's state."""
    f = _facts(spark, d)
    return firing.pending(f, declarations.vertex(DECLARATION), _ticks(f)).select("seq", "name", "rule")


@R.query("""SELECT min(seq) AS seq, 'shop' AS name, 'vertex' AS rule FROM {FACTS} f WHERE kind = 'signup' AND k = 5
  AND ts > (SELECT max(ts) FROM {FACTS} f WHERE seq IN (SELECT quantile_disc(seq, 0.5) FROM {FACTS} f)) + 1e-6 HAVING count(*) > 0""")
def firing_vertex_only(spark: SparkSession, d: str) -> DataFrame:
    """The same where only the vertex has a boundary."""
    f = _facts(spark, d)
    v = declarations.vertex('name "shop"\nloops { view { fold { n "inc" } } }\nboundary when="signup" s="5"')
    return firing.pending(f, v, _ticks(f)).select("seq", "name", "rule")


SIX = [">=", "<=", ">", "<", "==", "!="]


@R.query("SELECT op, f.seq FROM (SELECT unnest(['>=', '<=', '>', '<', '==', '!=']) AS op) o, (SELECT min(seq) AS seq FROM {FACTS} f WHERE kind = 'error') f, (SELECT count(*) AS n FROM {FACTS} f WHERE kind = 'view') c "
         "WHERE CASE op WHEN '>=' THEN n >= 1982 WHEN '<=' THEN n <= 1982 WHEN '>' THEN n > 1982 WHEN '<' THEN n < 1982 WHEN '==' THEN n = 1982 ELSE n <> 1982 END")  # fmt: skip
def firing_operators(spark: SparkSession, d: str) -> DataFrame:
    """The six operators of a condition, against a count."""
    f = _facts(spark, d)
    text = 'name "x"\nloops {{ view {{ fold {{ n "inc" }}; boundary when="error" {{ condition "n" "{0}" 1982 }} }} }}'
    parts = [firing.pending(f, declarations.vertex(text.format(op))).select(F.lit(op).alias("op"), "seq") for op in SIX]
    return reduce(DataFrame.unionByName, parts)


@R.query("""SELECT 'noon' AS name, 7.0::DOUBLE AS ts, 'shop' AS origin, kind, 'n' AS target, CAST(count(*) AS DOUBLE) AS value FROM {FACTS} f GROUP BY kind
UNION ALL SELECT 'noon', 7.0, 'shop', kind, unnest(['total', 'total_rejected']), unnest([CAST(sum(cents) AS DOUBLE), 0.0]) FROM {FACTS} f WHERE kind = 'view' GROUP BY kind""")
def firing_by_hand(spark: SparkSession, d: str) -> DataFrame:
    """A tick by hand: the state of all kinds."""
    return firing.snapshot(_facts(spark, d), declarations.vertex(DECLARATION), "noon", 7.0)

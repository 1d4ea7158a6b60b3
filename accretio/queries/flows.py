"""Parse pipelines, boundaries and ticks, the chain, attribution and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, names
from ..operators import boundaries as b
from ..operators import chain, parse, search, why
from ..operators.parse import Coerce, Explode, Flatten, Pick, Project, Rename, Select, Skip, Split, Transform, Where
from ..schemas import table
from .base import Registry, facts

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

NOTES = "(SELECT event_id AS seq, event_type || ' ' || CAST(user_id AS VARCHAR) || '  ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '%' AS rec FROM events)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text: kind, observer and cents, with a percent sign."""
    f = facts(spark, d)
    return f.select("seq", F.concat(F.col("kind"), F.lit(" "), F.col("observer"), F.lit("  "), F.col("cents").cast("string"), F.lit("%")).alias("rec"))


def _json(spark: SparkSession, d: str) -> DataFrame:
    """JSON records with a nested object and a list that is sometimes empty, sometimes no list."""
    f, k = facts(spark, d), F.col("k").cast("string")
    items = F.when(F.col("k") % 4 == 0, F.lit("[]")).when(F.col("k") % 4 == 1, F.concat(F.lit("["), k, F.lit(",7]"))).when(F.col("k") % 4 == 2, F.concat(F.lit('[{"v":'), k, F.lit("}]"))).otherwise(F.lit('"none"'))
    rec = F.concat(F.lit('{"kind":"'), F.col("kind"), F.lit('","at":{"k":'), k, F.lit("}"), F.when(F.col("k") % 3 == 0, F.lit(',"tag":"x"')).otherwise(F.lit("")), F.lit(',"items":'), items, F.lit("}"))
    return f.select("seq", rec.alias("rec"))


@R.query("SELECT seq, string_split(rec, ' ')[1] AS kind, CAST(replace(string_split(rec, ' ')[4], '%', '') AS BIGINT) AS cents FROM " + NOTES + " n WHERE NOT starts_with(rec, 'error')")
def parse_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """skip, split, pick with names, transform, coerce."""
    steps = [Skip(startswith="error"), Split(), Pick((0, -1), ("kind", "cents")), Transform("cents", strip="%"), Coerce({"cents": "int"})]
    return parse.typed(parse.run(_lines(spark, d), steps), {"kind": "str", "cents": "int"}).select("seq", "kind", "cents")


@R.query("SELECT seq, rec FROM " + NOTES + " n WHERE NOT contains(rec, '7')")
def parse_skip(spark: SparkSession, d: str) -> DataFrame:
    return parse.run(_lines(spark, d), [Skip(contains="7")]).select("seq", "rec")


@R.query("SELECT seq, string_split(rec, ' ')[1] AS first, array_to_string(string_split(rec, ' ')[2:], ' ') AS rest FROM " + NOTES + " n")
def parse_split_max(spark: SparkSession, d: str) -> DataFrame:
    rows = parse.run(_lines(spark, d), [Split(" ", 1), Rename({0: "first", 1: "rest"})])
    return rows.select("seq", F.element_at("rec", "first").alias("first"), F.element_at("rec", "rest").alias("rest"))


@R.query("SELECT seq, kind, CASE WHEN kind IN ('view', 'click') THEN true ELSE false END AS flag FROM {FACTS} f WHERE kind <> 'signup'")
def parse_coerce_bool(spark: SparkSession, d: str) -> DataFrame:
    """Truth values in several spellings; what is none is dropped."""
    f = facts(spark, d)
    word = F.when(F.col("kind") == "view", "Yes").when(F.col("kind") == "click", "1").when(F.col("kind") == "error", "no").when(F.col("kind") == "purchase", "FALSE").otherwise("perhaps")
    rows = f.select("seq", "kind", F.create_map(F.lit("flag"), word).alias("rec"))
    return parse.typed(parse.run(rows, [Coerce({"flag": "bool"})]), {"flag": "bool"}).select("seq", "kind", "flag")


@R.query("SELECT seq, kind, CASE WHEN k % 3 = 0 THEN 'x' END AS tag, CAST(k AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS missing FROM {FACTS} f")
def parse_project(spark: SparkSession, d: str) -> DataFrame:
    rows = parse.run(_json(spark, d), [Project({"kind": "kind", "tag": "tag", "k": "at.k", "missing": "at.none.deep"})])
    return rows.select("seq", *[F.element_at("rec", c).alias(c) for c in ("kind", "tag", "k", "missing")])


@R.query("SELECT seq FROM {FACTS} f WHERE k % 3 <> 0 AND kind IN ('view', 'click')")
def parse_where(spark: SparkSession, d: str) -> DataFrame:
    """A missing member compares as None, so not_equals lets it pass."""
    steps = [Where("tag", "not_equals", "x"), Where("kind", "in_", values=("view", "click")), Where("at.k", "exists")]
    return parse.run(_json(spark, d), steps).select("seq")


@R.query("SELECT seq, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + 0 AS n FROM {FACTS} f WHERE k % 3 = 0")
def parse_select(spark: SparkSession, d: str) -> DataFrame:
    """What has none of the fields is dropped."""
    rows = parse.run(_json(spark, d).withColumn("rec", F.from_json("rec", "map<string,string>")), [Select(("tag", "none"))])
    return rows.select("seq", F.size("rec").alias("n"))


@R.query("""SELECT seq, CAST(k AS VARCHAR) AS v, kind FROM {FACTS} f WHERE k % 4 IN (1, 2)
UNION ALL SELECT seq, '7', kind FROM {FACTS} f WHERE k % 4 = 1 UNION ALL SELECT seq, NULL, kind FROM {FACTS} f WHERE k % 4 = 3""")
def parse_explode(spark: SparkSession, d: str) -> DataFrame:
    """Lists of scalars and of objects, empty lists, and what is no list; kind is carried."""
    rows = parse.run(_json(spark, d), [Explode("items", ("kind",)), Project({"a": "_value", "b": "v", "kind": "kind"})])
    return rows.select("seq", F.coalesce(F.element_at("rec", "a"), F.element_at("rec", "b")).alias("v"), F.element_at("rec", "kind").alias("kind"))


@R.query("""SELECT seq, CASE WHEN k % 2 = 0 THEN 'a: ' || CAST(k AS VARCHAR) || chr(10) || 'b: x' || chr(10) || 'a: 5' ELSE '' END AS text FROM {FACTS} f""")
def parse_flatten(spark: SparkSession, d: str) -> DataFrame:
    rec = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"parts":[{"a":'), F.col("k").cast("string"), F.lit(',"b":"x"},{"a":5}]}'))).otherwise(F.lit('{"parts":3}'))
    return parse.run(facts(spark, d).select("seq", rec.alias("rec")), [Flatten("parts", "text", ("a", "b"))]).select("seq", "text")


# boundaries ------------------------------------------------------------------------
@R.query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq) AS r, count(*) OVER (PARTITION BY kind) AS c FROM {FACTS} f)
SELECT kind, CAST(floor((r - 1) / 50) AS BIGINT) AS win, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS total, max(seq) AS at_seq FROM n
WHERE (floor((r - 1) / 50) + 1) * 50 <= c GROUP BY ALL""")
def boundary_every_n(spark: SparkSession, d: str) -> DataFrame:
    rows = b.every(facts(spark, d), 50)
    return rows.groupBy("kind", F.col("window").cast("long").alias("win")).agg(F.count("*").alias("n"), F.sum("cents").alias("total"), F.max("seq").alias("at_seq"))


@R.query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq) AS r FROM {FACTS} f)
SELECT kind, CAST(count(*) AS BIGINT) AS n, max(seq) AS at_seq, CAST(sum(cents) AS BIGINT) AS total FROM n WHERE r <= 120 GROUP BY kind HAVING count(*) = 120""")
def boundary_after_n(spark: SparkSession, d: str) -> DataFrame:
    return b.after(facts(spark, d), 120).groupBy("kind").agg(F.count("*").alias("n"), F.max("seq").alias("at_seq"), F.sum("cents").alias("total"))


CLOSED = """(SELECT *, coalesce(sum(CASE WHEN kind = 'signup' AND k < 20 THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS win,
  kind = 'signup' AND k < 20 AS closes FROM {FACTS} f)"""


@R.query("""SELECT CAST(win AS BIGINT) AS win, CAST(count(*) AS BIGINT) AS n, min(seq) AS since_seq, max(seq) AS at_seq, CAST(sum(cents) AS BIGINT) AS total FROM """ + CLOSED + """ w
GROUP BY win HAVING bool_or(closes)""")
def boundary_when(spark: SparkSession, d: str) -> DataFrame:
    """Windows that close with a signup whose key is below 20."""
    rows = b.when(facts(spark, d), (F.col("kind") == "signup") & (F.col("k") < 20)).where(~F.col("open"))
    return rows.groupBy(F.col("window").alias("win")).agg(F.count("*").alias("n"), F.min("seq").alias("since_seq"), F.max("seq").alias("at_seq"), F.sum("cents").alias("total"))


@R.query("""WITH f AS (SELECT * FROM {FACTS} f), w AS (SELECT *, coalesce(sum(CASE WHEN k = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS win FROM f)
SELECT kind, CAST(win AS BIGINT) AS win, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY ALL HAVING bool_or(k = 5)""")
def boundary_match(spark: SparkSession, d: str) -> DataFrame:
    """Windows of each kind that close with a payload whose member is a given text; numbers never match."""
    f = facts(spark, d).withColumn("payload", F.concat(F.lit('{"n":5,"s":"'), F.col("k").cast("string"), F.lit('"}')))
    rows = b.when(f, b.matches(F.col("payload"), {"s": "5"}) & ~b.matches(F.col("payload"), {"n": "5"}), ["kind"]).where(~F.col("open"))
    return rows.groupBy("kind", F.col("window").alias("win")).agg(F.count("*").alias("n"))


@R.query("""WITH RECURSIVE n AS (SELECT kind, cents, seq, row_number() OVER (PARTITION BY kind ORDER BY seq) AS r FROM {FACTS} f),
s AS (SELECT kind, r, seq, seq AS since_seq, CAST(1 AS BIGINT) AS n, CAST(cents AS DOUBLE) AS amount, CAST(0 AS BIGINT) AS tick, cents >= 30000 AS fired FROM n WHERE r = 1
UNION ALL SELECT n.kind, n.r, n.seq, CASE WHEN s.fired THEN n.seq ELSE s.since_seq END, CASE WHEN s.fired THEN 1 ELSE s.n + 1 END,
  CASE WHEN s.fired THEN CAST(n.cents AS DOUBLE) ELSE s.amount + n.cents END, CASE WHEN s.fired THEN s.tick + 1 ELSE s.tick END,
  (CASE WHEN s.fired THEN CAST(n.cents AS DOUBLE) ELSE s.amount + n.cents END) >= 30000 FROM s JOIN n ON n.kind = s.kind AND n.r = s.r + 1)
SELECT kind, tick, since_seq, seq AS at_seq, n, amount FROM s WHERE fired""")
def boundary_condition(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of each kind's sum, set back when it reaches 300.00."""
    return b.fires(facts(spark, d), "cents", 30000)


@R.query("""WITH e AS (SELECT win, seq AS at_seq, ts AS at_ts FROM """ + CLOSED + """ w WHERE closes), k AS (SELECT DISTINCT event_type AS kind FROM events)
SELECT CAST(win AS BIGINT) AS win, k.kind, at_seq, at_ts, CAST(count(f.seq) AS BIGINT) AS n, CAST(coalesce(sum(f.cents), 0) AS BIGINT) AS amount
FROM e CROSS JOIN k LEFT JOIN {FACTS} f ON f.kind = k.kind AND f.seq <= e.at_seq GROUP BY ALL""")
def vertex_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """At each closing fact, all kinds so far; nothing is set back."""
    f = facts(spark, d)
    out = b.snapshots(f, (F.col("kind") == "signup") & (F.col("k") < 20), f.select("kind").distinct(), "cents")
    return out.withColumnRenamed("window", "win")


def _closed(spark: SparkSession, d: str) -> DataFrame:
    return b.when(facts(spark, d), (F.col("kind") == "signup") & (F.col("k") < 20)).where(~F.col("open"))


TICKS = """(SELECT win, min(ts) AS since, arg_max(ts, seq) AS ts, max(seq) AS at_seq, count(*) AS n FROM """ + CLOSED + """ w GROUP BY win HAVING bool_or(closes))"""


@R.query("""SELECT CAST(t.win AS BIGINT) AS win, CAST(count(*) AS BIGINT) AS facts, CAST(count(DISTINCT kind) AS BIGINT) AS kinds, CAST(count(DISTINCT k) AS BIGINT) AS keys
FROM """ + TICKS + """ t JOIN {FACTS} f ON f.ts BETWEEN t.since AND t.ts GROUP BY t.win""")
def window_stats(spark: SparkSession, d: str) -> DataFrame:
    ticks = b.ticks_of(_closed(spark, d), F.lit("w"), [], "cents")
    return b.window_stats(facts(spark, d), ticks, "k").select(F.col("window").alias("win"), "facts", "kinds", "keys")


@R.query("""SELECT CAST(t.win AS BIGINT) AS win, f.seq FROM """ + TICKS + """ t JOIN {FACTS} f ON f.ts BETWEEN t.since AND t.ts WHERE t.win BETWEEN 2 AND 5""")
def tick_range_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a range of ticks; a fact on a shared end is in both."""
    ticks = b.ticks_of(_closed(spark, d), F.lit("w"), [], "cents").where(F.col("window").between(2, 5))
    return b.window_facts(facts(spark, d), ticks).select(F.col("window").alias("win"), "seq")


@R.query("""WITH c AS (SELECT win, k, count(*) AS n FROM """ + CLOSED + """ w WHERE win < (SELECT count(*) FROM """ + CLOSED + """ x WHERE closes) GROUP BY ALL),
p AS (SELECT *, lag(win) OVER (PARTITION BY k ORDER BY win) AS prior FROM c)
SELECT CAST(win AS BIGINT) AS win, CAST(count(*) AS BIGINT) AS keys, CAST(count(*) FILTER (WHERE prior IS NULL) AS BIGINT) AS added,
  CAST(count(*) FILTER (WHERE prior IS NOT NULL) AS BIGINT) AS updated, CAST(sum(n) AS BIGINT) AS facts, round_even(sum(n) / count(*), 1) AS compression FROM p GROUP BY win""")
def tick_deltas(spark: SparkSession, d: str) -> DataFrame:
    return b.tick_deltas(_closed(spark, d), "k", []).withColumnRenamed("window", "win")


@R.query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq) AS r, count(*) OVER (PARTITION BY kind) AS c FROM {FACTS} f),
s AS (SELECT kind, max(seq) AS sealed FROM n WHERE (floor((r - 1) / 75) + 1) * 75 <= c GROUP BY kind)
SELECT f.kind, CAST(count(*) AS BIGINT) AS open_facts, max(sealed) AS sealed_seq, min(ts) AS open_since FROM {FACTS} f LEFT JOIN s ON f.kind = s.kind WHERE sealed IS NULL OR seq > sealed GROUP BY f.kind""")
def horizon(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    ticks = b.ticks_of(b.every(f, 75), F.col("kind"), ["kind"], "cents")
    return b.horizon(f, ticks)


@R.query("""SELECT 'tick.w' AS kind, ts, 'vertex' AS observer, n FROM (SELECT ts, CAST(n AS BIGINT) AS n FROM """ + TICKS + """ t)""")
def tick_reentry(spark: SparkSession, d: str) -> DataFrame:
    """Ticks as facts of a log above."""
    out = b.ticks_as_facts(b.ticks_of(_closed(spark, d), F.lit("w"), [], "cents"), "vertex")
    return out.select("kind", "ts", "observer", F.get_json_object("payload", "$.n").cast("long").alias("n"))


# chain -------------------------------------------------------------------------------
ROW = "sha256(CAST(seq AS VARCHAR) || '|' || kind || '|' || CAST(cents AS VARCHAR))"
STRETCHES = """(SELECT tick_seq, string_agg(part, '' ORDER BY stretch) AS parts, sum(n) AS n FROM (
  SELECT CAST(floor(seq / 1500) AS BIGINT) AS tick_seq, CAST(floor(seq / 1000) AS BIGINT) AS stretch, sha256(string_agg(""" + ROW + """, '' ORDER BY seq)) AS part, count(*) AS n
  FROM {FACTS} f GROUP BY ALL) GROUP BY tick_seq)"""


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 1500 facts; the first begins before fact 0."""
    f = facts(spark, d)
    w = f.groupBy(F.floor(F.col("seq") / 1500).alias("tick_seq")).agg((F.min("seq") - 1).alias("first"), F.max("seq").alias("last"))
    row = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "kind", F.col("cents").cast("string")), 256)
    return chain.window_hashes(f, w, row)


@R.query("SELECT tick_seq, CAST(n AS BIGINT) AS n, sha256(parts) AS window_hash FROM " + STRETCHES + " s")
def window_hash(spark: SparkSession, d: str) -> DataFrame:
    return _hashes(spark, d)


@R.query("""WITH RECURSIVE t AS (SELECT tick_seq, sha256(parts) AS h FROM """ + STRETCHES + """ s),
c AS (SELECT tick_seq, CAST('' AS VARCHAR) AS prev, sha256(CAST(tick_seq AS VARCHAR) || '|w||' || h || '|') AS own FROM t WHERE tick_seq = 0
UNION ALL SELECT t.tick_seq, c.own, sha256(CAST(t.tick_seq AS VARCHAR) || '|w||' || t.h || '|' || c.own) FROM c JOIN t ON t.tick_seq = c.tick_seq + 1)
SELECT tick_seq, nullif(prev, '') AS prev_hash FROM c""")
def chain_build(spark: SparkSession, d: str) -> DataFrame:
    ticks = _hashes(spark, d).withColumns({"origin": F.lit(""), "name": F.lit("w"), "fact_cursor": F.lit("")})
    return chain.chained(ticks).select("tick_seq", "prev_hash")


@R.query("SELECT CAST(4 AS BIGINT) AS tick_seq, 'chain' AS problem WHERE (SELECT count(*) FROM events) > 6000")
def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """A window hash is changed in the fourth tick (number 3); the next no longer fits it."""
    ticks = _hashes(spark, d).withColumns({"origin": F.lit(""), "name": F.lit("w"), "fact_cursor": F.lit("")})
    made = chain.chained(ticks)
    return chain.verified(made.withColumn("window_hash", F.when(F.col("tick_seq") == 3, F.lit("x")).otherwise(F.col("window_hash")))).select("tick_seq", "problem")


@R.query("SELECT observer, CAST(count(*) FILTER (WHERE k % 2 = 0) AS BIGINT) AS signed, CAST(count(*) FILTER (WHERE k % 2 <> 0) AS BIGINT) AS unsigned FROM {FACTS} f GROUP BY observer")
def signature_counts(spark: SparkSession, d: str) -> DataFrame:
    return chain.signature_counts(facts(spark, d).withColumn("signature", F.when(F.col("k") % 2 == 0, F.lit("s"))))


@R.query("SELECT seq, '{\"a\":\"' || kind || '\",\"b\":' || CAST(k AS VARCHAR) || '}' AS canonical, sha256('[\"' || id || '\",\"' || kind || '\",null]') AS hash FROM {FACTS} f")
def row_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Canonical JSON of a payload, and the hash of a row."""
    text = F.concat(F.lit('{ "b" : '), F.col("k").cast("string"), F.lit('.0, "a":"'), F.col("kind"), F.lit('"}'))
    f = facts(spark, d).withColumn("text", text)
    return f.select("seq", hashing.canonical_json(F.col("text")).alias("canonical"), hashing.row_hash(F.col("id"), F.col("kind"), F.lit(None)).alias("hash"))


@R.query("""SELECT seq, array_to_string([substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(floor(ms / pow(32, 9 - i)) AS BIGINT) % 32 + 1, 1) FOR i IN range(0, 10)], '') AS head, 26 AS size
FROM (SELECT seq, CAST(floor(ts * 1000) AS BIGINT) AS ms FROM {FACTS} f)""")
def rebirth_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids made anew from time and the old id: the first ten digits are the milliseconds."""
    f = facts(spark, d).withColumn("u", hashing.ulid(F.col("ts"), F.col("id")))
    return f.select("seq", F.substring("u", 1, 10).alias("head"), F.length("u").alias("size"))


# attribution ---------------------------------------------------------------------------
EVENTS_BY_K = """(SELECT CAST(k AS VARCHAR) AS key, seq, unnest(['status', 'band']) AS name,
  unnest([CASE WHEN seq % 4 = 0 THEN NULL ELSE kind END, CAST(CAST(floor(cents / 20000) AS BIGINT) AS VARCHAR)]) AS value FROM {FACTS} f)"""
CHANGES = """(SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY key, name ORDER BY seq) AS before FROM """ + EVENTS_BY_K + """ e WHERE value IS NOT NULL) WHERE value IS DISTINCT FROM before)"""


def _field_events(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("status", F.when(F.col("seq") % 4 != 0, F.col("kind"))).withColumn("band", F.floor(F.col("cents") / 20000))
    return why.field_events(f, "k", ["status", "band"])


@R.query("SELECT key, name, arg_max(value, seq) AS value, max(seq) AS changed_by, CAST(count(*) AS BIGINT) AS changes FROM " + CHANGES + " c GROUP BY key, name")
def why_attribution(spark: SparkSession, d: str) -> DataFrame:
    return why.attribution(_field_events(spark, d))


@R.query("SELECT key, seq, before, value FROM " + CHANGES + " c WHERE name = 'status'")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    return why.changes(_field_events(spark, d)).where("name = 'status'").select("key", "seq", "before", "value")


# search -----------------------------------------------------------------------------------
WORDS = "(SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("kind"), F.col("doc_id").cast("double").alias("ts"), "text")


def _index(docs: DataFrame) -> DataFrame:
    return search.index(docs, "text", "seq")


_WORDS_SQL = "SELECT doc_id AS seq FROM " + WORDS + " d WHERE list_contains(w, 'the') AND NOT list_contains(w, 'and') AND lang = 'en' ORDER BY doc_id DESC LIMIT 40"
_PREFIX_SQL = "SELECT doc_id AS seq FROM " + WORDS + " d WHERE len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0 OR list_contains(w, 'token')"
_PHRASE_SQL = "SELECT doc_id AS seq FROM " + WORDS + " d WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' in the ')"
_WORDS_QUERY = search.And((search.Word("The"), search.Not(search.Word("and"))))
_PREFIX_QUERY = search.Or((search.Word("licen", True), search.Word("token")))
_PHRASE_QUERY = search.Phrase(("in", "the"))


@R.query(_WORDS_SQL)
def search_words(spark: SparkSession, d: str) -> DataFrame:
    """the, without and, in English documents: the newest 40."""
    return search.scan(_docs(spark, d), "text", _WORDS_QUERY, ["en"], 40).select("seq")


@R.query(_PREFIX_SQL)
def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.scan(_docs(spark, d), "text", _PREFIX_QUERY).select("seq")


@R.query(_PHRASE_SQL)
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return search.scan(_docs(spark, d), "text", _PHRASE_QUERY).select("seq")


@R.query(_WORDS_SQL)
def search_words_indexed(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return search.search(_index(docs), docs, _WORDS_QUERY, ["en"], 40).select("seq")


@R.query(_PREFIX_SQL)
def search_prefix_indexed(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return search.search(_index(docs), docs, _PREFIX_QUERY).select("seq")


@R.query(_PHRASE_SQL)
def search_phrase_indexed(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return search.search(_index(docs), docs, _PHRASE_QUERY).select("seq")


@R.query("SELECT doc_id AS seq FROM documents WHERE contains(lower(text), 'apache license')")
def search_substring(spark: SparkSession, d: str) -> DataFrame:
    return search.substring(_docs(spark, d), "text", "Apache License").select("seq")


COVERED = "(SELECT lang AS kind, CASE WHEN lang = 'de' THEN 'unindexed' WHEN lang = 'fr' AND max(doc_id) > 10 THEN 'stale' ELSE 'fresh' END AS state FROM documents GROUP BY lang)"


def _covered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    upto = docs.where("kind <> 'de'").groupBy("kind").agg(F.max(F.when(F.col("kind") == "fr", F.lit(10).cast("long")).otherwise(F.col("seq"))).alias("last_seq"))
    return search.coverage(docs, upto, "a", "a")


@R.query("SELECT * FROM " + COVERED + " c")
def search_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _covered(spark, _docs(spark, d))


@R.query("""SELECT doc_id AS seq FROM """ + WORDS + """ d JOIN """ + COVERED + """ c ON c.kind = d.lang JOIN documents t USING (doc_id)
WHERE CASE WHEN state = 'fresh' THEN list_contains(w, 'version') ELSE contains(lower(text), 'version') END ORDER BY doc_id DESC LIMIT 100""")
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return search.hybrid(_index(docs), docs, _covered(spark, docs), search.Word("version"), "text").select("seq")


# names ------------------------------------------------------------------------------------
@R.query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'part' WHEN p_partkey % 4 = 1 THEN 'part' ELSE '' END AS kind, CAST(CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE 1 END AS INTEGER) AS good,
  CAST(CASE WHEN p_partkey % 4 = 1 THEN 2 WHEN p_partkey % 4 = 3 THEN 0 ELSE 1 END AS INTEGER) AS n FROM part""")
def addresses(spark: SparkSession, d: str) -> DataFrame:
    """A single address and all readings of kind:key, kind/key, key and :key."""
    key = F.col("p_partkey").cast("string")
    which = F.col("p_partkey") % 4
    text = F.when(which == 0, F.concat(F.lit("part:"), key)).when(which == 1, F.concat(F.lit("part/"), key)).when(which == 2, key).otherwise(F.concat(F.lit(":"), key))
    rows = table(spark, d, "part").select("p_partkey", names.address(text).alias("a"), F.size(names.readings(text)).alias("n"))
    return rows.select("p_partkey", F.coalesce("a.kind", F.lit("")).alias("kind"), F.col("a").isNotNull().cast("int").alias("good"), "n")


@R.query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' OR starts_with(p_brand, 'Brand#1.')")
def kind_subtree(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(names.in_kind(F.col("p_brand"), "Brand#1")).select("p_partkey")


@R.query("SELECT seq FROM {FACTS} f WHERE observer = '3' AND seq % 3 <> 1")
def observer_match(spark: SparkSession, d: str) -> DataFrame:
    """A bare name matches any namespace's; two namespaces never match, nor do other names."""
    f = facts(spark, d)
    own = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("x/"), "observer")).when(F.col("seq") % 3 == 1, F.concat(F.lit("3/"), "observer", F.lit("0"))).otherwise(F.col("observer"))
    return f.where(names.observer_matches(own, F.lit("3"))).select("seq")


@R.query("SELECT seq, CASE WHEN kind = 'view' THEN 'view' WHEN starts_with(kind, 's') THEN 'starts' WHEN contains(kind, 'r') THEN 'holds' END AS loop FROM {FACTS} f")
def route_globs(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    return f.select("seq", names.routed(F.col("kind"), [("s*", "starts"), ("*r*", "holds")], ["view"]).alias("loop"))


# declarations over the log -------------------------------------------------------------------
DECLARATION = """
name "shop"
loops {
  click { fold { items "by" "k"; n "inc"; seen "latest" } }
  error { fold { last "collect" 15; total "sum" "cents"; least "min" "cents"; mean "avg" "cents" } }
  view { fold { recent "window" 4 "cents" } }
}
routes { "pur*" "click" }
"""


@R.query("""WITH f AS (SELECT * FROM {FACTS} f WHERE seq <= 700), c AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq DESC) AS r FROM f)
SELECT 'click' AS kind, 'items' AS target, 'by' AS fold, CAST(k AS VARCHAR) AS key, min(seq) AS pos, CAST(count(*) AS BIGINT) AS n FROM f WHERE kind = 'click' GROUP BY k
UNION ALL SELECT 'error', 'last', 'collect', NULL, seq, 1 FROM c WHERE kind = 'error' AND r <= 15
UNION ALL SELECT 'view', 'recent', 'window', NULL, row_number() OVER (ORDER BY seq), 1 FROM c WHERE kind = 'view' AND r <= 4""")
def vertex_items(spark: SparkSession, d: str) -> DataFrame:
    """A declaration's items at receipt 700."""
    from ..plans import declarations, read

    items, _, _ = read.fold(facts(spark, d), declarations.vertex(DECLARATION), at=700)
    return items.select("kind", "target", "fold", "key", "pos", "n")


@R.query("""WITH f AS (SELECT * FROM {FACTS} f WHERE seq <= 700)
SELECT 'click' AS kind, unnest(['n', 'seen', 'seen_rejected']) AS target, unnest([CAST(count(*) AS DOUBLE), arg_max(ts, seq), 0.0]) AS value FROM f WHERE kind = 'click' HAVING count(*) > 0
UNION ALL SELECT 'error', unnest(['total', 'total_rejected', 'least', 'least_rejected', 'mean', 'mean_sum', 'mean_count', 'mean_rejected']),
  unnest([CAST(sum(cents) AS DOUBLE), 0.0, CAST(least(0, min(cents)) AS DOUBLE), 0.0, round(avg(cents), 6), CAST(sum(cents) AS DOUBLE), CAST(count(*) AS DOUBLE), 0.0]) FROM f WHERE kind = 'error' HAVING count(*) > 0""")
def vertex_scalars(spark: SparkSession, d: str) -> DataFrame:
    from ..plans import declarations, read

    _, scalars, _ = read.fold(facts(spark, d), declarations.vertex(DECLARATION), at=700)
    return scalars.withColumn("value", F.round("value", 6))


@R.query("SELECT kind, CAST(count(*) AS BIGINT) AS count FROM {FACTS} f WHERE kind IN ('signup', 'purchase') GROUP BY kind")
def vertex_unfolded(spark: SparkSession, d: str) -> DataFrame:
    from ..plans import declarations, read

    return read.fold(facts(spark, d), declarations.vertex(DECLARATION))[2]


@R.query("""WITH b AS (SELECT *, 0 AS s FROM {FACTS} f WHERE seq % 2 = 0 UNION ALL SELECT *, 1 FROM {FACTS} f WHERE seq % 2 = 1),
r AS (SELECT *, CASE WHEN kind = 'purchase' THEN 'click' ELSE kind END AS loop FROM b)
SELECT loop AS kind, CAST(k AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n, arg_max(id, ts) AS last_id FROM r WHERE loop = 'click' GROUP BY ALL""")
def combined_fold(spark: SparkSession, d: str) -> DataFrame:
    """Two stores folded as one log, in time order, one kind routed to another's fold."""
    from ..operators import folds
    from ..plans import declarations, read

    f = facts(spark, d)
    both = read.combined([f.where("seq % 2 = 0"), f.where("seq % 2 = 1").withColumn("seq", F.col("seq") + 7)], declarations.vertex(DECLARATION))
    out = folds.upsert_fields(both.where("kind = 'click'").withColumn("last_id", F.col("id")), folds.Upsert("items", "k"), ["last_id"])
    return out.select("kind", "key", "n", "last_id")


@R.query("SELECT kind, CASE WHEN kind = 'error' THEN 'no grant' WHEN kind = 'signup' THEN 'undeclared' WHEN observer NOT IN ('1', '2', '3') THEN 'unknown observer' END AS refused, seq FROM {FACTS} f WHERE kind <> 'error' OR observer IN ('1', '2', '3')")
def admission(spark: SparkSession, d: str) -> DataFrame:
    """Facts with why they aren't admitted: undeclared kinds, unknown observers, no grant."""
    from ..plans import declarations

    v = declarations.vertex(DECLARATION + 'strict #true\nobservers { "1" { grant { potential "click" "view" "purchase" } }; "2" { grant { potential "click" "view" "purchase" } }; "3" { grant { potential "click" "view" "purchase" } } }')
    v.kinds["purchase"] = v.kinds["click"]
    return declarations.admitted(facts(spark, d), v).where("kind <> 'error' or refused = 'no grant'").select("kind", "refused", "seq")


@R.query("""SELECT 'kind' AS section, CAST(k AS VARCHAR) AS subject, arg_max(CAST(seq AS VARCHAR), seq) AS document FROM {FACTS} f WHERE kind IN ('click', 'error') GROUP BY k
HAVING arg_max(kind, seq) = 'click'""")
def declared_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents in force: the last of each subject, those removed last left out."""
    from ..plans import declarations

    f = facts(spark, d).where("kind in ('click', 'error')")
    k, seq = F.col("k").cast("string"), F.col("seq").cast("string")
    kept = F.col("kind") == "click"
    payload = F.when(kept, F.to_json(F.struct(k.alias("subject"), seq.alias("document")))).otherwise(F.to_json(F.struct(k.alias("subject"))))
    return declarations.declared(f.withColumn("payload", payload).withColumn("kind", F.when(kept, F.lit("_decl.kind-defined")).otherwise(F.lit("_decl.kind-removed"))))


@R.query("""SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS DOUBLE) AS total FROM {FACTS} f
WHERE (kind = 'click' AND k % 10 <> 3) OR (kind = 'view' AND k IN (5, 7)) GROUP BY kind""")
def parse_declared(spark: SparkSession, d: str) -> DataFrame:
    """Folds of facts as their kinds' parse blocks make them; those of which nothing is left aren't folded."""
    from ..operators import folds
    from ..plans import declarations, ingest

    v = declarations.vertex("""
    name "v"
    loops {
      click { parse { select "at" "price"; transform "price" { rstrip " EUR"; coerce "int" } }; fold { n "inc"; total "sum" "price" } }
      view { parse { where path="at.k" "in" "5" "7"; project { price path="at.cents" } ; transform "price" { coerce "int" } }; fold { n "inc"; total "sum" "price" } }
    }""")
    f, k, cents = facts(spark, d), F.col("k").cast("string"), F.col("cents").cast("string")
    price = F.when(F.col("k") % 10 == 3, F.lit("none")).otherwise(F.concat(cents, F.lit(" EUR")))
    payload = F.concat(F.lit('{"price":"'), price, F.lit('","at":{"k":'), k, F.lit(',"cents":'), cents, F.lit("}}"))
    rows = ingest.derived(f.select("seq", "kind", "ts", payload.alias("payload")), v)
    return folds.scalars(rows.where(F.col("kind").isin("click", "view")), v.specs()["click"]).select("kind", "n", "total")

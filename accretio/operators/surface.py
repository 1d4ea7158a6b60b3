"""Surfaces: folded entities as ranked, filtered, budgeted rows.

An item is a row (kind, key, n, ts, ...). Inbound references come from an edges
table (kind, key: what a reference means; ref: which reference it is).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import observer_matches


def inbound(items: DataFrame, edges: DataFrame) -> DataFrame:
    """``items`` with inbound: references whose reading is (kind, key), or the key alone.

    References are counted by reading before either join, so a much-cited item is
    one row, not a hot key.
    """
    counts = edges.groupBy(F.col("kind").alias("to_kind"), F.col("key").alias("to_key")).agg(F.count("*").alias("cited"))
    full = counts.where(F.col("to_kind") != "").select(F.col("to_kind").alias("kind"), F.col("to_key").alias("key"), F.col("cited").alias("by_full"))
    bare = counts.where(F.col("to_kind") == "").select(F.col("to_key").alias("key"), F.col("cited").alias("by_key"))
    zero = F.lit(0).cast("long")
    return items.join(full, ["kind", "key"], "left").join(bare, "key", "left").withColumn("inbound", F.coalesce("by_full", zero) + F.coalesce("by_key", zero)).drop("by_full", "by_key")


def inbound_predicates(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, predicate, inbound) for items that are referred to."""
    counts = edges.groupBy(F.col("kind").alias("to_kind"), F.col("key").alias("to_key"), "predicate").agg(F.count("*").alias("cited"))
    names = items.select("kind", "key")
    full = counts.where(F.col("to_kind") != "").select(F.col("to_kind").alias("kind"), F.col("to_key").alias("key"), "predicate", "cited")
    bare = counts.where(F.col("to_kind") == "").select(F.col("to_key").alias("key"), "predicate", "cited")
    both = names.join(full, ["kind", "key"]).unionByName(names.join(bare, "key"))
    return both.groupBy("kind", "key", "predicate").agg(F.sum("cited").alias("inbound"))


def with_salience(items: DataFrame) -> DataFrame:
    return items.withColumn("salience", F.col("n") + F.col("inbound"))


def tier_thresholds(items: DataFrame, score: str = "salience") -> DataFrame:
    """One row (q50, q90, flat): nearest-rank quantiles, element int(q * (n - 1) + 0.5).

    The scores' histogram is ranked, not the items.
    """
    hist = items.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"))
    upto = hist.withColumn("upto", F.sum("c").over(Window.orderBy("s"))).withColumn("n", F.sum("c").over(Window.partitionBy()))

    def least(q: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(q * (F.col("n") - 1) + 0.5), F.col("s")))

    return upto.agg(least(0.5).alias("q50"), least(0.9).alias("q90"), (F.min("s") == F.max("s")).alias("flat"))


def with_tiers(items: DataFrame, score: str = "salience") -> DataFrame:
    """high from the 90th percentile on, mid from the 50th, else tail; all mid if all are equal."""
    t = F.broadcast(tier_thresholds(items, score))  # one row
    tier = F.when(F.col("flat"), F.lit("mid")).when(F.col(score) >= F.col("q90"), F.lit("high")).when(F.col(score) >= F.col("q50"), F.lit("mid")).otherwise(F.lit("tail"))
    return items.crossJoin(t).withColumn("tier", tier).drop("q50", "q90", "flat")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "high", 3).when(tier == "mid", 2).when(tier == "tail", 1).otherwise(0)


def tier_max(rows: DataFrame, by: list[str]) -> DataFrame:
    """The highest tier of each group."""
    top = F.max(tier_rank(F.col("tier")))
    return rows.groupBy(*by).agg(F.when(top == 3, "high").when(top == 2, "mid").when(top == 1, "tail").otherwise("").alias("tier"))


def predicate(columns: dict[str, Column], wanted: dict[str, str]) -> Column:
    """Every field is, whatever the case, one of its comma-separated values; missing is empty."""
    out = F.lit(True)
    for name, values in wanted.items():
        out = out & F.lower(F.coalesce(columns.get(name, F.lit(None)).cast("string"), F.lit(""))).isin(*[v.strip().lower() for v in values.split(",")])
    return out


def key_prefix(columns: list[Column], prefixes: list[str]) -> Column:
    """Some column starts, whatever the case, with some prefix."""
    out = F.lit(False)
    for c in columns:
        for p in prefixes:
            out = out | F.coalesce(F.startswith(F.lower(c), F.lit(p.lower())), F.lit(False))
    return out


def filtered(items: DataFrame, kind: str | None = None, key: str | None = None, where: dict[str, str] | None = None, observer: str | None = None) -> DataFrame:
    test = F.lit(True)
    if kind is not None:
        test = test & (F.col("kind") == kind)
    if key is not None:
        test = test & key_prefix([F.col("key")], key.split(","))
    if where:
        test = test & predicate({c: F.col(c) for c in items.columns}, where)
    if observer is not None:
        test = test & observer_matches(F.col("observer"), F.lit(observer))
    return items.where(test)


def hide_inactive(items: DataFrame, lifecycles: DataFrame, status: str = "status", protect: list[str] = ()) -> DataFrame:
    """Without items whose status isn't among their kind's active ones (kind, active array).

    Kinds without a lifecycle and items without a status stay, and protected keys.
    """
    rows = items.join(F.broadcast(lifecycles), "kind", "left")  # one row a declared kind
    shown = F.col("active").isNull() | F.col(status).isNull() | F.array_contains("active", F.lower(F.col(status)))
    if protect:
        shown = shown | F.col("key").isin(*protect)
    return rows.where(shown).drop("active")


def granularity(key: Column, wanted: str) -> Column:
    return F.when(F.lower(key) == wanted.lower(), F.lit("whole")).otherwise(F.lit("brief"))


def count_by(items: DataFrame, by: str) -> DataFrame:
    return items.groupBy(by).agg(F.count("*").alias("count"))


def budget(items: DataFrame, limit: int | None = None, last: int | None = None, order: str = "pos") -> DataFrame:
    """The ``last`` newest items, or else the ``limit`` most salient; ties keep their order."""
    if last is not None:
        return items.orderBy(F.coalesce("ts", F.lit(0.0)).desc(), order).limit(last)
    if limit is not None:
        return items.orderBy(F.col("salience").desc(), order).limit(limit)
    return items


def salience_window(items: DataFrame, order: str = "pos") -> DataFrame:
    """Items of salience 2 or more; if there are none, the first of the most salient."""
    top = items.orderBy(F.col("salience").desc(), order).limit(1).withColumn("__top", F.lit(True))
    some = items.agg((F.count_if(F.col("salience") >= 2) > 0).alias("__some"))
    rows = items.where(F.col("salience") >= 2).withColumn("__top", F.lit(False)).unionByName(top)
    return rows.crossJoin(F.broadcast(some)).where(F.col("__top") != F.col("__some")).drop("__top", "__some")  # one row


def rollup(items: DataFrame, prefix: str = "") -> DataFrame:
    """Keys under a prefix collapsed to their next slash part: (segment, items, entries, tier)."""
    rest = F.expr(f"substring(key, {len(prefix) + 1})")
    segment = F.when(F.col("key").isNull(), F.lit("(no field)")).otherwise(F.split_part(rest, F.lit("/"), F.lit(1)))
    rows = items.where(F.col("key").isNull() | F.startswith("key", F.lit(prefix))).withColumn("segment", segment)
    top = F.max(tier_rank(F.col("tier")))
    return rows.groupBy("segment").agg(F.count("*").alias("items"), F.sum("n").alias("entries"), F.when(top == 3, "high").when(top == 2, "mid").when(top == 1, "tail").otherwise("").alias("tier"))


def promotion_candidates(members: DataFrame, kinds: list[str], least: int = 3) -> DataFrame:
    """Undeclared fields that hold addresses of declared kinds.

    members: (kind, key, name, value) of folded items; a field qualifies with
    ``least`` values kind:key or kind/key of a declared kind.
    """
    target = F.regexp_extract("value", r"^([^\s:/]+)[:/]\S+$", 1)
    rows = members.withColumn("target", target).where(F.col("target").isin(*kinds))
    found = rows.groupBy("name").agg(F.count("*").alias("facts"), F.count_distinct("target").alias("targets"), F.count_distinct("kind").alias("sources"))
    return found.where(F.col("facts") >= least)


def is_stale(ts: Column, now: float, days: float = 7.0) -> Column:
    return F.coalesce(F.lit(now) - ts > days * 86400, F.lit(False))


def spark_levels(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Each value as one of 8 levels of its group's largest, rounded up; 0 for none."""
    top = F.max(value).over(Window.partitionBy(*by))
    return rows.withColumn("level", F.when((top <= 0) | (F.col(value) <= 0), F.lit(0)).otherwise(F.ceil(F.col(value) * 8 / top)).cast("int"))


def tier_lookup(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Facts with their entity's tier, empty if it isn't shown."""
    return facts.join(items.select("kind", "key", "tier"), ["kind", "key"], "left").withColumn("tier", F.coalesce("tier", F.lit("")))


def review(items: DataFrame) -> DataFrame:
    """A fixed order for comparing two runs."""
    return items.orderBy("kind", F.coalesce("key", F.lit("")))


def namespaces(items: DataFrame, most: int = 2) -> DataFrame:
    """(kind, namespace, items): items by the part of their key before its first slash.

    A kind is left whole (namespace null) where no key has a slash, or those
    without are more than ``most`` times those with one.
    """
    split = F.when(F.contains("key", F.lit("/")), F.split_part("key", F.lit("/"), F.lit(1)))
    per = items.groupBy("kind", split.alias("namespace")).agg(F.count("*").alias("items"))
    kinds = per.groupBy("kind").agg(F.sum(F.when(F.col("namespace").isNotNull(), F.col("items")).otherwise(0)).alias("named"), F.sum("items").alias("all"))
    grouped = (F.col("named") > 0) & (F.col("all") - F.col("named") <= most * F.col("named"))
    marked = per.join(kinds.select("kind", grouped.alias("grouped")), "kind")
    return marked.groupBy("kind", F.when(F.col("grouped"), F.col("namespace")).alias("namespace")).agg(F.sum("items").alias("items"))

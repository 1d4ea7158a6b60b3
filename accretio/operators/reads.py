"""Reads of a log: scans, cursors, lookups, pages, statistics.

All are plans over a facts table; nothing is collected. ``at`` cuts the log at a
receipt position, ``as_of`` at an event time; both still fold in receipt order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import in_kind, observer_matches
from ..functions.values import rounded
from ..schemas import RESERVED, field, in_ranges, visible
from .boundaries import prefix_sum


def at(facts: DataFrame, seq: int) -> DataFrame:
    """The prefix received up to a position."""
    return facts.where(F.col("seq") <= seq)


def as_of(facts: DataFrame, ts: float) -> DataFrame:
    """Facts up to an event time."""
    return facts.where(F.col("ts") <= ts)


def since(facts: DataFrame, cursor: int) -> DataFrame:
    return facts.where(F.col("seq") > cursor).orderBy("seq")


def since_raw(facts: DataFrame, cursor: int) -> DataFrame:
    """Only what a replay needs."""
    return since(facts, cursor).select("seq", "kind", "payload", "ts")


def between(facts: DataFrame, start: float, end: float) -> DataFrame:
    return facts.where(F.col("ts").between(start, end)).orderBy("seq")


def by_kind(facts: DataFrame, kind: str, at_seq: int | None = None, until: float | None = None) -> DataFrame:
    """One kind in fold order."""
    rows = facts.where(F.col("kind") == kind)
    rows = rows if at_seq is None else at(rows, at_seq)
    return (rows if until is None else as_of(rows, until)).orderBy("seq")


def facts_between(facts: DataFrame, start: float | None, end: float | None, kind: str | None = None, internal: bool = False, at_seq: int | None = None) -> DataFrame:
    """A time range of a kind and those below it, in event order."""
    test = F.lit(True)
    if start is not None:
        test = test & (F.col("ts") >= start)
    if end is not None:
        test = test & (F.col("ts") <= end)
    if kind is not None:
        test = test & in_kind(F.col("kind"), kind)
    if at_seq is not None:
        test = test & (F.col("seq") <= at_seq)
    return (facts if internal else visible(facts)).where(test).orderBy("ts", "seq")


def combined(stores: list[DataFrame]) -> DataFrame:
    """Several stores as one log, in (ts, id) order; a single store keeps its receipt order."""
    if len(stores) == 1:
        return stores[0].withColumn("store", F.lit(0))
    both = stores[0].withColumn("store", F.lit(0))
    for n, s in enumerate(stores[1:], 1):
        both = both.unionByName(s.withColumn("store", F.lit(n)), allowMissingColumns=True)
    return both


def by_id(facts: DataFrame, prefix: str, kind: str | None = None) -> DataFrame:
    """The fact of this id, else those whose id starts with it: one row is an answer, two are an ambiguity."""
    rows = facts if kind is None else facts.where(F.col("kind") == kind)
    hits = rows.where(F.startswith("id", F.lit(prefix))).withColumn("exact", F.col("id") == prefix)
    return hits.orderBy(F.col("exact").desc(), "seq").limit(2)


def latest_by_kind(facts: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The last fact of each kind by (ts, id), of those that satisfy ``wanted``."""
    rows = facts if wanted is None else facts.where(wanted)
    return rows.groupBy("kind").agg(F.max_by(F.struct("id", "ts", "seq"), F.struct("ts", "id")).alias("f")).select("kind", "f.*")


def has_kind_since(facts: DataFrame, ts: float) -> DataFrame:
    """For each kind, whether any fact is later."""
    return facts.groupBy("kind").agg(F.bool_or(F.col("ts") > ts).alias("found"))


def recent(facts: DataFrame, kind: str, n: int) -> DataFrame:
    return facts.where(F.col("kind") == kind).orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(n)


def resolve_entity(facts: DataFrame, key: str) -> DataFrame:
    """For each kind and value of a key field: the id received last."""
    rows = facts.withColumn("key", field(facts, key).cast("string")).where(F.col("key").isNotNull())
    return rows.groupBy("kind", "key").agg(F.max_by("id", "seq").alias("id"))


def page(
    facts: DataFrame, limit: int, before: int | None = None, after: int | None = None, newest: bool = True, kind: str | None = None, observer: str | None = None
) -> DataFrame:
    """A page by receipt: cursors are exclusive; each row says whether more would follow.

    One row more than asked for is read to tell, and not returned.
    """
    test = F.lit(True)
    if before is not None:
        test = test & (F.col("seq") < before)
    if after is not None:
        test = test & (F.col("seq") > after)
    if kind is not None:
        test = test & in_kind(F.col("kind"), kind)
    if observer is not None:
        test = test & observer_matches(F.col("observer"), F.lit(observer))
    order = F.col("seq").desc() if newest else F.col("seq").asc()
    probe = visible(facts).where(test).orderBy(order).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(order))  # of at most limit + 1 rows
    return probe.withColumn("place", place).withColumn("truncated", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)


def timeline(facts: DataFrame, ticks: DataFrame, limit: int) -> DataFrame:
    """Facts and ticks by time, facts first on ties: the last ``limit``, each with the whole count."""
    one = facts.select(F.lit("fact").alias("type"), F.col("kind").alias("name"), "ts", F.col("seq").alias("pos"))
    two = ticks.select(F.lit("tick").alias("type"), "name", "ts", F.col("tick_seq").alias("pos"))
    both = one.unionByName(two)
    total = both.agg(F.count("*").alias("total"))
    rank = (F.col("type") == "tick").cast("int")
    shown = both.orderBy(F.col("ts").desc(), rank.desc(), F.col("pos").desc()).limit(limit)
    return shown.crossJoin(F.broadcast(total)).orderBy("ts", rank, "pos")  # one row


def kind_stats(facts: DataFrame, internal: bool = False) -> DataFrame:
    rows = facts if internal else visible(facts)
    return rows.groupBy("kind").agg(F.count("*").alias("count"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


def key_stats(facts: DataFrame, key: str) -> DataFrame:
    """For each kind and value of a key field, facts without one being a group too."""
    rows = facts.withColumn("key", field(facts, key).cast("string"))
    return rows.groupBy("kind", "key").agg(F.count("*").alias("count"), F.max("ts").alias("latest"))


def observer_stats(facts: DataFrame) -> DataFrame:
    return facts.groupBy("observer").agg(F.count("*").alias("count"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


def kind_shares(facts: DataFrame, key: str) -> DataFrame:
    """Each kind's share of all facts in percent, its distinct keys and range."""
    rows = facts.withColumn("key", field(facts, key).cast("string"))
    per = rows.groupBy("kind").agg(F.count("*").alias("count"), F.count_distinct("key").alias("keys"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    return per.withColumn("share", rounded(100 * F.col("count") / F.sum("count").over(Window.partitionBy()), 1))  # one row a kind


def density(facts: DataFrame, start: float, end: float, buckets: int) -> DataFrame:
    """Facts of each kind in equal bins of a time range, the last closed at both ends."""
    span = (end - start) or 1.0
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col("ts") - start) / span * buckets)).cast("int")
    return facts.where(F.col("ts").between(start, end)).groupBy("kind", bucket.alias("bucket")).agg(F.count("*").alias("count"))


def totals(facts: DataFrame, ticks: DataFrame) -> DataFrame:
    """Visible facts, all facts, ticks, signed facts and freshness, in one row."""
    hidden = F.startswith("kind", F.lit(RESERVED))
    signed = F.count("signature") if "signature" in facts.columns else F.lit(0).cast("long")
    one = facts.agg(F.count_if(~hidden).alias("visible"), F.count("*").alias("all_facts"), signed.alias("signed"), F.max(F.when(~hidden, F.col("ts"))).alias("freshness"))
    return one.crossJoin(ticks.agg(F.count("*").alias("ticks")))  # one row each


def summary(facts: DataFrame, ticks: DataFrame) -> DataFrame:
    """Kinds and tick names with count and range."""
    two = ticks.groupBy(F.col("name").alias("kind")).agg(F.count("*").alias("count"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    return kind_stats(facts).withColumn("type", F.lit("fact")).unionByName(two.withColumn("type", F.lit("tick")))


def live_edge(facts: DataFrame, ticks: DataFrame) -> DataFrame:
    """Facts after the newest tick's cursor: how many, and the earliest."""
    cursor = ticks.join(facts.select(F.col("id").alias("fact_cursor"), F.col("seq").alias("sealed")), "fact_cursor").agg(
        F.coalesce(F.max_by("sealed", "tick_seq"), F.lit(0)).alias("sealed")
    )
    after = visible(facts).join(F.broadcast(cursor), F.col("seq") > F.col("sealed"))  # one row
    return after.agg(F.count("*").alias("count"), F.min("ts").alias("earliest"))


def tick_floor(facts: DataFrame, ticks: DataFrame, marks: DataFrame) -> DataFrame:
    """For each mark (mark, ts): the newest tick at or before it, if its cursor is a fact.

    Marks and ticks are put in one order and the last tick carried forward in
    each of a set of time ranges; what a range starts with comes from the ranges
    before it. Neither side is joined with the other's rows.
    """
    good = ticks.join(facts.select(F.col("id").alias("fact_cursor")), "fact_cursor", "left_semi")
    both = good.select("ts", F.lit(0).alias("side"), F.struct("tick_seq", "name", "ts").alias("tick"), F.lit(None).cast("long").alias("mark")).unionByName(
        marks.select("ts", F.lit(1).alias("side"), F.lit(None).cast("struct<tick_seq:bigint,name:string,ts:double>").alias("tick"), F.col("mark").cast("long").alias("mark"))
    )
    ranged = in_ranges(both, "ts", "part")
    order = [F.col("ts"), F.col("side"), F.col("tick.tick_seq")]
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = ranged.groupBy("part").agg(F.max(F.when(F.col("side") == 0, F.struct("ts", "tick.tick_seq", "tick"))).alias("m"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("part", F.last(F.col("m.tick"), ignorenulls=True).over(earlier).alias("carried"))  # one row a range
    filled = ranged.withColumn("own", F.last("tick", ignorenulls=True).over(own)).join(F.broadcast(carried), "part").where(F.col("side") == 1)
    tick = F.coalesce("own", "carried")
    return filled.select("mark", F.col("ts").alias("mark_ts"), tick["tick_seq"].alias("tick_seq"), tick["name"].alias("name"), tick["ts"].alias("tick_ts"))


def late_arrivals(facts: DataFrame, low: int, high: int) -> DataFrame:
    """Facts received in (low, high] that are earlier than what had been seen by ``low``, newest first."""
    seen = at(facts, low).agg(F.max("ts").alias("seen"))
    return facts.where((F.col("seq") > low) & (F.col("seq") <= high)).join(F.broadcast(seen), F.col("ts") < F.col("seen")).orderBy(F.col("seq").desc())


def receipt_ordinals(facts: DataFrame) -> DataFrame:
    """The 1-based ordinal of each fact over all rows in receipt order."""
    from ..schemas import with_receipt

    return with_receipt(facts.withColumnRenamed("seq", "position"), ["position"]).withColumnRenamed("seq", "ordinal")


def receipt_groups(facts: DataFrame) -> DataFrame:
    """Runs of neighbouring receipts of one kind and origin: (kind, origin, first_seq, last_seq, n)."""
    numbered = prefix_sum(facts, F.lit(1), "__number", ["kind", "origin"])
    rows = numbered.withColumn("island", F.col("seq") - F.col("__number"))
    return rows.groupBy("kind", "origin", "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n")).drop("island")


def unfolded_kinds(facts: DataFrame, declared: DataFrame) -> DataFrame:
    """Kinds in the log that no declaration (column kind) folds, with their counts."""
    return visible(facts).groupBy("kind").agg(F.count("*").alias("count")).join(F.broadcast(declared.select("kind").distinct()), "kind", "left_anti")


def prefixes(facts: DataFrame, key: str, limit: int) -> DataFrame:
    """Namespaces (before the first slash) of the newest ``limit`` keys of each kind, with how many keys each has."""
    rows = facts.withColumn("key", field(facts, key).cast("string")).where(F.col("key").isNotNull())
    keys = rows.groupBy("kind", "key").agg(F.max("seq").alias("seq"))
    newest = keys.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("seq").desc()))).where(F.col("r") <= limit)
    return newest.groupBy("kind", F.split_part("key", F.lit("/"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("keys"))


def confluence(facts: DataFrame, key: str) -> DataFrame:
    """What each observer did: facts, kinds, distinct entities touched, first and last."""
    rows = facts.withColumn("key", field(facts, key).cast("string"))
    return rows.groupBy("observer").agg(
        F.count("*").alias("count"),
        F.count_distinct("kind").alias("kinds"),
        F.count_distinct(F.when(F.col("key").isNotNull(), F.struct("kind", "key"))).alias("touched"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def delegation(facts: DataFrame) -> DataFrame:
    """Observers by the part before their first slash."""
    root = F.split_part("observer", F.lit("/"), F.lit(1))
    return facts.groupBy(root.alias("root")).agg(F.count("*").alias("count"), F.count_distinct("observer").alias("observers"))


def fold_diff(before: DataFrame, after: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Entities added, removed or changed between two folds."""
    a = before.select(*on, F.struct(*values).alias("before"))
    b = after.select(*on, F.struct(*values).alias("after"))
    both = a.join(b, on, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), F.lit("added")).when(F.col("after").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    return both.select(*on, change.alias("change"), *[F.col(f"before.{v}").alias(f"{v}_before") for v in values], *[F.col(f"after.{v}").alias(f"{v}_after") for v in values])


def ticks_between(ticks: DataFrame, start: float | None = None, end: float | None = None, name: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Ticks of a time range and name; with facts, each with its cursor fact's place and a preview of it."""
    test = F.lit(True)
    if start is not None:
        test = test & (F.col("ts") >= start)
    if end is not None:
        test = test & (F.col("ts") <= end)
    if name is not None:
        test = test & (F.col("name") == name)
    rows = ticks.where(test)
    if facts is None:
        return rows
    shown = facts.select(F.col("id").alias("fact_cursor"), F.col("seq").alias("cursor_seq"), preview().alias("preview"))
    return rows.join(shown, "fact_cursor", "left")


def preview(size: int = 80) -> Column:
    """A fact in a line: its kind, and the first of message, topic, name and status."""
    said = F.coalesce(*[F.get_json_object("payload", f"$.{m}") for m in ("message", "topic", "name", "status")], F.lit(""))
    return F.substring(F.concat_ws(" ", "kind", F.when(said != "", said)), 1, size)


def position(facts: DataFrame, ticks: DataFrame, address: str) -> DataFrame:
    """(seq): the receipt position an address means.

    head; seq:N, the N-th fact received; fact:PREFIX, the fact whose id begins so;
    tick:ID, that tick's cursor; and a number, the cursor of the newest tick at or
    before that time. No row if it means nothing.
    """
    what, _, rest = address.partition(":")
    if address == "head":
        return facts.agg(F.max("seq").alias("seq")).where(F.col("seq").isNotNull())
    if what == "seq":
        return receipt_ordinals(facts).where(F.col("ordinal") == int(rest)).select(F.col("position").alias("seq"))
    if what == "fact":
        return by_id(facts, rest).limit(1).select("seq")
    places = facts.select(F.col("id").alias("fact_cursor"), "seq")
    if what == "tick":
        return ticks.where(F.col("id") == rest).join(places, "fact_cursor").select("seq")
    floor = ticks.where(F.col("ts") <= float(address)).join(places, "fact_cursor")
    return floor.agg(F.max_by("seq", F.struct("ts", "tick_seq")).alias("seq")).where(F.col("seq").isNotNull())


def cut_summary(facts: DataFrame, upto: int) -> DataFrame:
    """One row on a prefix: its facts, visible facts, kinds, last fact and last time."""
    rows = at(facts, upto)
    hidden = F.startswith("kind", F.lit(RESERVED))
    return rows.agg(F.count("*").alias("facts"), F.count_if(~hidden).alias("visible"), F.count_distinct("kind").alias("kinds"), F.max_by("id", "seq").alias("last_id"), F.max("ts").alias("latest"))


def resolved_references(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` (kind, key, and more) with ``fact_id``: the fact last received of that entity, or null: deferred."""
    return rows.join(resolve_entity(facts, key).withColumnRenamed("id", "fact_id"), ["kind", "key"], "left")


def topology(members: DataFrame, observer: str) -> DataFrame:
    """A ``_topology`` fact for each member vertex (name, path)."""
    return members.select(F.lit("_topology").alias("kind"), F.lit(observer).alias("observer"), F.to_json(F.struct("name", "path")).alias("payload"))

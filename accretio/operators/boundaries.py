"""Boundaries: windows closed by data, and the ticks they emit.

A window ends with the fact that closes it. Counts and window numbers over a kind
are prefix sums; ``prefix_sum`` takes them range by range, so that one kind with
most of the facts isn't numbered by one task.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import rounded
from ..schemas import in_ranges

OPS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "==": operator.eq, "!=": operator.ne}


def prefix_sum(rows: DataFrame, value: Column, out: str, by: list[str], order: str = "seq") -> DataFrame:
    """``rows`` with the sum of ``value`` over each group's rows up to and with this one.

    Ranges of the order are summed each in its own task, then shifted by what
    comes before: a row for each group and range. Nulls in ``by`` are a group.
    """
    ranged = in_ranges(rows.withColumn("__v", value.cast("long")), order, "__part")
    own = Window.partitionBy("__part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy(*by, "__part").agg(F.sum("__v").alias("__t"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "__part", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__before"))
    summed = _joined(ranged.withColumn("__own", F.sum("__v").over(own)), before, [*by, "__part"])
    return summed.withColumn(out, F.col("__own") + F.col("__before")).drop("__v", "__own", "__before", "__part")


def _joined(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of their group, where nulls are equal."""
    theirs = groups.withColumnsRenamed({c: f"__of_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return rows.join(theirs, same).drop(*[f"__of_{c}" for c in by])


def _numbered(facts: DataFrame) -> DataFrame:
    return prefix_sum(facts, F.lit(1), "number", ["kind"])


def every(facts: DataFrame, n: int) -> DataFrame:
    """Facts of each full window of n facts of a kind, with its number ``window``; what isn't full yet is left out."""
    rows = _numbered(facts).withColumn("window", F.floor((F.col("number") - 1) / n))
    counts = rows.groupBy("kind").agg(F.max("number").alias("all"))
    return _joined(rows, counts, ["kind"]).where((F.col("window") + 1) * n <= F.col("all")).drop("all")


def after(facts: DataFrame, n: int) -> DataFrame:
    """The facts of the one window that closes with a kind's n-th fact; none for kinds with fewer."""
    rows = _numbered(facts)
    enough = rows.where(F.col("number") == n).select("kind")  # one row a kind
    return _joined(rows.where(F.col("number") <= n), enough, ["kind"]).withColumn("window", F.lit(0).cast("long"))


def when(facts: DataFrame, closes: Column, by: list[str] = ()) -> DataFrame:
    """Facts with the number of the window they are in; a closing fact is the last of its window.

    ``by`` keeps windows of groups apart. The window that is still open is marked.
    """
    rows = prefix_sum(facts.withColumn("closes", F.coalesce(closes, F.lit(False))), F.col("closes").cast("long"), "__upto", list(by))
    rows = rows.withColumn("window", F.col("__upto") - F.col("closes").cast("long")).drop("__upto")
    ends = rows.groupBy(*by).agg(F.count_if("closes").alias("closed")) if by else rows.agg(F.count_if("closes").alias("closed"))
    joined = _joined(rows, ends, list(by)) if by else rows.crossJoin(F.broadcast(ends))  # one row
    return joined.withColumn("open", F.col("window") >= F.col("closed")).drop("closed")


def matches(payload: Column, wanted: dict[str, str]) -> Column:
    """Every named member is this very text; a number never equals a text."""
    out = F.lit(True)
    for name, value in wanted.items():
        one = F.try_variant_get(F.try_parse_json(payload), f"$['{name}']", "variant")
        out = out & F.coalesce((F.schema_of_variant(one) == "STRING") & (F.get_json_object(payload, f"$['{name}']") == value), F.lit(False))
    return out


def compares(value: Column, op: str, target: float | str) -> Column:
    """A fold state's condition: as numbers if both are, else as text for == and !=; missing is false."""
    try:
        number = float(target)
    except ValueError:
        if op not in ("==", "!="):
            return F.lit(False)
        return F.coalesce(OPS[op](value.cast("string"), F.lit(target)), F.lit(False))
    return F.coalesce(OPS[op](value.cast("double"), F.lit(number)), F.lit(False))


def snapshots(facts: DataFrame, closes: Column, kinds: DataFrame, amount: str) -> DataFrame:
    """At each closing fact: count and sum so far of every kind (column kind). Nothing is reset.

    Totals by window and kind are made first, so the running part has a row for
    each closed window and kind.
    """
    rows = when(facts, closes)
    per = rows.where(~F.col("open")).groupBy("window", "kind").agg(F.count("*").alias("n"), F.sum(amount).alias("amount"))
    ends = rows.where("closes").select("window", F.col("seq").alias("at_seq"), F.col("ts").alias("at_ts"))
    grid = ends.crossJoin(F.broadcast(kinds.select("kind")))  # declared kinds
    upto = Window.partitionBy("kind").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(per, ["window", "kind"], "left").select(
        "window", "kind", "at_seq", "at_ts",
        F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("n"),
        F.sum(F.coalesce("amount", F.lit(0))).over(upto).alias("amount"),
    )


def fires(facts: DataFrame, amount: str, threshold: float, by: str = "kind") -> DataFrame:
    """Ticks of a sum that is set back each time it reaches ``threshold``: (by, tick, since_seq, at_seq, n, amount).

    Where a window ends depends on where the last one did, so each group is one
    ordered pass; it streams through sorted batches and holds three numbers.
    """
    kind = dict(facts.dtypes)[by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for batch in batches:
            for group, seq, value in batch.itertuples(index=False):
                if group != now:
                    now, tick, start, n, total = group, 0, seq, 0, 0.0
                n, total = n + 1, total + value
                if n == 1:
                    start = seq
                if total >= threshold:
                    out.append((group, tick, start, seq, n, total))
                    tick, n, total = tick + 1, 0, 0.0
            if out:
                yield pd.DataFrame(out, columns=[by, "tick", "since_seq", "at_seq", "n", "amount"])
                out = []

    rows = facts.select(by, "seq", F.col(amount).cast("double").alias("amount")).repartition(by).sortWithinPartitions(by, "seq")
    return rows.mapInPandas(run, f"{by} {kind}, tick long, since_seq long, at_seq long, n long, amount double")


def ticks_of(windows: DataFrame, name: Column, by: list[str], amount: str) -> DataFrame:
    """A tick for each closed window: its name, the period [since, ts], the cursor, count and sum."""
    return windows.groupBy(*by, "window").agg(
        F.min("ts").alias("since"), F.max_by("ts", "seq").alias("ts"), F.max_by("id", "seq").alias("fact_cursor"), F.max("seq").alias("at_seq"),
        F.count("*").alias("n"), F.sum(amount).alias("amount"),
    ).withColumn("name", name)


def ticks_as_facts(ticks: DataFrame, observer: str, prefix: str = "tick.") -> DataFrame:
    """Ticks that re-enter a log: kind tick.<name>, observed by their vertex."""
    return ticks.select(F.concat(F.lit(prefix), F.col("name")).alias("kind"), "ts", F.lit(observer).alias("observer"), F.to_json(F.struct("n", "amount", "since")).alias("payload"))


def window_facts(facts: DataFrame, ticks: DataFrame) -> DataFrame:
    """Facts within each tick's [since, ts], shared ends in both.

    Time is cut into hours; a tick is put in each hour it touches and meets only
    the facts of that hour.
    """
    hour = 3600.0
    slots = ticks.select("name", "window", "since", F.col("ts").alias("until"), F.explode(F.sequence(F.floor(F.col("since") / hour), F.floor(F.col("ts") / hour))).alias("hour"))
    rows = facts.withColumn("hour", F.floor(F.col("ts") / hour))
    return rows.join(slots, "hour").where((F.col("ts") >= F.col("since")) & (F.col("ts") <= F.col("until"))).drop("hour")


def window_stats(facts: DataFrame, ticks: DataFrame, key: str) -> DataFrame:
    """For each tick: facts in its period, kinds, and distinct keys touched."""
    inside = window_facts(facts, ticks)
    return inside.groupBy("name", "window").agg(F.count("*").alias("facts"), F.count_distinct("kind").alias("kinds"), F.count_distinct(key).alias("keys"))


def tick_deltas(windows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """For each window against the one before: keys that are new, and keys that are there again."""
    keys = windows.groupBy(*by, "window", key).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*by, key).orderBy("window")
    seen = keys.withColumn("prior", F.lag("window").over(earlier))
    counted = seen.groupBy(*by, "window").agg(F.count("*").alias("keys"), F.count_if(F.col("prior").isNull()).alias("added"), F.count_if(F.col("prior").isNotNull()).alias("updated"), F.sum("n").alias("facts"))
    return counted.withColumn("compression", rounded(F.col("facts") / F.col("keys"), 1))


def horizon(facts: DataFrame, ticks: DataFrame, by: str = "kind") -> DataFrame:
    """For each group: facts strictly after its last tick, and when that was; never sealed groups count all."""
    last = ticks.groupBy(by).agg(F.max("at_seq").alias("sealed_seq"), F.max_by("ts", "at_seq").alias("sealed_ts"))
    rows = facts.join(last, by, "left").where(F.col("sealed_seq").isNull() | (F.col("seq") > F.col("sealed_seq")))
    return rows.groupBy(by).agg(F.count("*").alias("open_facts"), F.max("sealed_seq").alias("sealed_seq"), F.min("ts").alias("open_since"))

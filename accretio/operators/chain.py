"""The tick chain: window hashes, commitments, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_hashes(facts: DataFrame, windows: DataFrame, row: Column) -> DataFrame:
    """(tick_seq, n, window_hash): SHA-256 over the row hashes of (first, last] in receipt order.

    windows: (tick_seq, first, last), not overlapping and in order. Long windows
    are hashed in stretches of STRETCH facts, and the stretches' hashes together,
    so no task holds a whole window.
    """
    hashed = facts.select("seq", row.alias("h"))
    joined = hashed.join(windows.select("tick_seq", "first", "last", F.explode(F.sequence(F.expr(f"(first + 1) div {STRETCH}"), F.expr(f"last div {STRETCH}"))).alias("stretch")), F.expr(f"seq div {STRETCH}") == F.col("stretch"))
    inside = joined.where((F.col("seq") > F.col("first")) & (F.col("seq") <= F.col("last")))

    def together(key: str, value: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ""), 256)

    parts = inside.groupBy("tick_seq", "stretch").agg(together("seq", "h").alias("part"), F.count("*").alias("n"))
    return parts.groupBy("tick_seq").agg(F.sum("n").alias("n"), together("stretch", "part").alias("window_hash"))


#: Facts hashed together at most.
STRETCH = 1000


def tick_hash() -> Column:
    """What the next tick commits to."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("tick_seq", "name", "fact_cursor", "window_hash", "prev_hash")]
    return F.sha2(F.concat_ws("|", *shown), 256)


def chained(ticks: DataFrame) -> DataFrame:
    """Ticks with prev_hash: each depends on the one before, so each chain (origin) is one ordered pass.

    Ticks are far fewer than facts; the pass streams and holds one hash.
    """
    import hashlib
    from collections.abc import Iterator

    import pandas as pd

    columns = ["origin", "tick_seq", "name", "fact_cursor", "window_hash"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, ""
        for batch in batches:
            out = []
            for row in batch[columns].itertuples(index=False):
                if row.origin != now:
                    now, last = row.origin, ""
                out.append(last or None)
                shown = [str(row.tick_seq), row.name, row.fact_cursor or "", row.window_hash or "", last]
                last = hashlib.sha256("|".join(shown).encode()).hexdigest()
            yield batch.assign(prev_hash=out)[[*columns, "prev_hash"]]

    rows = ticks.select(*columns).repartition("origin").sortWithinPartitions("origin", "tick_seq")
    return rows.mapInPandas(run, "origin string, tick_seq long, name string, fact_cursor string, window_hash string, prev_hash string")


def verified(ticks: DataFrame) -> DataFrame:
    """(origin, tick_seq, problem) where a tick doesn't commit to the one before it, or is unsigned after a signed one."""
    order = Window.partitionBy("origin").orderBy("tick_seq")
    rows = ticks.withColumn("own", tick_hash())
    rows = rows.withColumn("wanted", F.lag("own").over(order))
    signed = F.col("signature").isNotNull() if "signature" in ticks.columns else F.lit(False)
    before = F.max(signed).over(order.rowsBetween(Window.unboundedPreceding, -1))
    problem = F.when(~F.col("prev_hash").eqNullSafe(F.col("wanted")), F.lit("chain")).when(F.coalesce(before, F.lit(False)) & ~signed, F.lit("unsigned"))
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("origin", "tick_seq", "problem")


def signature_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("observer").agg(F.count("signature").alias("signed"), F.count_if(F.col("signature").isNull()).alias("unsigned"))

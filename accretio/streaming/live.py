"""Streams of facts: stateful boundaries, incremental folds, change diffs.

A stream has the columns of a facts table. Nothing is dropped for being late: a
late fact folds where it is received, so there are no watermarks on this path.
Facts of one micro-batch are put in receipt order inside the operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Spec, merged, scalars
from ..operators.reads import fold_diff


def counted_ticks(stream: DataFrame, n: int, amount: str, reset: bool = True) -> DataFrame:
    """A tick each n facts of a kind: (kind, tick, since_seq, at_seq, n, amount).

    With ``reset`` a tick's count and sum start anew; without, they go on, and
    only the period starts anew. The state of a kind is five numbers.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tick, start, held, count, total = state.get if state.exists else (0, -1, 0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, value in rows[["seq", "amount"]].itertuples(index=False):
            start = seq if start < 0 else start
            held, count, total = held + 1, count + 1, total + value
            if held == n:
                out.append((key[0], tick, int(start), int(seq), int(count), float(total)))
                tick, start, held = tick + 1, -1, 0
                if reset:
                    count, total = 0, 0.0
        state.update((int(tick), int(start), int(held), int(count), float(total)))
        yield pd.DataFrame(out, columns=["kind", "tick", "since_seq", "at_seq", "n", "amount"])

    rows = stream.select("kind", "seq", F.col(amount).cast("double").alias("amount"))
    return rows.groupBy("kind").applyInPandasWithState(
        run, "kind string, tick long, since_seq long, at_seq long, n long, amount double",
        "tick long, start long, held long, count long, total double", "append", GroupStateTimeout.NoTimeout,
    )


def running_fold(stream: DataFrame, spec: Spec, by: list[str] = ("kind",)) -> DataFrame:
    """Scalar folds of all facts so far, by Spark's own streaming aggregation (complete or update mode)."""
    return scalars(stream, spec, list(by))


def follow(stream: DataFrame, spec: Spec, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, DataFrame], None], values: list[str]):
    """A foreachBatch function: fold each batch onto the last state and hand over state and changes.

    read gives the last state, or None at first; write gets the new state and the
    entities that were added or changed, and must make both durable before it returns.
    """

    def batch(facts: DataFrame, number: int) -> None:
        before = read()
        part = scalars(facts, spec)
        after = part if before is None else merged(before, part, spec)
        empty = after.limit(0)
        write(after, fold_diff(empty if before is None else before, after, ["kind"], values))

    return stream.writeStream.foreachBatch(batch)


def tapped(stream: DataFrame, only=None, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A tap: facts that pass a test, as they are or changed."""
    rows = stream if only is None else stream.where(only)
    return change(rows) if change else rows


def followed_log(spark, path: str) -> DataFrame:
    """Complete lines of a growing folder of logs, as they come."""
    return spark.readStream.text(path).withColumnRenamed("value", "text")


def to_log(rows: DataFrame, path: str, checkpoint: str):
    """Facts of a stream as lines of a log folder; the checkpoint makes each line appear once."""
    from ..sources.records import fact_lines

    return fact_lines(rows).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")

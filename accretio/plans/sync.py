"""Running a vertex's sources: what is due, in the order of its needs, and the facts that say so.

The driver decides and starts; reading, parsing and appending are Spark jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ingress import FileSource, due
from .declarations import tiers


@dataclass(frozen=True)
class Scheduled:
    """A source with its cadence: always, elapsed by an interval, or triggered by kinds."""

    source: FileSource
    cadence: str = "always"
    interval: float = 0.0
    triggers: tuple[str, ...] = ()


def plan(facts: DataFrame, sources: list[Scheduled], now: float) -> list[list[Scheduled]]:
    """The sources that are due, in tiers: one that another's kind triggers comes after it."""
    kinds = {s.source.kind: s for s in sources}
    ready = {k for k, s in kinds.items() if due(facts, k, s.cadence, s.interval, now, list(s.triggers)).first()["due"]}
    needs = {k: [t for t in kinds[k].triggers if t in ready] for k in ready}
    return [[kinds[k] for k in tier] for tier in tiers(needs)]


def run(spark: SparkSession, facts: DataFrame, sources: list[Scheduled], now: float, append: Callable[[DataFrame], None]) -> list[tuple[str, str]]:
    """Read what is due and hand it to ``append``, then a ``_sync.<kind>`` fact: (kind, status) of each.

    A source that fails is noted and doesn't stop the others of its tier.
    """
    said = []
    for tier in plan(facts, sources, now):
        for s in tier:
            try:
                append(s.source.read(spark).withColumn("ts", F.coalesce("ts", F.lit(now))))
                status = "ok"
            except Exception as e:  # noqa: BLE001  whatever a source meets is its status
                status = f"failed: {type(e).__name__}"
            note = spark.range(1).select(
                F.lit(f"_sync.{s.source.kind}").alias("kind"), F.lit("sync").alias("observer"), F.lit("").alias("origin"), F.lit(now).alias("ts"),
                F.to_json(F.struct(F.lit(status).alias("status"))).alias("payload"),
            )
            append(note)
            said.append((s.source.kind, status))
    return said


def program(text: str):
    """A declaration's text as its vertex and its specs by kind."""
    from .declarations import vertex

    v = vertex(text)
    return v, v.specs()

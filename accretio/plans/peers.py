"""Peers and members: what an observer may see and say, and which members take a fact.

peers: (observer, horizon, potential), arrays of kinds; null is everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import routed

SIDES = ("horizon", "potential")


def _changed(peers: DataFrame, more: DataFrame, change) -> DataFrame:
    named = more.select("observer", *[F.col(s).alias(f"__{s}") for s in SIDES])
    rows = peers.join(named, "observer", "left")
    return rows.select("observer", *[F.sort_array(change(F.col(s), F.col(f"__{s}"))).alias(s) for s in SIDES])


def granted(peers: DataFrame, more: DataFrame) -> DataFrame:
    """Peers with further kinds; everything stays everything, and null adds nothing."""

    def change(has: Column, adds: Column) -> Column:
        return F.when(has.isNotNull(), F.array_union(has, F.coalesce(adds, F.array().cast("array<string>"))))

    return _changed(peers, more, change)


def restricted(peers: DataFrame, to: DataFrame) -> DataFrame:
    """Peers with only the kinds named; null restricts nothing."""
    return _changed(peers, to, lambda has, only: F.when(only.isNull(), has).when(has.isNull(), only).otherwise(F.array_intersect(has, only)))


def delegated(peers: DataFrame, names: DataFrame) -> DataFrame:
    """Peers of peers (observer, child): named observer/child, with what their parent has."""
    return peers.join(names, "observer").select(F.concat_ws("/", "observer", "child").alias("observer"), *SIDES)


def sayable(facts: DataFrame, peers: DataFrame) -> DataFrame:
    """Facts of kinds within their observer's potential; observers that aren't peers say nothing."""
    may = peers.select("observer", "potential")
    allowed = F.col("potential").isNull() | F.array_contains("potential", F.col("kind"))
    return facts.join(may, "observer").where(allowed).select(*facts.columns)


@dataclass(frozen=True)
class Member:
    """A vertex below another: kinds it folds or closes by, routes (pattern, kind), and its own members."""

    name: str
    kinds: tuple[str, ...] = ()
    routes: tuple[tuple[str, str], ...] = ()
    members: tuple[Member, ...] = ()

    def takes(self, kind: Column) -> Column:
        own = kind.isin(*self.kinds) | routed(kind, list(self.routes), []).isNotNull()
        for member in self.members:
            own = own | member.takes(kind)
        return own


def forwarded(facts: DataFrame, members: tuple[Member, ...], maker: str | None = None) -> DataFrame:
    """``facts`` once for each member that takes their kind, at any depth: column member, a path of names.

    maker: a column with the member that made the fact, which doesn't get it
    back. The declared members only make expressions; the facts are read once.
    """

    def below(level: tuple[Member, ...], path: str, open_: Column) -> list[Column]:
        out = []
        for m in level:
            got = open_ & m.takes(F.col("kind"))
            if maker:
                got = got & ~F.col(maker).eqNullSafe(F.lit(m.name))
            out += [F.when(got, F.lit(path + m.name)), *below(m.members, f"{path}{m.name}/", got)]
        return out

    gets = below(members, "", F.lit(True))
    return facts.withColumn("member", F.explode(F.array_compact(F.array(*gets)))) if gets else facts.withColumn("member", F.lit("")).where(F.lit(False))

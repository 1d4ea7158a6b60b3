"""The primary read: a declaration over a log, as items, scalars and unfolded kinds.

Each declared kind is a plan of its own over the facts of that kind, a filter that
reaches the scan; the plans are united, so that one job reads them all. ``at``
cuts by receipt and ``as_of`` by time; both may not be given. A folded log of
several stores is put into (ts, id) order first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import observer_matches, routed
from ..functions.values import tokens
from ..operators import folds, reads
from ..operators.folds import Collect, Spec, Tail, TopN, Upsert
from ..schemas import with_receipt
from .declarations import Vertex

ITEMS = "kind string, target string, fold string, key string, pos long, n long, payload string, refs array<string>"
SCALARS = "kind string, target string, value double"


def cut(facts: DataFrame, at: int | None = None, as_of: float | None = None, observer: str | None = None) -> DataFrame:
    if at is not None and as_of is not None:
        raise ValueError("at and as_of exclude each other")
    rows = facts if at is None else reads.at(facts, at)
    rows = rows if as_of is None else reads.as_of(rows, as_of)
    return rows if observer is None else rows.where(observer_matches(F.col("observer"), F.lit(observer)))


def combined(stores: list[DataFrame], vertex: Vertex | None = None) -> DataFrame:
    """Several stores as one log in (ts, id) order; kinds go to their parent's or route's fold."""
    both = reads.combined(stores)
    if len(stores) > 1:
        both = with_receipt(both.drop("seq"), ["ts", "id"])
    if vertex is None:
        return both
    head = F.split_part("kind", F.lit("."), F.lit(1))
    own = routed(F.col("kind"), vertex.routes, list(vertex.kinds))
    return both.withColumn("kind", F.coalesce(own, F.when(head.isin(*vertex.kinds), head), F.col("kind")))


def scalars(facts: DataFrame, specs: dict[str, Spec]) -> DataFrame:
    """(kind, target, value) of all scalar folds, and their counters."""
    parts = []
    for kind, spec in specs.items():
        if not spec.scalars():
            continue
        wide = folds.scalars(facts.where(F.col("kind") == kind), spec)
        names = [c for c in wide.columns if c != "kind"]
        parts.append(wide.select("kind", F.explode(F.array(*[F.struct(F.lit(n).alias("target"), F.col(n).cast("double").alias("value")) for n in names])).alias("s")).select("kind", "s.*"))
    return reduce(DataFrame.unionByName, parts) if parts else facts.sparkSession.createDataFrame([], SCALARS)


def _items(facts: DataFrame, kind: str, fold) -> DataFrame | None:
    rows = facts.where(F.col("kind") == kind)
    none = F.lit(None).cast("string")
    match fold:
        case Upsert(target, _):
            found = folds.upsert(rows, fold)
            return found.select("kind", F.lit(target).alias("target"), F.lit("by").alias("fold"), "key", F.col("first_seq").alias("pos"), "n", F.to_json("fields").alias("payload"), "refs")
        case Collect(target, _):
            found = folds.collect(rows, fold)
            bare = F.to_json(F.map_filter(tokens(F.col("payload")), lambda k, _: k != "ref"))
            return found.select("kind", F.lit(target).alias("target"), F.lit("collect").alias("fold"), none.alias("key"), F.col("seq").alias("pos"), F.lit(1).cast("long").alias("n"), bare.alias("payload"), "refs")
        case Tail(target, _, _):
            found = folds.tail(rows, fold)
            refs = F.array().cast("array<string>").alias("refs")
            return found.select("kind", F.lit(target).alias("target"), F.lit("window").alias("fold"), none.alias("key"), F.col("pos").cast("long").alias("pos"), F.lit(1).cast("long").alias("n"), F.to_json(F.struct(F.col(target).cast("string").alias("value"))).alias("payload"), refs)
        case TopN(target, _, by, _, _):
            found = folds.top_n_exact(rows, fold)
            refs = F.array().cast("array<string>").alias("refs")
            return found.select("kind", F.lit(target).alias("target"), F.lit("top").alias("fold"), "key", F.col("pos").cast("long").alias("pos"), F.lit(1).cast("long").alias("n"), F.to_json(F.struct(F.col("by_value").alias(by))).alias("payload"), refs)
    return None


def items(facts: DataFrame, specs: dict[str, Spec]) -> DataFrame:
    """A row for each entity or kept fact of all folds that keep rows."""
    parts = [part for kind, spec in specs.items() for f in spec.folds if (part := _items(facts, kind, f)) is not None]
    return reduce(DataFrame.unionByName, parts) if parts else facts.sparkSession.createDataFrame([], ITEMS)


def fold(facts: DataFrame, vertex: Vertex, at: int | None = None, as_of: float | None = None, observer: str | None = None, kind: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, scalars, unfolded): the state of a vertex at a cursor, and the kinds it doesn't fold.

    ``kind`` narrows what is folded; a kind is unfolded only if none of the declaration folds it.
    """
    rows = cut(facts, at, as_of, observer)
    every = vertex.specs()
    specs = {k: s for k, s in every.items() if kind in (None, k)}
    declared = rows.sparkSession.createDataFrame([(k,) for k in every], "kind string")
    return items(rows, specs), scalars(rows, specs), reads.unfolded_kinds(rows, declared)

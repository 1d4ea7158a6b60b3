"""What a vertex's boundaries do together, over one log.

``live`` gives the ticks of facts as they come in, at most one a fact: a kind's
count goes before the vertex's boundaries, and those before what closes a kind.
``pending`` gives those that are due when a log was only replayed: conditions are
held against the state of the whole log, each kind closes once, and a vertex's
boundary ends the look. ``snapshot`` is a tick by hand.

Whether a fact closes anything is a condition on its row, and its number in its
kind a prefix sum. Only kinds whose closing depends on their own state since they
last closed are an ordered pass, one a kind, with a few numbers for its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import boundaries as b
from ..operators.folds import Avg, Count, Fold, Latest, Max, Min, Sum, numeric
from . import read
from .declarations import Boundary, DeclarationError, Vertex

TICK = ["seq", "id", "ts", "name", "rule"]


def _closes(boundary: Boundary) -> Column:
    return (F.col("kind") == boundary.kind) & b.matches(F.col("payload"), boundary.match)


def _closers(v: Vertex) -> dict[str, tuple[str, Boundary]]:
    """By the closing kind: the kind it closes and how. The last declared counts."""
    return {k.boundary.kind: (k.name, k.boundary) for k in v.kinds.values() if k.boundary and k.boundary.mode == "when"}


def _any(tests: list[Column]) -> Column:
    return F.coalesce(reduce(Column.__or__, tests, F.lit(False)), F.lit(False))


def live(facts: DataFrame, v: Vertex) -> DataFrame:
    """(seq, id, ts, name, rule): the ticks of all facts in receipt order.

    ``rule`` is count, vertex or when; ``name`` the kind that closed, or the vertex.
    A kind is set back when it closes, and a fact is folded before it closes anything.
    A fact that closed something by an earlier rule closes nothing by a later one.
    """
    counts = {k.name: k.boundary for k in v.kinds.values() if k.boundary and k.boundary.mode != "when"}
    rows = facts
    full = F.lit(False)
    if counts:
        rows = b.prefix_sum(facts, F.lit(1), "__number", ["kind"])
        nth = F.col("__number")
        full = _any([(F.col("kind") == k) & (nth % c.count == 0 if c.mode == "every" else nth == c.count) for k, c in counts.items()])
    whole = _any([_closes(x) for x in v.boundaries])
    plain = {k: (loop, x) for k, (loop, x) in _closers(v).items() if not x.conditions}
    loop = F.coalesce(*[F.when(_closes(x), F.lit(name)) for name, x in plain.values()], F.lit(None).cast("string"))
    rule = F.when(full, "count").when(whole, "vertex").when(loop.isNotNull(), "when")
    name = F.when(full, F.col("kind")).when(whole, F.lit(v.name)).otherwise(loop)
    ruled = rows.withColumn("name", name).withColumn("rule", rule)
    out = ruled.where(F.col("rule").isNotNull()).select(TICK)
    held = [(loop, x) for loop, x in _closers(v).values() if x.conditions]
    return out.unionByName(_conditional(ruled, v, held)) if held else out


def _conditional(ruled: DataFrame, v: Vertex, held: list[tuple[str, Boundary]]) -> DataFrame:
    """Ticks of kinds that close on their own state; one ordered, streaming pass a kind."""
    plans = {}
    concerns = []
    for loop, boundary in held:
        folds = [f for f in v.kinds[loop].folds if f.target in {c[0] for c in boundary.conditions}]
        for f in folds:
            if not isinstance(f, Count | Latest | Sum | Min | Max | Avg):
                raise DeclarationError(f"{loop}: {f.target} isn't a number to hold against a condition")
        plans[loop] = (folds, boundary.conditions)
        values = [F.col("ts") if isinstance(f, Latest) else F.lit(1.0) if isinstance(f, Count) else numeric(ruled, f.field)[0].cast("double") for f in folds]
        folded, may = F.col("kind") == loop, F.coalesce(_closes(boundary), F.lit(False)) & F.col("rule").isNull()
        reset = F.coalesce((F.col("rule") == "count") & (F.col("name") == loop), F.lit(False))
        one = F.struct(F.lit(loop).alias("loop"), folded.alias("folded"), may.alias("may"), reset.alias("reset"), F.array(*values).alias("values"))
        concerns.append(F.when(folded | may, one))
    each = ruled.select("seq", "id", "ts", F.explode(F.filter(F.array(*concerns), lambda x: x.isNotNull())).alias("x")).select("seq", "id", "ts", "x.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = state = folds = conditions = None
        for batch in batches:
            out = []
            for seq, id_, ts, loop, folded, may, reset, values in batch.itertuples(index=False):
                if loop != now:
                    now, (folds, conditions) = loop, plans[loop]
                    state = [_start(f) for f in folds]
                if folded:
                    state = [_step(f, s, x) for f, s, x in zip(folds, state, values)]
                fires = may and all(_holds(_value(folds, state, target), op, wanted) for target, op, wanted in conditions)
                if fires:
                    out.append((seq, id_, ts, loop, "when"))
                if fires or reset:
                    state = [_start(f) for f in folds]
            yield pd.DataFrame(out, columns=TICK)

    kinds = dict(ruled.dtypes)
    schema = f"seq {kinds['seq']}, id {kinds['id']}, ts {kinds['ts']}, name string, rule string"
    return each.repartition("loop").sortWithinPartitions("loop", "seq").mapInPandas(run, schema)


def _start(f: Fold) -> tuple:
    """A fold's state before any fact: what it holds, and of how many values."""
    return (None if isinstance(f, Latest) else f.seed if isinstance(f, Min | Max) else 0.0), 0


def _step(f: Fold, state: tuple, x: float) -> tuple:
    now, n = state
    if pd.isna(x):
        return state
    if isinstance(f, Latest):
        return x, n + 1
    if isinstance(f, Min | Max):
        return (x if now is None else min(now, x) if isinstance(f, Min) else max(now, x)), n + 1
    return now + x, n + 1


def _value(folds: list[Fold], state: list[tuple], target: str) -> float | None:
    for f, (now, n) in zip(folds, state):
        if f.target == target:
            return now / n if isinstance(f, Avg) and n else now
    return None


def _holds(value: float | None, op: str, wanted: str) -> bool:
    """As ``boundaries.compares``, of one number."""
    if value is None:
        return False
    try:
        return b.OPS[op](value, float(wanted))
    except ValueError:
        return op == "!="


def pending(facts: DataFrame, v: Vertex, ticks: DataFrame | None = None) -> DataFrame:
    """(seq, id, ts, name, rule): ticks due for the facts since the last of ``ticks`` (seq, ts).

    Counts aren't looked at. Facts of the last tick's very time are looked at again
    only if both the vertex and kinds have boundaries; where only the vertex has
    them, a microsecond is allowed for.
    """
    closers = _closers(v)
    rows = facts
    if ticks is not None:
        last = ticks.agg(F.max_by("ts", "seq").alias("__since"))  # one row
        since = F.col("__since")
        later = F.col("ts") > since if not v.boundaries else F.col("ts") >= since if closers else F.col("ts") > since + 1e-6
        rows = facts.crossJoin(F.broadcast(last)).where(since.isNull() | later)
    first = F.min_by(F.struct("seq", "id", "ts"), "seq").alias("f")
    whole = rows.where(_any([_closes(x) for x in v.boundaries])).agg(first).where("f is not null").select("f.*", F.lit(v.name).alias("name"), F.lit("vertex").alias("rule"))
    if not closers:
        return whole
    loop = F.coalesce(*[F.when(_closes(x), F.lit(name)) for name, x in closers.values()])
    vertex_kind = F.col("kind").isin([x.kind for x in v.boundaries])
    ones = rows.where(loop.isNotNull() & ~vertex_kind).groupBy(loop.alias("name")).agg(first).select("f.*", "name", F.lit("when").alias("rule"))
    conditions = [(name, *c) for name, x in closers.values() for c in x.conditions]
    if conditions:
        ones = ones.join(_unheld(facts, v, conditions), "name", "left_anti")
    end = whole.agg(F.min("seq").alias("__end"))  # one row
    before = ones.crossJoin(F.broadcast(end)).where(F.col("__end").isNull() | (F.col("seq") < F.col("__end")))
    return before.select(TICK).unionByName(whole.select(TICK))


def _unheld(facts: DataFrame, v: Vertex, conditions: list[tuple[str, str, str, str]]) -> DataFrame:
    """Kinds (name) a condition of which the whole log's state doesn't meet: a row a condition at most."""
    specs = {k: s for k, s in v.specs().items() if k in {c[0] for c in conditions}}
    starts = {(k, f.target): _start(f)[0] for k, s in specs.items() for f in s.scalars()}
    asked = facts.sparkSession.createDataFrame([(i, k, t, starts.get((k, t))) for i, (k, t, _, _) in enumerate(conditions)], "i int, kind string, target string, start double")
    state = asked.join(read.scalars(facts, specs), ["kind", "target"], "left").withColumn("now", F.coalesce("value", "start"))
    holds = F.coalesce(*[F.when(F.col("i") == i, b.compares(F.col("now"), op, wanted)) for i, (_, _, op, wanted) in enumerate(conditions)])
    return state.where(~holds).select(F.col("kind").alias("name")).distinct()


def snapshot(facts: DataFrame, v: Vertex, name: str, ts: float) -> DataFrame:
    """A tick by hand: every scalar of every kind's state, (name, ts, origin, kind, target, value). Nothing is set back."""
    return read.scalars(facts, v.specs()).select(F.lit(name).alias("name"), F.lit(ts).alias("ts"), F.lit(v.name).alias("origin"), "kind", "target", "value")

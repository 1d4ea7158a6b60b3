"""The folds: how a kind's facts accumulate, in receipt order.

Scalar folds become aggregate columns, so that one pass over the facts, combined
before the shuffle, makes all of a spec's scalars for all groups. Folds that keep
rows (collect, window, upsert, top-n) return rows. Nothing here sorts a group in
memory: the last of something is a max_by, the last n a bounded rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field as default

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import reference_list
from ..functions.values import is_rejected, key_text, member, number, parsed, tokens
from ..schemas import field, typed
from .boundaries import prefix_sum


@dataclass(frozen=True)
class Latest:
    target: str


@dataclass(frozen=True)
class Count:
    target: str


@dataclass(frozen=True)
class Sum:
    target: str
    field: str


@dataclass(frozen=True)
class Min:
    target: str
    field: str
    seed: float | None = 0


@dataclass(frozen=True)
class Max:
    target: str
    field: str
    seed: float | None = 0


@dataclass(frozen=True)
class Avg:
    target: str
    field: str


@dataclass(frozen=True)
class Collect:
    target: str
    max: int = 0


@dataclass(frozen=True)
class Upsert:
    target: str
    key: str


@dataclass(frozen=True)
class TopN:
    target: str
    key: str
    by: str
    n: int
    desc: bool = True


@dataclass(frozen=True)
class Tail:
    """The sliding window fold: the last ``size`` values of a field."""

    target: str
    field: str
    size: int


Fold = Latest | Count | Sum | Min | Max | Avg | Collect | Upsert | TopN | Tail
SCALARS = (Latest, Count, Sum, Min, Max, Avg)


@dataclass(frozen=True)
class Spec:
    """A kind's folds. One state has all of their targets."""

    name: str
    folds: tuple[Fold, ...] = default(default_factory=tuple)

    def scalars(self) -> list[Fold]:
        return [f for f in self.folds if isinstance(f, SCALARS)]


def numeric(facts: DataFrame, name: str) -> tuple[Column, Column]:
    """The numeric value, and whether it is to be counted as rejected."""
    if typed(facts, name):
        kind = dict(facts.dtypes)[name]
        if kind in ("string", "boolean"):
            return F.lit(None).cast("double"), F.col(name).isNotNull()
        return F.col(name), F.lit(False)
    value = member(parsed(F.col("payload")), name)
    return number(value), is_rejected(value)


def scalar_columns(facts: DataFrame, fold: Fold) -> list[Column]:
    """The aggregate columns of one scalar fold: its target, and counters beside it."""
    match fold:
        case Count(target):
            return [F.count("*").alias(target)]
        case Latest(target):
            return [F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("seq"))).alias(target), F.count_if(F.col("ts").isNull()).alias(f"{target}_rejected")]
        case Sum(target, name):
            value, bad = numeric(facts, name)
            return [F.coalesce(F.sum(value), F.lit(0)).alias(target), F.count_if(bad).alias(f"{target}_rejected")]
        case Min(target, name, seed):
            value, bad = numeric(facts, name)
            least = F.min(value) if seed is None else F.least(F.lit(seed), F.min(value))
            return [least.alias(target), F.count_if(bad).alias(f"{target}_rejected")]
        case Max(target, name, seed):
            value, bad = numeric(facts, name)
            most = F.max(value) if seed is None else F.greatest(F.lit(seed), F.max(value))
            return [most.alias(target), F.count_if(bad).alias(f"{target}_rejected")]
        case Avg(target, name):
            value, bad = numeric(facts, name)
            return [
                F.coalesce(F.avg(value), F.lit(0.0)).alias(target),
                F.coalesce(F.sum(value).cast("double"), F.lit(0.0)).alias(f"{target}_sum"),
                F.count(value).alias(f"{target}_count"),
                F.count_if(bad).alias(f"{target}_rejected"),
            ]
    raise ValueError(f"no scalar fold: {fold}")


def scalars(facts: DataFrame, spec: Spec, by: list[str] = ("kind",)) -> DataFrame:
    """All scalar folds of ``spec`` in one aggregation, a row for each group of ``by``."""
    columns = [c for f in spec.scalars() for c in scalar_columns(facts, f)]
    return facts.groupBy(*by).agg(*columns)


def ordered_sum(facts: DataFrame, name: str, by: list[str] = ("kind",)) -> DataFrame:
    """A float sum taken strictly in receipt order, bit for bit as a running total.

    For groups that fit a task; ``Sum`` is the one for the rest.
    """
    value, _ = numeric(facts, name)
    rows = F.array_sort(F.collect_list(F.struct("seq", value.cast("double").alias("v"))))
    return facts.groupBy(*by).agg(F.aggregate(rows, F.lit(0.0), lambda a, x: a + F.coalesce(x["v"], F.lit(0.0))).alias("total"))


def _last(rows: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The last n rows of each group by receipt, numbered from the oldest kept.

    The rank is bounded, so Spark keeps n rows a group before it shuffles. With n 0
    all rows stay, numbered range by range.
    """
    if not n:
        return prefix_sum(rows, F.lit(1), "pos", by)
    ranked = rows.withColumn("__back", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("seq").desc())))
    kept = ranked.where(F.col("__back") <= n)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).drop("__back")


def collect(facts: DataFrame, fold: Collect, by: list[str] = ("kind",)) -> DataFrame:
    """Kept facts with their position, and refs: the references taken out of the payload."""
    refs = reference_list(F.coalesce(field(facts, "ref"), F.lit("")).cast("string"))
    return _last(facts, fold.max, list(by)).withColumn("refs", refs)


def tail(facts: DataFrame, fold: Tail, by: list[str] = ("kind",)) -> DataFrame:
    """The last values of the field that aren't null, of any type, with their position."""
    rows = facts.select(*by, "seq", field(facts, fold.field).alias(fold.target)).where(F.col(fold.target).isNotNull())
    return _last(rows, fold.size, list(by))


def _key(facts: DataFrame, name: str) -> Column:
    if typed(facts, name):
        return F.col(name).cast("string")
    return key_text(member(parsed(F.col("payload")), name), F.element_at(tokens(F.col("payload")), name))


def upsert_fields(facts: DataFrame, fold: Upsert, fields: list[str], by: list[str] = ("kind",)) -> DataFrame:
    """One row a key, for known fields as columns: the last value present, and n facts.

    A null counts as absent here; ``upsert`` tells absent from null.
    """
    rows = facts.withColumn("key", _key(facts, fold.key)).where(F.col("key").isNotNull())
    last = [F.max_by(field(rows, f), F.when(field(rows, f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return rows.groupBy(*by, "key").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), *last)


def upsert(facts: DataFrame, fold: Upsert, by: list[str] = ("kind",)) -> DataFrame:
    """Entities of an open schema: (key, n, first_seq, last_seq, fields map, refs).

    Each field is its last value that was there at all; a field that is there and
    null overwrites. Fields are merged one by one, so a key's facts never meet in
    one row.
    """
    rows = facts.select(*by, "seq", _key(facts, fold.key).alias("key"), tokens(F.col("payload")).alias("__members")).where(F.col("key").isNotNull())
    each = rows.select(*by, "key", "seq", F.explode("__members").alias("name", "value")).where(F.col("name") != "ref")
    merged = each.groupBy(*by, "key", "name").agg(F.max_by(F.struct("value"), "seq")["value"].alias("value"))
    fields = merged.groupBy(*by, "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))
    counts = rows.groupBy(*by, "key").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    cited = rows.select(*by, "key", F.explode(reference_list(F.element_at("__members", "ref"))).alias("r")).groupBy(*by, "key").agg(F.array_sort(F.collect_set("r")).alias("refs"))
    on = [*by, "key"]
    return counts.join(fields, on).join(cited, on, "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def top_n(facts: DataFrame, fold: TopN, by: list[str] = ("kind",)) -> DataFrame:
    """The n entities best by a field, for values that only improve: last by key, then a bounded rank."""
    order = F.col(fold.by).desc() if fold.desc else F.col(fold.by).asc()
    rows = facts.withColumn("key", _key(facts, fold.key)).withColumn(fold.by, numeric(facts, fold.by)[0])
    last = rows.groupBy(*by, "key").agg(F.max_by(fold.by, "seq").alias(fold.by), F.min("seq").alias("first_seq"))
    ranked = last.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(order, "first_seq")))
    return ranked.where(F.col("pos") <= fold.n)


def top_n_exact(facts: DataFrame, fold: TopN, by: list[str] = ("kind",)) -> DataFrame:
    """As facts arrive: each replaces its key's entry, and what falls out of the n best is forgotten.

    What is forgotten depends on the order of arrival, so each group is one pass;
    the pass streams and holds n entries, whatever the group's size.
    """
    names = list(by)
    rows = facts.withColumn("key", _key(facts, fold.key)).withColumn("by_value", numeric(facts, fold.by)[0].cast("double"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", pos int, key string, by_value double"

    def order(x: tuple[str, float]) -> float:
        return -x[1] if fold.desc else x[1]

    def step(held: dict[str, float], row: tuple) -> dict[str, float]:
        key, value = row
        if key is None or value is None or value != value:
            return held
        held[key] = value
        return dict(sorted(held.items(), key=order)[: fold.n]) if len(held) > fold.n else held

    def rows_of(held: dict[str, float]) -> list[tuple]:
        return [(i + 1, k, v) for i, (k, v) in enumerate(sorted(held.items(), key=order))]

    return _passed(rows, names, ["key", "by_value"], dict, step, rows_of, schema)


def _passed(rows: DataFrame, by: list[str], fields: list[str], start: Callable, step: Callable, rows_of: Callable, schema: str) -> DataFrame:
    """Each group in receipt order through ``step``, as one pass over sorted batches that holds one state.

    A group ends where the next begins; nothing else of it is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, names = None, None, [x.strip().split(" ")[0] for x in schema.split(",")]
        for batch in batches:
            out = []
            columns = [batch[c].astype(object).where(batch[c].notna(), None) for c in (*by, *fields)]
            for row in zip(*columns):
                group = row[: len(by)]
                if now is None or group != now:
                    out += [(*now, *r) for r in rows_of(state)] if now is not None else []
                    now, state = group, start()
                state = step(state, row[len(by) :])
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None and (last := rows_of(state)):
            yield pd.DataFrame([(*now, *r) for r in last], columns=names)

    dealt = rows.select(*by, "seq", *fields).repartition(*by) if by else rows.select("seq", *fields).repartition(1)
    return dealt.sortWithinPartitions(*by, "seq").mapInPandas(run, schema)


def custom(facts: DataFrame, start: Callable[[], dict], step: Callable[[dict, dict], dict], by: list[str] = ("kind",)) -> DataFrame:
    """Any (state, payload) -> state, each group in receipt order: (by, state as JSON).

    A group is one pass that streams; it holds the state alone.
    """
    import json

    names = list(by)
    kinds = dict(facts.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", state string"

    def stepped(state: dict, row: tuple) -> dict:
        payload, ts = row
        return step(state, json.loads(payload or "{}") | {"_ts": ts})

    return _passed(facts, names, ["payload", "ts"], start, stepped, lambda state: [(json.dumps(state, sort_keys=True),)], schema)


def merged(checkpoint: DataFrame, suffix: DataFrame, spec: Spec, by: list[str] = ("kind",)) -> DataFrame:
    """Scalars of a prefix and of the facts after it, as if folded in one pass."""
    both = checkpoint.withColumn("__late", F.lit(0)).unionByName(suffix.withColumn("__late", F.lit(1)))
    columns = []
    for f in spec.scalars():
        t = f.target
        match f:
            case Count():
                columns.append(F.sum(t).alias(t))
                continue
            case Latest():
                columns.append(F.max_by(t, F.when(F.col(t).isNotNull(), F.col("__late"))).alias(t))
            case Sum():
                columns.append(F.sum(t).alias(t))
            case Min():
                columns.append(F.min(t).alias(t))
            case Max():
                columns.append(F.max(t).alias(t))
            case Avg():
                total, n = F.sum(f"{t}_sum"), F.sum(f"{t}_count")
                columns += [F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias(t), total.alias(f"{t}_sum"), n.alias(f"{t}_count")]
        columns.append(F.sum(f"{t}_rejected").alias(f"{t}_rejected"))
    return both.groupBy(*by).agg(*columns)

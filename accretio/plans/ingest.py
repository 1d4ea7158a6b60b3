"""What a declaration's parse blocks make of facts on their way to the folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import parsed
from ..operators import parse
from ..operators.parse import Coerce, Flatten, Step, Transform
from .declarations import Vertex


def derived(facts: DataFrame, v: Vertex) -> DataFrame:
    """Facts as they are folded: payloads of kinds with a parse block are what its steps make of them.

    A fact of which the steps leave nothing is kept in the log but not folded, and
    isn't returned; of several records the first counts. Facts of other kinds pass as
    they are. The log keeps what came in: apply this to what is folded, not to what is stored.
    """
    steps = {k.name: k.parse for k in v.kinds.values() if k.parse}
    if not steps:
        return facts
    parts = [facts.where(~F.coalesce(F.col("kind").isin(*steps), F.lit(False)))]
    parts += [_of_kind(facts.where(F.col("kind") == kind), todo).select(facts.columns) for kind, todo in steps.items()]
    return reduce(DataFrame.unionByName, parts)


def _of_kind(rows: DataFrame, steps: list[Step]) -> DataFrame:
    members = F.try_variant_get(parsed("payload"), "$", "map<string,variant>")
    rows = rows.withColumn("__tokens", F.transform_values(members, lambda _, x: F.to_json(x))).where(F.col("__tokens").isNotNull()).withColumn("rec", F.col("payload"))
    changed, kinds, is_text = set(), {}, True
    for s in steps:
        if is_text and isinstance(s, parse.Skip | parse.Transform | parse.Coerce | parse.Select):
            rows, is_text = rows.withColumn("rec", F.from_json("rec", "map<string,string>")), False
        if is_text and isinstance(s, parse.Split | parse.Pick | parse.Rename):
            return rows.where(F.lit(False))  # a payload is a record, which has no places
        rows = parse.run(rows, [s], many=False)
        if isinstance(s, Flatten):
            bare = F.expr("substring(rec, 1, length(rec) - 1)")
            more = F.to_json(F.create_map(F.lit(s.into), F.col(s.into)))
            rows = rows.withColumn("rec", F.concat(bare, F.when(F.col("rec") == "{}", "").otherwise(","), F.substr(more, F.lit(2)))).drop(s.into)
        if isinstance(s, parse.Project):
            is_text, changed = False, changed | set(s.paths)
        if isinstance(s, Transform):
            changed.add(s.field)
        if isinstance(s, Coerce):
            changed |= set(s.types)
            kinds |= s.types
    if is_text:
        return rows.withColumn("payload", F.col("rec"))
    bare = [n for n, k in kinds.items() if k in ("int", "float")]
    truths = [n for n, k in kinds.items() if k == "bool"]

    def member(e):
        name, value = e["key"], e["value"]
        text, named = F.to_json(F.create_map(name, value)), F.to_json(F.create_map(name, F.lit(1)))
        plain = F.when(name.isin(*bare), value).when(name.isin(*truths), F.lower(value)).when(~name.isin(*changed), F.element_at("__tokens", name))
        inside = F.concat(named.substr(F.lit(2), F.length(named) - 3), plain)
        return F.coalesce(inside, text.substr(F.lit(2), F.length(text) - 2))

    made = F.array_join(F.transform(F.map_entries("rec"), member), ",")
    return rows.withColumn("payload", F.concat(F.lit("{"), made, F.lit("}")))

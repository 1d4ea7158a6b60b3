"""The graph of folded entities: edges from references, walks, hubs, chains, cycles.

nodes: (kind, key). edges: (src, predicate, dst), names being kind:key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import edge_addresses, readings
from ..sources.scratch import written


def named(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.concat_ws(":", "kind", "key").alias("name"), "kind", "key").distinct()


def references(items: DataFrame, refs: str = "refs") -> DataFrame:
    """(src_kind, src_key, predicate, ref, kind, key): each meaning of each reference of each item."""
    rows = items.select(F.col("kind").alias("src_kind"), F.col("key").alias("src_key"), F.explode(refs).alias("ref"))
    meant = rows.select("*", F.explode(readings(F.col("ref"))).alias("r"))
    return meant.select("src_kind", "src_key", F.lit("ref").alias("predicate"), "ref", F.col("r.kind").alias("kind"), F.col("r.key").alias("key"))


def declared_edges(items: DataFrame, field: str, target: str) -> DataFrame:
    """As ``references``, from an edge field declared to lead to a kind."""
    rows = items.select(F.col("kind").alias("src_kind"), F.col("key").alias("src_key"), F.lit(field).alias("predicate"), F.explode(edge_addresses(F.col(field).cast("string"), target)).alias("ref"))
    return rows.select("*", F.split_part("ref", F.lit(":"), F.lit(1)).alias("kind"), F.expr("substring(ref, instr(ref, ':') + 1)").alias("key"))


def resolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, predicate, ref, dst): references that lead to a node, by kind and key or by key alone."""
    src = F.concat_ws(":", "src_kind", "src_key").alias("src")
    full = refs.where(F.col("kind") != "").join(nodes.select("kind", "key"), ["kind", "key"]).select(src, "predicate", "ref", F.concat_ws(":", "kind", "key").alias("dst"))
    bare = refs.where(F.col("kind") == "").drop("kind").join(nodes.select("kind", "key"), "key").select(src, "predicate", "ref", F.concat_ws(":", "kind", "key").alias("dst"))
    return full.unionByName(bare).distinct()


def dangling(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, predicate, ref) of references none of whose meanings is a node."""
    every = refs.select(F.concat_ws(":", "src_kind", "src_key").alias("src"), "predicate", "ref").distinct()
    return every.join(resolved(refs, nodes).select("src", "predicate", "ref").distinct(), ["src", "predicate", "ref"], "left_anti")


def hubs(edges: DataFrame, n: int) -> DataFrame:
    """The n nodes most led to: (name, inbound)."""
    return edges.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("inbound")).orderBy(F.col("inbound").desc(), "name").limit(n)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge either way."""
    touched = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    return named(nodes).join(touched, "name", "left_anti")


def census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and outgoing edges by kind."""
    out = edges.groupBy(F.split_part("src", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("edges"))
    return named(nodes).groupBy("kind").agg(F.count("*").alias("nodes")).join(out, "kind", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))


def walk(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(name, depth) of what is reached within so many steps, at its least depth; starts (name) at 0.

    Edges are made once; each step joins the frontier only, and cuts its lineage.
    """
    edges = written(edges.select("src", "dst").distinct(), "walk")
    reached = starts.select("name").distinct().withColumn("depth", F.lit(0))
    frontier = reached.select("name")
    for step in range(1, depth + 1):
        new = frontier.join(edges.select(F.col("src").alias("name"), "dst"), "name").select(F.col("dst").alias("name")).distinct()
        new = written(new.join(reached.select("name"), "name", "left_anti"), "walk")
        if not new.head(1):
            break
        reached, frontier = reached.unionByName(new.withColumn("depth", F.lit(step))), new
    return reached


def cyclic(edges: DataFrame) -> DataFrame:
    """(name): nodes left when nodes that only lead out of the graph, or only into it, are
    taken away again and again: those on cycles or on paths between cycles."""
    left = edges.select("src", "dst").distinct()
    while True:
        kept = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = written(kept.select("src", "dst"), "cyclic")
        if kept.count() == left.count():
            return kept.select(F.col("src").alias("name")).unionByName(kept.select(F.col("dst").alias("name"))).distinct()
        left = kept


def strong_components(edges: DataFrame) -> DataFrame:
    """(name, component): the least name of those that reach each other; components of one node are left out.

    In each round every remaining node takes the least name that reaches it; those
    that also reach that name backwards are its component, and leave. Self-loops
    count as no component.
    """
    left = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    found = None
    while True:
        core = cyclic(left)
        left = written(left.join(core.withColumnRenamed("name", "src"), "src", "left_semi").join(core.withColumnRenamed("name", "dst"), "dst", "left_semi"), "scc")
        if not left.head(1):
            break
        names = left.select(F.col("src").alias("name")).unionByName(left.select(F.col("dst").alias("name"))).distinct()
        color = written(names.withColumn("color", F.col("name")), "scc")
        while True:
            sent = left.join(color.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg(F.min("color").alias("c"))
            new = written(color.join(sent, "name", "left").select("name", F.least("color", F.coalesce("c", "color")).alias("color")), "scc")
            changed = new.join(color.withColumnRenamed("color", "old"), "name").where(F.col("color") != F.col("old")).head(1)
            color = new
            if not changed:
                break
        inside = left.join(color.select(F.col("name").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("name").alias("dst"), F.col("color").alias("cd")), "dst").where(F.col("cs") == F.col("cd"))
        inside = written(inside.select("src", "dst", F.col("cs").alias("color")), "scc")
        back = frontier = color.where(F.col("name") == F.col("color")).select("name", "color")
        while True:
            new = frontier.join(inside.select(F.col("dst").alias("name"), "src", "color"), ["name", "color"]).select(F.col("src").alias("name"), "color").distinct()
            new = written(new.join(back, ["name", "color"], "left_anti"), "scc")
            if not new.head(1):
                break
            back, frontier = back.unionByName(new), new
        back = written(back, "scc")
        grown = back.join(back.groupBy("color").count().where("count > 1"), "color").select("name", F.col("color").alias("component"))
        found = grown if found is None else found.unionByName(grown)
        left = written(left.join(back.select(F.col("name").alias("src")), "src", "left_anti").join(back.select(F.col("name").alias("dst")), "dst", "left_anti"), "scc")
    if found is None:
        return edges.sparkSession.createDataFrame([], "name string, component string")
    return found


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("name")).distinct()


def longest_chains(edges: DataFrame, most: int = 64) -> DataFrame:
    """(name, length): the number of steps of the longest path that ends in each node of an
    acyclic graph; cycles are to be taken out first. Paths beyond ``most`` steps are an error."""
    left = edges.select("src", "dst").distinct()
    names = left.select(F.col("src").alias("name")).unionByName(left.select(F.col("dst").alias("name"))).distinct()
    best = names.withColumn("length", F.lit(0))
    frontier = names
    for step in range(1, most + 1):
        frontier = written(frontier.withColumnRenamed("name", "src").join(left, "src").select(F.col("dst").alias("name")).distinct(), "chains")
        if not frontier.head(1):
            return best.groupBy("name").agg(F.max("length").alias("length"))
        best = best.unionByName(frontier.withColumn("length", F.lit(step)))
    raise ValueError(f"there are paths of more than {most} steps, or cycles")


def chain_paths(edges: DataFrame, most: int = 128) -> DataFrame:
    """(name, path): the longest path that starts in each node with an edge, the least by name of equals.

    Edges must have no cycles. Every step lengthens paths by one edge in front and
    keeps one path a node: of all paths of a length, the least, whose rest is the
    least of its own start. Paths beyond ``most`` steps are an error.
    """
    left = written(edges.select("src", "dst").distinct(), "chain-edges")
    step = written(left.groupBy("src").agg(F.min(F.array("src", "dst")).alias("path")).withColumnRenamed("src", "name"), "paths")
    rounds = [step]
    for _ in range(most - 1):
        longer = left.join(step.withColumnRenamed("name", "dst"), "dst").groupBy("src").agg(F.min(F.concat(F.array("src"), "path")).alias("path"))
        step = written(longer.withColumnRenamed("src", "name"), "paths")
        if not step.head(1):
            return reduce(DataFrame.unionByName, rounds).groupBy("name").agg(F.max_by("path", F.size("path")).alias("path"))
        rounds.append(step)
    raise ValueError(f"there are paths of more than {most} steps, or cycles")


def top_chains(edges: DataFrame, limit: int = 10, most: int = 128) -> DataFrame:
    """(path, length): the longest chains of nodes that aren't part of another, longest first, then by name.

    The rest of a longest chain is the longest chain of its own start, so a chain
    is part of another where its start comes second in one.
    """
    paths = chain_paths(edges, most)
    second = paths.select(F.get("path", F.lit(1)).alias("name")).distinct()
    return paths.join(second, "name", "left_anti").select("path", F.size("path").alias("length")).orderBy(F.col("length").desc(), "path").limit(limit)

"""Parameter tables, pins, snapshots, chains, namespaces and members in small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from accretio.operators import graph, history, surface
from accretio.plans import peers
from accretio.sources import tables


def test_parameters(spark, tmp_path):
    path = tmp_path / "feeds.list"
    path.write_text("# feeds\n\nname  url title\na http://a  A  of all\nshort\nb $B Bee\n")
    rows = tables.parameters(spark, f"file://{path}").orderBy("pos").collect()
    assert [dict(r["values"]) for r in rows] == [{"name": "a", "url": "http://a", "title": "A of all"}, {"name": "b", "url": "$B", "title": "Bee"}]
    made = tables.instances(spark, "{{ name }}={{ url }}", f"file://{path}", [{"name": "c", "url": "x"}], {"B": "bb"})
    assert made == ["a=http://a", "b=bb", "c=x"]
    path.write_text("# nothing\n")
    assert tables.parameters(spark, f"file://{path}").collect() == []


def test_drifted(spark, tmp_path):
    for name, text in (("a.loop", "one"), ("b.loop", "two")):
        (tmp_path / name).write_text(text)
    pinned = tables.pins(spark, [f"file://{tmp_path}/a.loop", f"file://{tmp_path}/b.loop"]).withColumn("path", F.substring_index("path", "/", -1))
    rows = [tuple(r) for r in pinned.collect()] + [("gone.loop", "0" * 64), ("unpinned.loop", None)]
    pinned = spark.createDataFrame(rows, "path string, sha256 string")
    (tmp_path / "b.loop").write_text("two!")
    found = {r["path"]: r["problem"] for r in tables.drifted(spark, pinned, f"file://{tmp_path}").collect()}
    assert found == {"b.loop": "changed", "gone.loop": "missing"}


def test_snapshots_of_odd_shape(spark):
    payloads = ['{"a":{"items":{"x":{"_n":"3"},"y":7}},"_b":{"items":[1]},"c":[1],"d":{"items":"z"}}', "not json", None]
    ticks = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "tick_seq long, payload string")
    rows = history.payload_stats(ticks, ["tick_seq"]).collect()
    assert [(r["tick_seq"], r["kind"], r["items"], r["refs"], r["compression"]) for r in rows if r["kind"] != "a"] == []
    assert [(r["items"], r["refs"]) for r in rows] == [(2, 0)]


def test_newest_refuses_ranges_without_ticks(spark):
    ticks = spark.createDataFrame([(1, 1.0)], "tick_seq long, ts double")
    assert [r["index"] for r in history.newest(ticks, 0, 5).collect()] == [0]
    with pytest.raises(ValueError):
        history.newest(ticks, 3, 3)


def test_top_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("b", "d"), ("c", "e"), ("d", "e")], "src string, dst string")
    rows = [(r["path"], r["length"]) for r in graph.top_chains(edges).collect()]
    # d's chain isn't part of another: a and b go on by c, which comes before d
    assert rows == [(["a", "b", "c", "e"], 4), (["x", "c", "e"], 3), (["d", "e"], 2)]
    assert graph.top_chains(edges.where("false")).collect() == []
    with pytest.raises(ValueError):
        graph.chain_paths(edges.unionByName(spark.createDataFrame([("e", "a")], "src string, dst string")), most=8)


def test_namespaces_stay_whole_where_few_keys_have_one(spark):
    keys = [("a", "x/1"), ("a", "y"), ("a", "z"), ("b", "x/1"), ("b", "y"), ("b", "z"), ("b", "w"), ("c", "y"), ("c", None)]
    found = {(r["kind"], r["namespace"]): r["items"] for r in surface.namespaces(spark.createDataFrame(keys, "kind string, key string")).collect()}
    assert found == {("a", "x"): 1, ("a", None): 2, ("b", None): 4, ("c", None): 2}


def test_members_without_anything_take_nothing(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, kind string")
    assert peers.forwarded(facts, ()).collect() == []
    assert peers.forwarded(facts, (peers.Member("m"),)).collect() == []
    deep = (peers.Member("m", (), (), (peers.Member("n", ("b",)),)),)
    assert {(r["seq"], r["member"]) for r in peers.forwarded(facts, deep).collect()} == {(2, "m"), (2, "m/n")}

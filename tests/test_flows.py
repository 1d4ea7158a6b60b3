"""Boundaries, streams, graphs, store operations: cases the driver's tables don't have."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from accretio.functions.hashing import canonical, canonical_number, ulid
from accretio.functions.names import address, edge_addresses, is_reference, observer_matches, readings, routed
from accretio.operators import boundaries, graph, reads, search, store_ops, surface
from accretio.operators.folds import Count, Latest, Spec, Sum
from accretio.plans import declarations, firing
from accretio.streaming import live


def facts(spark, rows):
    """rows: (seq, kind, ts, payload)"""
    data = [(s, f"f{s:03d}", k, float(t), "o", "", json.dumps(p), float(p.get("v", 0))) for s, k, t, p in rows]
    return spark.createDataFrame(data, "seq long, id string, kind string, ts double, observer string, origin string, payload string, v double")


def test_boundary_on_the_first_fact_and_open_end(spark):
    rows = facts(spark, [(1, "end", 1, {}), (2, "a", 2, {}), (3, "end", 3, {}), (4, "a", 4, {})])
    got = {(r["seq"], r["window"], r["open"]) for r in boundaries.when(rows, F.col("kind") == "end").collect()}
    assert got == {(1, 0, False), (2, 1, False), (3, 1, False), (4, 2, True)}


def test_every_leaves_what_doesnt_fill(spark):
    rows = facts(spark, [(i, "a", i, {}) for i in range(1, 8)])
    assert sorted((r["seq"], r["window"]) for r in boundaries.every(rows, 3).collect()) == [(i, (i - 1) // 3) for i in range(1, 7)]
    assert boundaries.after(rows, 9).count() == 0 and boundaries.after(rows, 2).count() == 2


def test_match_is_typed_and_conditions_compare(spark):
    rows = facts(spark, [(1, "a", 1, {"s": "1"}), (2, "a", 1, {"s": 1}), (3, "a", 1, {}), (4, "a", 1, {"s": None})])
    assert [r["seq"] for r in rows.where(boundaries.matches(F.col("payload"), {"s": "1"})).collect()] == [1]
    one = spark.createDataFrame([("3", "x", None)], "n string, t string, m string")
    tests = [("n", ">=", "3"), ("n", "<", "3"), ("t", "==", "x"), ("t", "!=", "y"), ("t", ">", "a"), ("m", "==", "x"), ("m", ">=", "0")]
    assert [one.select(boundaries.compares(F.col(c), op, v)).first()[0] for c, op, v in tests] == [True, False, True, True, False, False, False]


def test_fires_start_anew(spark):
    rows = facts(spark, [(i, "a", i, {"v": v}) for i, v in enumerate([4, 4, 4, 20, 1, 9], 1)])
    got = [tuple(r)[1:] for r in boundaries.fires(rows, "v", 10).orderBy("tick").collect()]
    assert got == [(0, 1, 3, 3, 12.0), (1, 4, 4, 1, 20.0), (2, 5, 6, 2, 10.0)]


def test_shared_ends_are_in_both_windows(spark):
    ticks = spark.createDataFrame([("t", 0, 0.0, 5.0), ("t", 1, 5.0, 9000.0)], "name string, window int, since double, ts double")
    rows = facts(spark, [(i, "a", t, {}) for i, t in enumerate([0, 5, 8000, 9000, 9001])])
    got = sorted((r["window"], r["seq"]) for r in boundaries.window_facts(rows, ticks).select("window", "seq").collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 2), (1, 3)]


def _stream(spark, rows, at, parts):
    for n in range(parts):
        rows.where((F.col("seq") > 40 * n) & (F.col("seq") <= 40 * (n + 1))).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)


def test_stream_of_many_batches_equals_batch(spark, tmp_path):
    rows = facts(spark, [(i, "ab"[i % 2], i, {"v": i % 7}) for i in range(1, 121)]).orderBy(F.rand(1)).cache()
    stream = _stream(spark, rows, str(tmp_path / "in"), 3)
    query = live.counted_ticks(stream, 7, "v").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    query.start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    every = boundaries.every(rows, 7).groupBy("kind", "window").agg(F.min("seq"), F.max("seq"), F.count("*"), F.sum("v"))
    assert got == sorted(tuple(r) for r in every.collect())


def test_follow_folds_onto_the_last_state(spark, tmp_path):
    rows = facts(spark, [(i, "ab"[i % 2 if i <= 80 else 1], i, {"v": 1}) for i in range(1, 121)])
    states, changes = [], []
    spec = Spec("k", (Count("n"), Sum("s", "v"), Latest("t")))

    def write(state, change):
        states.append(spark.createDataFrame(state.toPandas(), state.schema))
        changes.append({r["kind"]: r["change"] for r in change.collect()})

    query = live.follow(_stream(spark, rows, str(tmp_path / "in"), 3), spec, lambda: states[-1] if states else None, write, ["n"])
    query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert {r["kind"]: (r["n"], r["s"]) for r in states[-1].collect()} == {"a": (40, 40.0), "b": (80, 80.0)}
    assert changes[0] == {"a": "added", "b": "added"} and changes[2] == {"b": "changed"}


def test_merge_keeps_the_target_and_is_idempotent(spark):
    a, b = facts(spark, [(1, "a", 5, {"x": 1}), (2, "a", 3, {})]), facts(spark, [(1, "z", 9, {"x": 2}), (3, "b", 4, {}), (4, "b", 2, {})])
    one = store_ops.merge(a, b)
    assert [(r["id"], r["kind"]) for r in one.orderBy("seq").collect()] == [("f001", "a"), ("f002", "a"), ("f004", "b"), ("f003", "b")]
    assert store_ops.difference(store_ops.merge(one, b), one).count() == 0
    assert store_ops.merge(a.limit(0), b).count() == 3 and store_ops.merge(a, b.limit(0)).count() == 2


def test_interleaving_ticks(spark):
    rows = facts(spark, [(1, "a", 1, {}), (2, "a", 2, {})])
    ticks = spark.createDataFrame([(1, "t1", "", ""), (2, "t2", "f001", ""), (3, "t3", None, ""), (4, "t4", "gone", "")], "tick_seq long, id string, fact_cursor string, origin string")
    got = [r["id"] for r in store_ops.interleaved(rows, ticks).orderBy("pos").collect()]
    assert got == ["t1", "f001", "t2", "t3", "t4", "f002"]


def test_push_and_pull(spark, tmp_path):
    rows = facts(spark, [(1, "a.b", 1, {}), (2, "ab", 2, {}), (3, "a", 3, {})])
    store_ops.push(rows, str(tmp_path / "p"), kinds=["a"], before=3.0)
    assert [r["id"] for r in store_ops.pull(None, str(tmp_path / "p")).collect()] == ["f001"]
    assert store_ops.pull(rows, str(tmp_path / "p")).count() == 3
    store_ops.compact(rows, str(tmp_path / "c"), 2)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3


def test_page_cursors_are_exclusive(spark):
    rows = facts(spark, [(i, "a", i, {}) for i in range(1, 11)])
    got = reads.page(rows, 3, before=8).collect()
    assert [r["seq"] for r in got] == [7, 6, 5] and all(r["truncated"] for r in got)
    last = reads.page(rows, 3, before=4).collect()
    assert [r["seq"] for r in last] == [3, 2, 1] and not any(r["truncated"] for r in last)
    assert reads.page(rows, 3, observer="x/o").count() == 3 and reads.page(rows, 3, observer="p").count() == 0


def test_addresses(spark):
    texts = ["a:b", "a/b", "a:b/c", "a/b:c", "b", ":b", "a:", "/", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r for r in df.select("t", address(F.col("t")).alias("a"), readings(F.col("t")).alias("r")).collect()}
    assert tuple(got["a:b"]["a"]) == ("a", "b") and tuple(got["a/b:c"]["a"]) == ("a/b", "c") and tuple(got["b"]["a"]) == ("", "b")
    assert [got[t]["a"] for t in (":b", "a:", "")] == [None] * 3
    assert [tuple(x) for x in got["a/b"]["r"]] == [("a", "b"), ("", "a/b")] and len(got["a:b/c"]["r"]) == 1
    edges = df.limit(1).select(edge_addresses(F.lit("x, k:y,,z/w"), "t")).first()[0]
    assert edges == ["t:x", "k:y", "t:z/w"]
    assert [df.limit(1).select(is_reference(F.lit(t))).first()[0] for t in ("a:b", "a: b", ":b")] == [True, False, False]
    pairs = [("a", "a", True), ("x/a", "a", True), ("a", "x/a", True), ("x/a", "y/a", False), ("a", "b", False)]
    for one, two, want in pairs:
        assert df.limit(1).select(observer_matches(F.lit(one), F.lit(two))).first()[0] is want
    assert df.limit(1).select(routed(F.lit("a.b"), [("a.*", "x"), ("*", "y")], ["a.c"])).first()[0] == "x"


def test_canonical_json_and_ulids(spark):
    numbers = {1.0: "1", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-6: "0.000001", 1e-7: "1e-7", 123.456: "123.456", -0.0: "0", 5e-324: "5e-324", 1.5e300: "1.5e+300", 0.1: "0.1"}
    assert {k: canonical_number(k) for k in numbers} == numbers
    assert canonical({"b": [1, True, None], "a": "é\n", "€": 1.0, "\U0001f600": 2}) == '{"a":"é\\n","b":[1,true,null],"€":1,"\U0001f600":2}'
    got = [r[0] for r in spark.createDataFrame([(1.0, "a"), (2.0, "a"), (2.0, "b")], "ts double, s string").select(ulid(F.col("ts"), F.col("s"))).collect()]
    assert len(set(got)) == 3 and all(len(u) == 26 for u in got) and got[0] < got[1] and got[1][:10] == got[2][:10]


def test_cycles_and_walks(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("s", "s")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = {r["name"]: r["component"] for r in graph.strong_components(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert [r["name"] for r in graph.self_loops(edges).collect()] == ["s"]
    reached = {r["name"]: r["depth"] for r in graph.walk(edges, spark.createDataFrame([("x",)], "name string"), 3).collect()}
    assert reached == {"x": 0, "a": 1, "b": 2, "c": 3}
    assert graph.strong_components(edges.limit(0)).count() == 0


def test_flat_population_is_all_mid(spark):
    items = spark.createDataFrame([(i, 3) for i in range(5)], "k int, salience int")
    assert {r["tier"] for r in surface.with_tiers(items).collect()} == {"mid"}


def test_members_with_dots_match(spark):
    rows = spark.createDataFrame([(1, '{"a.b":"x","a":{"b":"y"}}'), (2, '{"a":{"b":"x"}}')], "seq long, payload string")
    assert [r["seq"] for r in rows.where(boundaries.matches(F.col("payload"), {"a.b": "x"})).collect()] == [1]


def test_no_origin_is_a_group(spark):
    rows = spark.createDataFrame([(i, "k", None if i % 2 else "o") for i in range(1, 9)], "seq long, kind string, origin string")
    got = {(r["seq"], r["n"]) for r in boundaries.prefix_sum(rows, F.lit(1), "n", ["kind", "origin"]).collect()}
    assert got == {(i, (i + 1) // 2) for i in range(1, 9)}
    closed = boundaries.when(rows, F.col("seq") % 4 == 3, ["origin"])
    assert {(r["seq"], r["window"]) for r in closed.where("origin is null").collect()} == {(1, 0), (3, 0), (5, 1), (7, 1)}


def test_boundaries_of_a_vertex_as_one_log(spark):
    text = '''name "v"
    loops { a { fold { n "inc"; m "avg" "v"; t "latest" }; boundary when="b" { condition "n" ">=" 2; condition "m" "<" 5 } }
            c { fold { n "inc" }; boundary every=2 } }
    boundary when="c" s="x"'''
    v = declarations.vertex(text)
    rows = facts(spark, [(1, "a", 1, {"v": 1}), (2, "b", 2, {}), (3, "a", 3, {"v": 2}), (4, "b", 4, {}), (5, "b", 5, {}), (6, "c", 6, {"s": "x"}), (7, "c", 7, {"s": "x"}), (8, "c", 8, {"s": 1})])
    got = [(r["seq"], r["name"], r["rule"]) for r in firing.live(rows, v).orderBy("seq").collect()]
    assert got == [(4, "a", "when"), (6, "v", "vertex"), (7, "c", "count")]
    due = lambda *a: sorted((r["seq"], r["name"]) for r in firing.pending(*a).collect())
    assert due(rows, v) == [(2, "a"), (6, "v")]
    ticks = spark.createDataFrame([(2, 2.0), (6, 6.0)], "seq long, ts double")
    assert due(rows, v, ticks) == [(6, "v")] and due(rows, v, ticks.where("seq < 0")) == [(2, "a"), (6, "v")]
    only = declarations.vertex('name "v"\nloops { a { fold { n "inc" } } }\nboundary when="c" s="x"')
    assert due(rows, only, ticks) == [(7, "v")]
    never = declarations.vertex('name "v"\nloops { z { fold { n "inc" }; boundary when="b" { condition "n" "==" 0 } } }')
    assert due(rows, never) == [(2, "z")] and due(rows.where("false"), v) == []
    assert firing.live(rows.where("false"), v).count() == 0


def test_search_without_an_index_as_by_words(spark):
    """Words are whole runs of letters and digits, whatever stands around them."""
    texts = [None, "", "the", "The end", "other", "x_the_y", "the-end of the line", "the\n\nend", "thé end", "\U0001d400the end", "the\U0001d400", "end the", "a1 the2 end", "THE, END!", "the end end", "the the end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq int, text string")
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in enumerate(texts)}

    def holds(w, q):
        match q:
            case search.Word(t, prefix):
                return any(x.startswith(t.lower()) if prefix else x == t.lower() for x in w)
            case search.Phrase(terms):
                return bool(terms) and f" {' '.join(terms).lower()} " in f" {' '.join(w)} "
            case search.And(parts):
                return all(holds(w, p) for p in parts)
            case search.Or(parts):
                return any(holds(w, p) for p in parts)
            case search.Not(part):
                return not holds(w, part)

    W, P = search.Word, search.Phrase
    for q in (W("the"), W("The", True), W("", True), W(""), W("x_the"), W("en", True), P(("the", "end")), P(("the end",)), P(("the", "-", "end")), P(()), P(("end",)),
              search.And((W("end"), search.Not(P(("the", "end"))))), search.Or((W("thé"), W("a", True)))):
        got = {r["seq"] for r in rows.where(search.matches(rows["text"], q)).collect()}
        assert got == {i for i, w in words.items() if holds(w, q)}, q

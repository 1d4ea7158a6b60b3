"""Declarations: reading, meaning, refusals, documents and their history."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from accretio.operators.folds import Collect, Count, Latest, Max, Sum, Tail, Upsert
from accretio.plans import declarations as d
from accretio.plans import ingest

TEXT = """
// a vertex
name "monitor"
strict #true
loops {
  disk {
    fold { mounts "by" "mount"; updated "latest"; peak "max" "used" }
    boundary when="disk.complete" host="a" { condition "peak" ">=" 3 }
    search "note" "title"
    edge "owner" targets="person"
    lifecycle "status" active="open, waiting"
  }
  change { fold { items "collect" 20; last "window" 5 "v" } }
}
routes { "disk.*" "disk" }
boundary every=10
observers { ann { grant { potential "disk" } }; bob }
"""


def test_text_and_meaning():
    v = d.vertex(TEXT)
    assert v.name == "monitor" and v.strict
    assert v.kinds["disk"].folds == [Upsert("mounts", "mount"), Latest("updated"), Max("peak", "used")]
    assert v.kinds["change"].folds == [Collect("items", 20), Tail("last", "v", 5)]
    b = v.kinds["disk"].boundary
    assert (b.mode, b.kind, b.match, b.conditions) == ("when", "disk.complete", {"host": "a"}, [("peak", ">=", "3")])
    assert v.boundaries[0].mode == "every" and v.boundaries[0].count == 10
    assert v.kinds["disk"].edges == {"owner": "person"} and v.kinds["disk"].lifecycle == ("status", ["open", "waiting"])
    assert v.observers == {"ann": ["disk"], "bob": []}
    assert "cite" in v.specs()


@pytest.mark.parametrize(
    "text",
    ['loops { a { } }', 'nonsense 1', 'loops { a { fold { n "never" } } }', 'loops { a { fold { n "sum" } } }', 'loops { a { fold { n "inc" } boundary } }', "loops {", "}",
     'loops { _x { fold { n "inc" } } }', 'loops { a { fold { n "inc" } boundary when="b" } } boundary when="b"', 'routes { "x" "y" }', 'loops { a { fold { n "inc" } boundary every=2 { condition "m" ">" 1 } } }'],
)
def test_refusals(text):
    with pytest.raises(d.DeclarationError):
        d.vertex(text)


def test_documents_round_trip():
    v = d.vertex(TEXT)
    docs = d.documents(v)
    assert d.documents(d.from_documents(docs)) == docs
    other = d.documents(d.vertex(TEXT.replace("collect\" 20", "collect\" 21").replace("; bob", "; eve")))
    assert d.changed(docs, other) == {("kind", "change"): "changed", ("observer", "bob"): "removed", ("observer", "eve"): "added"}
    assert d.fingerprint(docs) != d.fingerprint(other) and d.fingerprint(docs) == d.fingerprint(dict(reversed(docs.items())))


def test_builder_and_conflicts():
    v = d.Vertex("x").fold("a", Count("n"), Sum("s", "v")).closes("a", d.Boundary("every", count=3))
    assert v.specs()["a"].folds == (Count("n"), Sum("s", "v"))
    assert d.merged_specs([v.specs(), v.specs()]) == v.specs()
    with pytest.raises(d.DeclarationError):
        d.merged_specs([v.specs(), d.Vertex("y").fold("a", Count("m")).specs()])


def test_declared_at_a_cursor(spark):
    rows = [(1, "_decl.kind-defined", '{"subject":"a","document":"1"}'), (2, "_decl.kind-defined", '{"subject":"a","document":"2"}'), (3, "_decl.observer-defined", '{"subject":"o","document":"x"}'),
            (4, "_decl.kind-removed", '{"subject":"a"}'), (5, "note", '{"subject":"b","document":"9"}')]
    facts = spark.createDataFrame(rows, "seq long, kind string, payload string")
    assert {tuple(r) for r in d.declared(facts).collect()} == {("observer", "o", "x")}
    assert {tuple(r) for r in d.declared(facts.where("seq <= 3")).collect()} == {("kind", "a", "2"), ("observer", "o", "x")}


def test_admission(spark):
    v = d.vertex(TEXT)
    rows = [(1, "disk", "ann"), (2, "change", "ann"), (3, "change", "team/bob"), (4, "other", "bob"), (5, "disk", "eve"), (6, "_decl.kind-defined", "bob")]
    got = {r["seq"]: r["refused"] for r in d.admitted(spark.createDataFrame(rows, "seq long, kind string, observer string"), v).collect()}
    assert got == {1: None, 2: "no grant", 3: None, 4: "undeclared", 5: "unknown observer", 6: "reserved"}


def test_tiers_and_durations():
    assert d.tiers({"a": [], "b": ["a"], "c": ["a", "b"], "e": ["outside"]}) == [["a", "e"], ["b"], ["c"]]
    with pytest.raises(d.DeclarationError):
        d.tiers({"a": ["b"], "b": ["a"]})
    assert [d.seconds(x) for x in ("500ms", "5s", "1h30m", "7d")] == [0.5, 5.0, 5400.0, 604800.0]
    with pytest.raises(d.DeclarationError):
        d.seconds("soon")


def test_scalars_in_text():
    n = d.load('a 1 2.5 #true #null word "t\\"x" k=3 { b }')[0]
    assert n.values == [1, 2.5, True, None, "word", 't"x'] and n.properties == {"k": 3} and n.children[0].name == "b"
    assert F is not None


def test_parse_blocks_take_effect_or_are_refused(spark):
    text = """
    name "v"
    loops {
      a { parse { select "n" "pct" "x"; transform "pct" { strip "%"; coerce "int" } }; fold { n "inc" } }
      b { parse { where path="t" "in" "u" "w"; project { name path="who.name"; t path="t" } }; fold { n "inc" } }
      c { parse { split }; fold { n "inc" } }
      d { parse { flatten "items" into="lines" { extract "s" } }; fold { n "inc" } }
      e { fold { n "inc" } }
    }
    """
    v = d.vertex(text)
    docs = d.documents(v)
    assert d.from_documents(docs).kinds["a"].parse == v.kinds["a"].parse
    assert d.documents(d.from_documents(docs)) == docs
    rows = [
        (1, "a", '{"n":5,"pct":"40%","y":1}'), (2, "a", '{"pct":"none"}'), (3, "a", '{"y":1}'), (4, "b", '{"t":"u","who":{"name":"x"}}'), (5, "b", '{"t":"z"}'),
        (6, "c", '{"s":"a b"}'), (7, "d", '{"items":[{"s":"p"},{"s":"q"}]}'), (8, "e", '{"k":1}'), (9, "a", None), (10, None, "{}"),
    ]
    got = {r["seq"]: r["payload"] and json.loads(r["payload"]) for r in ingest.derived(spark.createDataFrame(rows, "seq long, kind string, payload string"), v).collect()}
    assert got == {1: {"n": 5, "pct": 40}, 4: {"name": "x", "t": "u"}, 7: {"items": [{"s": "p"}, {"s": "q"}], "lines": "p\nq"}, 8: {"k": 1}, 10: {}}
    for bad in ("jump 1", "where equals=1", "project", 'transform "a"', 'transform "a" { coerce "date" }', "skip", 'flatten "a"', "explode", 'explode "a" carry="b:c"'):
        with pytest.raises(d.DeclarationError):
            d.vertex(f'name "v"\nloops {{ a {{ parse {{ {bad} }}; fold {{ n "inc" }} }} }}')

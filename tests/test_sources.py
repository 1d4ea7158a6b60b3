"""Reading logs and sources."""

from __future__ import annotations

import json

from accretio.operators.parse import Coerce, Explode, Pick, Project, Skip, Split, Transform, check_flow, run
from accretio.schemas import FACTS, TICKS
from accretio.sources import ingress, records


def fact(i, **more):
    return {"t": "fact", "id": f"f{i}", "kind": "k", "ts": 1.5, "observer": "o", "origin": "", "payload": '{"x": 1}'} | more


def read(spark, lines):
    rows = spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "line long, value string")
    return records.checked(rows)


def test_strict_lines(spark):
    tick = {"t": "tick", "id": "t", "name": "n", "ts": 2.0, "since": None, "origin": "", "payload": "{}", "prev_hash": None, "window_start": None, "fact_cursor": "f1", "window_hash": None}
    lines = [fact(1), tick, {"t": "batch", "rows": [fact(2), fact(3)]}, {"t": "batch", "rows": [fact(4)]}, {"t": "batch", "rows": [fact(5), fact(5)]}, {"t": "batch", "rows": [fact(6), tick]},
             {"t": "batch", "rows": []}, {"t": "batch", "rows": [fact(6), fact(7)], "x": 1}, fact(8, extra=1), fact(9, ts="1"), fact(10, payload="[1]"), '{"t": "fact"', fact(11, kind=""), "{}", fact(12, id="")]
    got = read(spark, lines).orderBy("line", "place").collect()
    good = [r["line"] for r in got if r["problem"] is None]
    assert good == [0, 1, 2, 2], [(r["line"], r["problem"]) for r in got]
    assert [r["id"] for r in records.facts(read(spark, lines)).orderBy("seq").collect()] == ["f1", "f2", "f3"]
    assert [r["fact_cursor"] for r in records.ticks(read(spark, lines)).collect()] == ["f1"]


def test_write_and_read_back(spark, tmp_path):
    rows = records.facts(read(spark, [fact(i) for i in range(20)]))
    records.fact_lines(rows.coalesce(1).sortWithinPartitions("seq")).write.text(str(tmp_path / "log"))
    again = records.facts(records.checked(records.read_log(spark, str(tmp_path / "log"))))
    assert [r["id"] for r in again.orderBy("seq").collect()] == [f"f{i}" for i in range(20)]
    for n, size in enumerate((3, 40, 7)):  # Spark reads larger files first; numbers follow names
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"{n}.jsonl").write_text("".join(json.dumps(fact(f"{n}-{i:02d}")) + "\n" for i in range(size)))
    many = records.facts(records.checked(records.read_log(spark, str(tmp_path / "many")))).orderBy("seq")
    ids = [r["id"] for r in many.collect()]
    assert len(ids) == 50 and ids == sorted(ids)


def test_sources(spark, tmp_path):
    (tmp_path / "df.txt").write_text("Filesystem Size Used Avail Use% Mounted\n/dev/disk1 100G 20G 80G 27% /\n\n/dev/disk2 1G\n")
    steps = (Skip(startswith="Filesystem"), Split(), Pick((0, 4, 5), ("fs", "pct", "mount")), Transform("pct", strip="%"), Coerce({"pct": "int"}))
    assert check_flow(list(steps)) == [] and check_flow([Pick((0,))])
    rows = ingress.FileSource(str(tmp_path / "df.txt"), "disk", "me", steps=steps).read(spark).collect()
    assert [json.loads(r["payload"]) for r in rows] == [{"fs": "/dev/disk1", "pct": "27", "mount": "/"}]
    plain = ingress.FileSource(str(tmp_path / "df.txt"), "disk").read(spark).collect()
    assert json.loads(plain[0]["payload"])["line"].startswith("Filesystem")
    (tmp_path / "a.ndjson").write_text('{"x":1,"_ts":5,"_observer":"z"}\nnot json\n{"x":2}\n')
    rows = ingress.FileSource(str(tmp_path / "a.ndjson"), "k", "me", format="ndjson").read(spark).collect()
    assert [(json.loads(r["payload"]), r["ts"], r["observer"]) for r in rows] == [({"x": 1}, 5.0, "z"), ({"x": 2}, None, "me")]
    (tmp_path / "b.json").write_text('{"items":[{"v":1},{"v":2}]}')
    rows = ingress.FileSource(str(tmp_path / "b.json"), "k", format="json", steps=(Explode("items"), Project({"v": "v"}))).read(spark).collect()
    assert [json.loads(r["payload"]) for r in rows] == [{"v": "1"}, {"v": "2"}]
    (tmp_path / "c.json").write_text("[1, 2]")
    assert json.loads(ingress.FileSource(str(tmp_path / "c.json"), "k", format="json").read(spark).first()["payload"]) == {"_json": [1, 2]}
    assert json.loads(ingress.FileSource(str(tmp_path / "c.json"), "k", format="blob").read(spark).first()["payload"]) == {"text": "[1, 2]"}


def test_one_to_one_keeps_the_first_of_an_explode(spark):
    rows = spark.createDataFrame([('{"items":[1,2]}',), ('{"items":[]}',), ('{"items":"s"}',)], "rec string")
    assert run(rows, [Explode("items")], many=False).count() == 2 and run(rows, [Explode("items")]).count() == 3


def test_parameters_discovery_cadence(spark, tmp_path):
    assert ingress.with_parameters("curl {{ host }}/{{path}}", [{"host": "a", "path": "$P"}], {"P": "x"}) == ["curl a/x"]
    assert ingress.discovered(["a.log", "b.txt", "c.log"], "*.log") == ["a.log", "c.log"]
    spark.range(3).write.parquet(str(tmp_path / "s1"))
    assert ingress.stores(spark, [str(tmp_path / "s1"), str(tmp_path / "none")]).select("member").distinct().collect()[0][0] == "s1"
    facts = spark.createDataFrame([("_sync.k", 10.0, '{"status":"ok"}'), ("_sync.k", 50.0, '{"status":"failed"}'), ("go", 20.0, "{}")], "kind string, ts double, payload string")
    assert ingress.due(facts, "k", "elapsed", 30, 45.0).first()["due"] and not ingress.due(facts, "k", "elapsed", 40, 45.0).first()["due"]
    assert ingress.due(facts, "k", "triggered", triggers=["go"]).first()["due"] and not ingress.due(facts, "k", "triggered", triggers=["other"]).first()["due"]
    assert ingress.due(facts, "none", "elapsed", 5, 1.0).first()["due"]


def test_lines_keep_signatures_nulls_and_ticks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "k", 1.5, "o", None, "{}", "sig"), (2, "b", "k", 2.0, "o", "", '{"x":1}', None)], FACTS)
    records.fact_lines(rows.coalesce(1)).write.text(str(tmp_path / "log"))
    again = records.checked(records.read_log(spark, str(tmp_path / "log")))
    assert [r["problem"] for r in again.collect()] == [None, None]
    assert [tuple(r) for r in records.facts(again).orderBy("seq").collect()] == [tuple(r) for r in rows.orderBy("seq").collect()]
    ticks = spark.createDataFrame([(1, "t1", "n", 3.0, 1.0, "", "{}", None, "a", "b", None, None)], TICKS)
    records.tick_lines(ticks).write.text(str(tmp_path / "ticks"))
    read_again = records.ticks(records.checked(records.read_log(spark, str(tmp_path / "ticks"))))
    assert [tuple(r)[1:] for r in read_again.collect()] == [tuple(r)[1:] for r in ticks.collect()]


def test_a_batch_of_many_rows_keeps_receipts_apart(spark):
    rows = ",".join(json.dumps({"t": "fact", "id": f"i{i}", "kind": "k", "ts": i, "observer": "o", "origin": "", "payload": {}}) for i in range(120_000))
    lines = spark.createDataFrame([(1, f'{{"t":"batch","rows":[{rows}]}}'), (2, json.dumps({"t": "fact", "id": "last", "kind": "k", "ts": 1, "observer": "o", "origin": "", "payload": {}}))], "line long, value string")
    got = records.facts(records.checked(lines))
    assert got.selectExpr("count(distinct seq)").first()[0] == 120_001
    assert got.orderBy("seq", ascending=False).first()["id"] == "last"


def test_lines_are_checked_once_and_numbered_as_read(spark, tmp_path):
    """Numbering doesn't read the log again; parts of a file and empty lines leave the order as it is."""
    for name, size in (("a", 30), ("b", 500)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(fact(f"{name}{i:03d}")) + "\n" * (1 + i % 3) for i in range(size)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = records.read_log(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        got = records.facts(records.checked(lines))
        rows = got.orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["id"] for r in rows] == [f"fa{i:03d}" for i in range(30)] + [f"fb{i:03d}" for i in range(500)]
    assert [r["seq"] for r in rows] == list(range(1, 531))
    assert not any(f.endswith(".jsonl") for f in got.inputFiles())

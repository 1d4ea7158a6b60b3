"""The folds' semantics, case by case, and against a plain fold in Python."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from accretio.operators import folds
from accretio.operators.folds import Avg, Collect, Count, Latest, Max, Min, Spec, Sum, Tail, TopN, Upsert


def log(spark, payloads, kind="k", ts=None):
    rows = [(i + 1, f"f{i}", kind, float(i) if ts is None else ts[i], "o", "", json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "seq long, id string, kind string, ts double, observer string, origin string, payload string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_average_and_its_parts(spark):
    got = one(folds.scalars(log(spark, [{"v": 10}, {"v": 20}, {"v": 60}]), Spec("k", (Avg("a", "v"),))))
    assert (got["a"], got["a_sum"], got["a_count"]) == (30.0, 90.0, 3)


def test_count_counts_empty_payloads(spark):
    assert one(folds.scalars(log(spark, [{}, {}, {"x": 1}]), Spec("k", (Count("n"),))))["n"] == 3


def test_off_type_values_are_rejected_and_nulls_skipped(spark):
    spec = Spec("k", (Sum("s", "v"), Avg("a", "v"), Min("lo", "v"), Max("hi", "v")))
    got = one(folds.scalars(log(spark, [{"v": 10}, {"v": "invalid"}, {"v": True}, {"v": 20}, {"v": None}, {}]), spec))
    assert (got["s"], got["a"], got["lo"], got["hi"]) == (30, 15.0, 0, 20)
    assert {got[f"{t}_rejected"] for t in ("s", "a", "lo", "hi")} == {2}


def test_min_without_a_seed(spark):
    got = one(folds.scalars(log(spark, [{"v": 15.5}, {"v": -3.2}, {"v": 42}, {"v": 0}]), Spec("k", (Min("lo", "v", None), Max("hi", "v", None), Min("seeded", "v")))))
    assert (got["lo"], got["hi"], got["seeded"]) == (-3.2, 42.0, -3.2)


def test_latest_is_the_last_received(spark):
    got = one(folds.scalars(log(spark, [{}, {}, {}, {}], ts=[5.0, 9.0, 2.0, None]), Spec("k", (Latest("t"),))))
    assert (got["t"], got["t_rejected"]) == (2.0, 1)


def test_ordered_sum_is_bit_exact(spark):
    assert one(folds.ordered_sum(log(spark, [{"v": 0.1}, {"v": 0.2}]), "v"))["total"] == 0.30000000000000004


def test_collect_keeps_the_last_and_takes_refs_out(spark):
    rows = folds.collect(log(spark, [{"x": 1}, {"x": 2, "ref": "r2, r1"}, {"x": 3}]), Collect("c", 2)).orderBy("pos").collect()
    assert [(r["pos"], r["seq"], r["refs"]) for r in rows] == [(1, 2, ["r1", "r2"]), (2, 3, [])]
    assert folds.collect(log(spark, [{}] * 5), Collect("c", 0)).count() == 5


def test_window_keeps_values_of_any_type(spark):
    rows = folds.tail(log(spark, [{"v": 10}, {"v": 20}, {"v": None}, {"v": "x"}, {"v": 40}]), Tail("w", "v", 3)).orderBy("pos").collect()
    assert [r["w"] for r in rows] == ["20", "x", "40"]


def test_upsert_merges_by_field(spark):
    payloads = [{"id": "a", "x": 1, "y": 2, "ref": "p"}, {"id": "a", "x": 5, "ref": "q,p"}, {"id": None, "x": 9}, {"x": 9}, {"id": "b", "z": None}, {"id": "a", "y": None}]
    got = {r["key"]: r for r in folds.upsert(log(spark, payloads), Upsert("u", "id")).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["fields"] == {"id": "a", "x": "5", "y": None} and got["a"]["n"] == 3 and got["a"]["refs"] == ["p", "q"]
    assert got["b"]["fields"] == {"id": "b", "z": None} and got["b"]["refs"] == []


def test_keys_as_text(spark):
    got = {r["key"]: r["n"] for r in folds.upsert(log(spark, [{"id": 0}, {"id": "0"}, {"id": 0.0}, {"id": False}]), Upsert("u", "id")).collect()}
    assert got == {"0": 2, "0.0": 1, "False": 1}


def test_top_n_forgets_what_fell_out(spark):
    payloads = [{"id": k, "v": v} for k, v in [("a", 5), ("b", 5), ("c", 5), ("a", 1), ("d", 4)]]
    rows = folds.top_n_exact(log(spark, payloads), TopN("t", "id", "v", 2)).orderBy("pos").collect()
    assert [(r["key"], r["by_value"]) for r in rows] == [("b", 5.0), ("d", 4.0)]


def test_prefix_and_suffix_make_the_whole(spark):
    rng = random.Random(1)
    rows = log(spark, [{"v": rng.randrange(100)} if rng.random() < 0.9 else {"v": "x"} for _ in range(200)])
    spec = Spec("k", (Count("n"), Sum("s", "v"), Min("lo", "v", None), Max("hi", "v"), Avg("a", "v"), Latest("t")))
    whole = one(folds.scalars(rows, spec))
    parts = one(folds.merged(folds.scalars(rows.where("seq <= 70"), spec), folds.scalars(rows.where("seq > 70"), spec), spec))
    assert {k: round(v, 9) if isinstance(v, float) else v for k, v in parts.items()} == {k: round(v, 9) if isinstance(v, float) else v for k, v in whole.items()}


def test_order_of_rows_doesnt_matter_only_seq(spark):
    rows = log(spark, [{"id": i % 3, "x": i} for i in range(50)])
    a = {r["key"]: r["fields"]["x"] for r in folds.upsert(rows, Upsert("u", "id")).collect()}
    b = {r["key"]: r["fields"]["x"] for r in folds.upsert(rows.orderBy(F.rand(3)), Upsert("u", "id")).collect()}
    assert a == b == {"0": "48", "1": "49", "2": "47"}


def test_custom_fold(spark):
    rows = folds.custom(log(spark, [{"v": 3}, {"v": 4}]), lambda: {"p": 1}, lambda s, p: {"p": s["p"] * p["v"]})
    assert json.loads(one(rows)["state"]) == {"p": 12}


@pytest.mark.parametrize("seed", range(2))
def test_against_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    values = [lambda: rng.randrange(10), lambda: "t", lambda: True, lambda: None]
    payloads = [{"id": rng.choice(["a", "b", None]), **({"v": rng.choice(values)()} if rng.random() < 0.8 else {})} for _ in range(120)]
    total = rejected = 0
    merged, counts = defaultdict(dict), defaultdict(int)
    for p in payloads:
        v = p.get("v")
        if isinstance(v, int) and not isinstance(v, bool):
            total += v
        elif v is not None:
            rejected += 1
        if p["id"] is not None:
            merged[p["id"]] |= p
            counts[p["id"]] += 1
    got = one(folds.scalars(log(spark, payloads), Spec("k", (Sum("s", "v"),))))
    assert (got["s"], got["s_rejected"]) == (total, rejected)
    shown = {k: {n: None if v is None else "true" if v is True else str(v) for n, v in m.items()} for k, m in merged.items()}
    rows = {r["key"]: (r["n"], r["fields"]) for r in folds.upsert(log(spark, payloads), Upsert("u", "id")).collect()}
    assert rows == {k: (counts[k], shown[k]) for k in shown}

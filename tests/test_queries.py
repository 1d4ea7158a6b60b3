"""Every registered query of the engine's own operators against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

from accretio import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool | str | datetime.datetime):
        return v
    return round(float(v), 6)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(shown(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    found = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, found.fetchall())


def test_walks_and_marks_leave_nothing_out(spark, db):
    walked = {r["name"] for r in queries.QUERIES["ref_walk_all"](spark, SF).where("depth = 0").collect()}
    assert walked == {x for (x,) in db.execute("SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier").fetchall()}
    marks = {r["mark"] for r in queries.QUERIES["tick_asof_floor_all"](spark, SF).collect()}
    assert marks == {x for (x,) in db.execute("SELECT event_id FROM events").fetchall()}


def test_store_difference_sees_views_of_no_value(spark, tmp_path):
    """A view of 0 cents, and one without a value, are changed in the other store as all views are."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(2, at, 1, "view", 0.0, "{}"), (4, at, 1, "view", None, "{}"), (8, at, 1, "view", 1.5, "{}"), (10, at, 1, "click", 0.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = {tuple(r) for r in queries.QUERIES["store_difference"](spark, str(tmp_path)).collect()}
    assert got == set(c.execute(queries.ORACLE_SQL["store_difference"]).fetchall()) and len(got) == 3

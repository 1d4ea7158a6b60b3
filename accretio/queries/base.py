"""Registering a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..schemas import facts_of_events, table

Query = Callable[[SparkSession, str], DataFrame]

FACTS = """(SELECT event_id AS seq, 'e' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS id, event_type AS kind, epoch(ts) AS ts,
  CAST(user_id AS VARCHAR) AS observer, value, CAST(round(value * 100) AS BIGINT) AS cents,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name; FACTS in the SQL stands for events as facts."""

        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql.replace("{FACTS}", FACTS)
            return f

        return put


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of_events(table(spark, sf_dir, "events"))

"""The engine's operators as queries over the driver's tables, each with SQL that must agree."""

from __future__ import annotations

from . import entities, firing, flows, history, logs, stores, streams

QUERIES = {**logs.QUERIES, **flows.QUERIES, **firing.QUERIES, **entities.QUERIES, **history.QUERIES, **stores.QUERIES, **streams.QUERIES}
ORACLE_SQL = {**logs.ORACLE_SQL, **flows.ORACLE_SQL, **firing.ORACLE_SQL, **entities.ORACLE_SQL, **history.ORACLE_SQL, **stores.ORACLE_SQL, **streams.ORACLE_SQL}

"""Every registered query of the engine and the SQL that DuckDB checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import indexed, ranked, records, rules, shaping, stateful, unread, upkept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (ranked, indexed, shaping, stateful, records, rules, unread, upkept):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)

"""Registered queries and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import delivery, entities, extras, media, narration, queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _family in (narration, entities, media, delivery, extras, queue):
    QUERIES |= _family.QUERIES
    ORACLE_SQL |= _family.ORACLE_SQL

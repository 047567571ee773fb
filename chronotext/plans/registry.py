"""All queries of the library's own operators, and their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronotext.plans import media, notes, timeline

MODULES = [timeline, media, notes]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(m, name) for m in MODULES for name in (*m.SQL, *getattr(m, "NO_SQL", ()))}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

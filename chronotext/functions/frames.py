"""Helpers on whole DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Rows of all parts, columns matched by name.

    Spark 4.1 may zip the partitions of a union's parts when they are hashed alike; if adaptive execution has changed the
    number of partitions of one part by then, the query fails ("Can't zip RDDs with unequal numbers of partitions").
    The session's setting for it is therefore turned off here; a union then costs an exchange where its parts were
    partitioned already.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, rest, first)

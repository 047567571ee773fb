"""Connected components of a link table by alternating large-star and small-star steps.

Every step is an aggregation and a join over (u, v) rows; nothing is gathered on the driver but three numbers a
round, and each round ends in a written table that survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.functions.frames import union_all
from chronotext.llm.common import free, settled, shuffled, table


#: From so many links on, a round's least neighbours are written before they are joined: then Spark can split a hot node's links.
MANY_LINKS = 500_000


def _star(edges: DataFrame, small: bool, many: bool) -> DataFrame:
    """Link neighbours to the least node near them: larger ones (large star), or those not larger (small star)."""
    both = edges if small else union_all(edges, edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = table(least) if many else least
    near = both.join(shuffled(least), "u")
    if small:
        out = union_all(near.select(F.col("v").alias("u"), F.col("m").alias("v")), least.select("u", F.col("m").alias("v")))
    else:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _written(df: DataFrame, many: bool) -> DataFrame:
    return table(df) if many else df


def components(links: DataFrame) -> DataFrame:
    """(u, v) links to (u, v) stars: v is the least node of u's component, for every u that isn't itself the least.

    Links may repeat and may point to themselves; an empty table gives an empty table. Rounds go on until the stars
    settle, which takes about the square of the logarithm of the number of nodes at most.
    """
    edges = table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now == was or now[0] == 0:
            return edges
        many = now[0] >= MANY_LINKS
        then = settled(lambda edges=edges, many=many: _star(_written(_star(edges, False, many), many), True, many))
        free(edges)
        was, edges = now, then

"""Interval algebra on tables (key..., s, e), half-open; all keys at once.

Everything is a window or an equi-join on the key, so one exchange on the key serves a chain of operators. A key with very
many spans can be pre-merged in pieces of the time axis (`piece`): unions of merged pieces merge to the same spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext import model
from chronotext.functions.frames import union_all

KEY = ["video_id"]


def _islands(spans: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    numbered = spans.withColumn("_new", opens).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def merge_spans(spans: DataFrame, key: list[str] = KEY, piece: float | None = None) -> DataFrame:
    """Overlapping and touching spans of a key become one; spans that are empty, reversed or null go."""
    rows = spans.where("e > s").select(*key, "s", "e")
    if piece:
        rows = _islands(rows.withColumn("_piece", F.floor(F.col("s") / piece)), [*key, "_piece"]).drop("_piece")
    return _islands(rows, key)


def complement_spans(spans: DataFrame, bounds: DataFrame, key: list[str] = KEY) -> DataFrame:
    """What spans leave of each key's bounds (key..., lo, hi). A key without spans keeps its whole bounds."""
    inside = spans.join(bounds, key).where("e > lo and s < hi").select(*key, "s", "e")
    merged = merge_spans(inside, key).join(bounds, key).select(*key, F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e"))
    # The bounds' own ends are spans without length, so that the gaps lie between neighbours.
    ends = bounds.where("hi > lo")
    edge = lambda c: ends.select(*key, F.col(c).alias("s"), F.col(c).alias("e"))
    w = Window.partitionBy(*key).orderBy("s", "e")
    every = union_all(merged, edge("lo"), edge("hi"))
    return every.select(*key, F.col("e").alias("s"), F.lead("s").over(w).alias("e")).where("e > s")


def subtract_spans(base: DataFrame, cut: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Parts of the merged base that no span of `cut` covers.

    One sweep over the ends of both sides: a point opens or closes its side, and between two points the state is known.
    No pair of spans is formed, so a key's cost is that of sorting its spans.
    """
    points = None
    for side, kind in ((merge_spans(base, key), "b"), (merge_spans(cut, key), "c")):
        both = side.select(*key, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("p"))
        own = both.select(*key, F.col("p.t").alias("t"), *[(F.col("p.d") if k == kind else F.lit(0)).alias(k) for k in "bc"])
        points = own if points is None else union_all(points, own)
    at = points.groupBy(*key, "t").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    w = Window.partitionBy(*key).orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    state = at.select(*key, F.col("t").alias("s"), F.lead("t").over(w).alias("e"), F.sum("b").over(run).alias("_b"), F.sum("c").over(run).alias("_c"))
    return merge_spans(state.where("_b > 0 and _c = 0 and e > s"), key)


def cover_spans(cues: DataFrame, bounds: DataFrame, key: list[str] = KEY, cap: float | int = model.CUE_MAX_COVER_SEC) -> DataFrame:
    """What cues (key..., t) cover: from each to the next, or to the end `dur` of bounds (key..., dur), `cap` at most."""
    rows = cues.select(*key, "t").join(bounds, key).where("t >= 0 and t <= dur")
    w = Window.partitionBy(*key).orderBy("t")
    end = F.least(F.coalesce(F.lead("t").over(w), F.col("dur")), F.col("t") + F.lit(cap))
    return merge_spans(rows.select(*key, F.col("t").alias("s"), end.alias("e")), key)


def max_gap(speech: DataFrame, cover: DataFrame, keys: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key..., gap): the longest part of the speech without cover; 0 for a key of `keys` that has none."""
    gaps = subtract_spans(speech, cover, key).groupBy(*key).agg(F.max(F.col("e") - F.col("s")).alias("gap"))
    zero = F.lit(0).cast(gaps.schema["gap"].dataType)
    return keys.select(*key).distinct().join(gaps, key, "left").select(*key, F.coalesce("gap", zero).alias("gap"))


def span_length(s: Column, e: Column) -> Column:
    return F.greatest(e - s, F.lit(0))

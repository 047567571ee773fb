"""Joins along the time axis.

As-of joins are a union and one window: both sides meet sorted on (key, time), and the last right row is carried
forward. This is linear in the rows of a key, where a range join would be quadratic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions.frames import union_all


def _interleaved(left: DataFrame, right: DataFrame, key: list[str], left_t: str, right_t: str, right_order: list[str], take: list[str]) -> DataFrame:
    """Rows of both sides in one order: by time, right before left at equal times, right rows among themselves by
    `right_order`. Columns: key, _t, _side (1 is left), _left, _right, _o."""
    payload = F.struct(F.col(right_t).alias("_at"), *take)
    kind = lambda df, c: df.select(c.alias("_x")).schema["_x"].dataType
    whole, order = F.struct(*left.columns), F.struct(*right_order)
    l = left.select(*key, F.col(left_t).alias("_t"), F.lit(1).alias("_side"), whole.alias("_left"), F.lit(None).cast(kind(right, payload)).alias("_right"), F.lit(None).cast(kind(right, order)).alias("_o"))  # noqa: E741
    r = right.select(*key, F.col(right_t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(kind(left, whole)).alias("_left"), payload.alias("_right"), order.alias("_o"))
    return union_all(l, r)


def asof_backward(left: DataFrame, right: DataFrame, key: list[str], left_t: str, right_t: str, right_order: list[str], take: list[str], tolerance: float | None = None) -> DataFrame:
    """Each left row with `take` of the last right row at or before its time; ties go to the last in `right_order`.

    No left row is dropped: without a match, or beyond the tolerance, the taken columns are null.
    """
    w = Window.partitionBy(*key).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    met = _interleaved(left, right, key, left_t, right_t, right_order, take).withColumn("_got", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    near = F.lit(True) if tolerance is None else F.col("_t") - F.col("_got._at") <= tolerance
    return met.select("_left.*", *[F.when(near, F.col(f"_got.{c}")).alias(c) for c in take])


def assign_to_sections(segments: DataFrame, sections: DataFrame) -> DataFrame:
    """Each segment with `section`, the index of the last section that starts at or before it.

    A segment before the first section belongs to it; of sections with one start the last owns. Videos without sections
    give null. Nothing is dropped. Both directions are frames of one window, so there is one exchange.
    """
    w = Window.partitionBy("video_id").orderBy("_t", "_side", "_o")
    before = F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_right", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = _interleaved(segments, sections, ["video_id"], "t", "win_start", ["index"], ["index"])
    return both.withColumn("_own", F.coalesce(before, after)).where("_side = 1").select("_left.*", F.col("_own.index").alias("section"))


def uncited(links: DataFrame, cues: DataFrame, within: int = 1) -> DataFrame:
    """Links (video_id, sec, ...) further than `within` seconds from every cue second of their video (video_id, sec).

    Cue seconds are spread over their neighbourhood, which makes the band an equi-join. A video without cues passes.
    """
    near = cues.select("video_id", F.explode(F.sequence(F.col("sec") - within, F.col("sec") + within)).alias("sec")).distinct()
    have = cues.select("video_id").distinct()
    return links.join(near, ["video_id", "sec"], "left_anti").join(have, "video_id", "left_semi")


def upsert_runs(runs: DataFrame, updates: DataFrame, key: tuple[str, ...] = ("index",), order: str | None = None) -> DataFrame:
    """Update by key: status always, other fields where the update has them; unknown keys are appended.

    Several updates of one key take effect in the order of the column `order`: the last status, and of each other field the
    last value there is. Without that column they must agree. A session's runs have the key (session_id, index)."""
    fields = [c for c in runs.columns if c not in (*key, "status")]
    given = [c for c in fields if c in updates.columns]
    turn = F.col(order) if order else F.lit(0)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), turn)).alias(c) for c in given]
    u = updates.groupBy(*key).agg(F.max_by("status", turn).alias("status"), *last, F.lit(True).alias("_found")).alias("u")
    r = runs.alias("r")
    same = reduce(Column.__and__, (F.col(f"r.{k}") == F.col(f"u.{k}") for k in key))
    take = [(F.coalesce(f"u.{c}", f"r.{c}") if c in given else F.col(f"r.{c}")).alias(c) for c in fields]
    return r.join(u, same, "full").select(
        *[F.coalesce(f"r.{k}", f"u.{k}").alias(k) for k in key], F.when(F.col("u._found"), F.col("u.status")).otherwise(F.col("r.status")).alias("status"), *take
    )


def frame_actions(raw: DataFrame, final: DataFrame, keep: bool = False) -> DataFrame:
    """(path, action) of raw frames: finals stay (or are copied too, when raw frames are kept), others go (or move)."""
    paths = raw.select("path").distinct().join(final.select(F.col("path"), F.lit(True).alias("_final")).distinct(), "path", "left")
    return paths.select("path", F.when(F.col("_final"), "copy" if keep else "keep").otherwise("move" if keep else "delete").alias("action"))

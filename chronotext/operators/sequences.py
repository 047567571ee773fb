"""Operators on ordered sequences: windows where a row's fate depends on its neighbours, folds where it depends on what
was kept before.

Folds gather one video's rows in order and run inside the JVM (`aggregate`). A video's sequence is bounded by its own
length; `select_keyframes_grouped` streams a very long one through Python in order instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext import model
from chronotext.functions import scalars as S
from chronotext.functions.frames import union_all

def drop_repeats(segments: DataFrame) -> DataFrame:
    """Drop each cue whose text equals the one before it."""
    before = F.lag(F.struct("text")).over(Window.partitionBy("video_id").orderBy("seq"))
    return segments.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before.text").eqNullSafe(F.col("text"))).drop("_before")


def anchor_ids(segments: DataFrame) -> DataFrame:
    """Add `anchor`: tHHMMSS, with -n for the n-th cue of one second, in order."""
    base = S.anchor_base(F.col("t"))
    nth = F.row_number().over(Window.partitionBy("video_id", "_base").orderBy("seq"))
    out = segments.withColumn("_base", base).withColumn("_n", nth)
    return out.withColumn("anchor", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def section_hints(slides: DataFrame, videos: DataFrame, contract: model.Contract = model.CONTRACT) -> DataFrame:
    """(video_id, index, t, win_start, t_end, title, frame): a section for each slide, up to the next or the duration.

    Speech before the first slide gets an intro section, a video without slides one section."""
    w = Window.partitionBy("video_id").orderBy("t", "idx")
    rows = videos.select("video_id", "duration_sec").join(slides.select("video_id", "idx", "t", "frame", "ocr_text"), "video_id", "left")
    seen = rows.select(
        "video_id", "duration_sec", "t", "frame", "ocr_text", F.row_number().over(w).alias("_n"), F.first("t").over(w).alias("_first"), F.coalesce(F.lead("t").over(w), F.col("duration_sec")).alias("t_end")
    )
    named = S.first_line(F.col("ocr_text"), F.concat(F.lit(f"{contract.slide_title} "), F.col("_n").cast("string")))
    shift = F.when(F.col("_first") > 0, 1).otherwise(0)

    def section(index, t, end, title, frame):
        return F.struct(index.cast("int").alias("index"), t.alias("t"), t.alias("win_start"), end.cast("double").alias("t_end"), title.alias("title"), frame.cast("string").alias("frame"))

    zero, none = F.lit(0.0), F.lit(None)
    own = section(F.col("_n") - 1 + shift, F.col("t").cast("double"), F.col("t_end"), named, F.col("frame"))
    intro = section(F.lit(0), zero, F.col("t"), F.lit(contract.intro_title), none)
    whole = section(F.lit(0), zero, F.col("duration_sec"), F.lit(contract.whole_title), none)
    here = F.when(F.col("t").isNull(), F.array(whole)).when((F.col("_n") == 1) & (F.col("t") > 0), F.array(intro, own)).otherwise(F.array(own))
    return seen.select("video_id", F.explode(here).alias("_s")).select("video_id", "_s.*")


def renderable_sections(sections: DataFrame, assigned: DataFrame) -> DataFrame:
    """Sections that notes show, numbered from 1 in `section_no`: a video's only one, those with a frame or with speech."""
    counts = assigned.groupBy("video_id", F.col("section").alias("index")).agg(F.count("*").alias("_cues"))
    total = F.count("*").over(Window.partitionBy("video_id"))
    own = sections.withColumn("_total", total).join(counts, ["video_id", "index"], "left")
    shown = own.where((F.col("_total") == 1) | (F.coalesce("frame", F.lit("")) != "") | (F.col("_cues") > 0))
    return shown.withColumn("section_no", F.row_number().over(Window.partitionBy("video_id").orderBy("index"))).drop("_total", "_cues")


def keyframe_places(hashes: Column, distance: int = model.PHASH_DISTANCE, persistence: int = model.PHASH_PERSISTENCE) -> Column:
    """Places (from 0) of the keyframes of an array of 64-bit hashes.

    The first is kept. A hash far from the current keyframe opens a candidate; it becomes the keyframe, at the place where it
    first stood, once `persistence` frames in a row are near the candidate's first hash."""
    need = max(persistence, 1)
    empty = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("kept"), F.lit(None).cast("bigint").alias("cur"), F.lit(None).cast("bigint").alias("cand"), F.lit(-1).alias("at"), F.lit(0).alias("run"))

    def state(i, kept, cur, cand, at, run) -> Column:
        return F.struct(i.alias("i"), kept.alias("kept"), cur.alias("cur"), cand.alias("cand"), at.alias("at"), run.alias("run"))

    def step(acc: Column, h: Column) -> Column:
        i, none, off = acc["i"], F.lit(None).cast("bigint"), F.lit(-1)
        same = acc["cand"].isNotNull() & S.is_same_phash(acc["cand"], h, distance)
        first, count = F.when(same, acc["at"]).otherwise(i), F.when(same, acc["run"] + 1).otherwise(1)
        hash_ = F.when(same, acc["cand"]).otherwise(h)
        return (
            F.when(i == 0, state(i + 1, F.array(F.lit(0)), h, none, off, F.lit(0)))
            .when(S.is_same_phash(acc["cur"], h, distance), state(i + 1, acc["kept"], acc["cur"], none, off, F.lit(0)))
            .when(count >= need, state(i + 1, F.concat(acc["kept"], F.array(first)), hash_, none, off, F.lit(0)))
            .otherwise(state(i + 1, acc["kept"], acc["cur"], hash_, first, count))
        )

    return F.aggregate(hashes, empty, step, lambda acc: acc["kept"])


def select_keyframes(frames: DataFrame, distance: int = model.PHASH_DISTANCE, persistence: int = model.PHASH_PERSISTENCE) -> DataFrame:
    """(video_id, idx) of the keyframes of frames (video_id, idx, phash), in the order of idx."""
    rows = frames.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("idx", "phash"))).alias("_f"))
    places = rows.select("video_id", F.col("_f.idx").alias("_idx"), F.explode(keyframe_places(F.col("_f.phash"), distance, persistence)).alias("_at"))
    return places.select("video_id", F.get("_idx", F.col("_at")).alias("idx"))


def select_keyframes_grouped(frames: DataFrame, distance: int = model.PHASH_DISTANCE, persistence: int = model.PHASH_PERSISTENCE) -> DataFrame:
    """The same for sequences that are too long for one row: partitions are sorted by (video_id, idx) and read in batches,
    with the state of the video under way carried from batch to batch."""
    ordered = frames.select("video_id", "idx", "phash").repartition("video_id").sortWithinPartitions("video_id", "idx")
    schema = frames.select("video_id", "idx").schema

    def run(batches):
        import pyarrow as pa

        video, cur, cand, at, count = object(), 0, None, None, 0
        for batch in batches:
            keep_v, keep_i = [], []
            for v, i, h in zip(*(batch[c].to_pylist() for c in ("video_id", "idx", "phash")), strict=True):
                h &= (1 << 64) - 1
                if v != video:
                    video, cur, cand, count = v, h, None, 0
                    keep_v.append(v)
                    keep_i.append(i)
                elif (cur ^ h).bit_count() <= distance:
                    cand, count = None, 0
                else:
                    if cand is None or (cand ^ h).bit_count() > distance:
                        cand, at, count = h, i, 0
                    count += 1
                    if count >= max(persistence, 1):
                        keep_v.append(v)
                        keep_i.append(at)
                        cur, cand, count = cand, None, 0
            yield pa.record_batch([pa.array(keep_v, batch.schema.field("video_id").type), pa.array(keep_i, batch.schema.field("idx").type)], ["video_id", "idx"])

    return ordered.mapInArrow(run, schema)


def dedupe_frames(frames: DataFrame) -> DataFrame:
    """Keyframes with their hash as hex and the distance from the frame before; a video of one frame stays as it is."""
    w = Window.partitionBy("video_id").orderBy("idx")
    near = frames.withColumn("phash_hex", S.hash_hex(F.col("phash"))).withColumn("hamming_prev", S.hamming(F.lag("phash").over(w), F.col("phash")))
    return near.join(select_keyframes(frames), ["video_id", "idx"], "left_semi")


def select_by_pair_metrics(pairs: DataFrame, hist_same: float = model.HIST_SAME, ssim_same: float = model.SSIM_SAME) -> DataFrame:
    """(video_id, idx) kept: frame 0, and frame i + 1 where pair i (video_id, i, hist, ssim) isn't the same slide."""
    changed = pairs.where(~S.is_same_slide(F.col("hist"), F.col("ssim"), hist_same, ssim_same)).select("video_id", (F.col("i") + 1).alias("idx"))
    return union_all(changed, pairs.select("video_id").distinct().select("video_id", F.lit(0).cast(changed.schema["idx"].dataType).alias("idx")))


def slide_places(texts: Column, min_growth: float = model.MIN_GROWTH) -> Column:
    """Places (from 0) of the texts to keep: the first, then each that isn't a duplicate of the last one kept."""
    empty = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("lines"))
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("kept"), empty.alias("prev"))

    def step(acc: Column, form: Column) -> Column:
        keep = (acc["i"] == 0) | (S.transition_of(acc["prev"], form, min_growth) != "duplicate")
        return F.struct((acc["i"] + 1).alias("i"), F.when(keep, F.concat(acc["kept"], F.array(acc["i"]))).otherwise(acc["kept"]).alias("kept"), F.when(keep, form).otherwise(acc["prev"]).alias("prev"))

    # Forms are taken once a text, before the fold.
    return F.aggregate(F.transform(texts, S.slide_form), start, step, lambda acc: acc["kept"])


def dedupe_slides(slides: DataFrame, min_growth: float = model.MIN_GROWTH) -> DataFrame:
    """(video_id, idx) of slides (video_id, idx, ocr_text) that stay; build-ups stay, duplicates go."""
    rows = slides.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("idx", "ocr_text"))).alias("_s"))
    places = rows.select("video_id", F.col("_s.idx").alias("_idx"), F.explode(slide_places(F.col("_s.ocr_text"), min_growth)).alias("_at"))
    return places.select("video_id", F.get("_idx", F.col("_at")).alias("idx"))


def slides_from_frames(frames: DataFrame) -> DataFrame:
    """Frames with OCR text to slides: texts are normalised, those of too few characters go, then duplicates."""
    rows = frames.withColumn("ocr_text", S.collapse(F.col("ocr_text"))).where(S.is_slide(F.col("ocr_text")))
    return rows.join(dedupe_slides(rows), ["video_id", "idx"], "left_semi").withColumn("is_slide", F.lit(True))


def engine_used(frames: DataFrame) -> DataFrame:
    """(video_id, ocr_engine): the last engine of a video's frames (video_id, idx, engine) that isn't `none`."""
    real = F.when(F.col("engine") != "none", F.struct("idx", "engine"))
    return frames.groupBy("video_id").agg(F.coalesce(F.max(real)["engine"], F.lit("none")).alias("ocr_engine"))

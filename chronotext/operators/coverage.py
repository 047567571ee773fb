"""The completeness gate: speech gaps, scene coverage, artifacts, notes; a verdict for each video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext import model
from chronotext.functions.frames import union_all
from chronotext.operators.spans import cover_spans, max_gap

#: Reasons of a fallback to speech recognition.
UNUSABLE, UNUSABLE_END, FORCED = "captions present but unusable (", " cues)", "force_stt requested"


def gap_check(speech: DataFrame, cues: DataFrame, videos: DataFrame, threshold: float | int = model.MAX_GAP_SEC, cap: float | int = model.CUE_MAX_COVER_SEC) -> DataFrame:
    """(video_id, gap, threshold, passed) for each video (video_id, dur): the longest speech without a cue."""
    cover = cover_spans(cues, videos.select("video_id", "dur"), cap=cap)
    gaps = max_gap(speech, cover, videos)
    return gaps.select("video_id", "gap", F.lit(threshold).alias("threshold"), (F.col("gap") <= threshold).alias("passed"))


def captions_usable(segments: DataFrame, videos: DataFrame, least: int = model.MIN_CAPTIONS, chars: int = model.MIN_CAPTION_CHARS) -> DataFrame:
    """(video_id, n_cues, n_chars, usable, reason) for each video."""
    counts = segments.groupBy("video_id").agg(F.count("*").alias("n_cues"), F.sum(F.length("text")).alias("n_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = videos.select("video_id").distinct().join(counts, "video_id", "left").select("video_id", zero("n_cues"), zero("n_chars"))
    usable = (F.col("n_cues") >= least) & (F.col("n_chars") >= chars)
    reason = F.when(~usable, F.concat(F.lit(UNUSABLE), F.col("n_cues").cast("string"), F.lit(UNUSABLE_END)))
    return out.withColumn("usable", usable).withColumn("reason", reason)


def choose_track(captions: DataFrame, stt: DataFrame, videos: DataFrame, force_stt: bool = False, least: int = model.MIN_CAPTIONS, chars: int = model.MIN_CAPTION_CHARS) -> DataFrame:
    """Segments of each video from its captions where they are usable, else from speech recognition; `source` and the
    reason of the fallback are added."""
    verdict = captions_usable(captions, videos, least, chars).select("video_id", (F.lit(not force_stt) & F.col("usable")).alias("_use"), F.when(F.lit(force_stt), F.lit(FORCED)).otherwise(F.col("reason")).alias("fallback_reason"))
    columns = captions.columns
    pick = lambda df, use, source: df.join(verdict.where(F.col("_use") == use), "video_id").select(*columns, F.lit(source).alias("source"), "fallback_reason")
    return union_all(pick(captions, True, "caption"), pick(stt, False, "stt"))


def merge_metadata(videos: DataFrame, fetched: DataFrame) -> DataFrame:
    """Video columns, overridden by fetched metadata where it has a value."""
    v, m = videos.alias("v"), fetched.alias("m")
    return v.join(m, "video_id", "left").select("video_id", *[(F.coalesce(f"m.{c}", f"v.{c}") if c in fetched.columns else F.col(f"v.{c}")).alias(c) for c in videos.columns if c != "video_id"])


def slide_counts(slides: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, slides_total, slides_with_text)."""
    text = F.regexp_replace(F.coalesce("ocr_text", F.lit("")), r"(?U)\s+", "") != ""
    counts = slides.groupBy("video_id").agg(F.count("*").alias("slides_total"), F.count_if(text).alias("slides_with_text"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return videos.select("video_id").distinct().join(counts, "video_id", "left").select("video_id", zero("slides_total"), zero("slides_with_text"))


def covered_bins(speech: DataFrame, frames: DataFrame, videos: DataFrame, bins: int = model.SCENE_BINS, carry: float | int = model.FRAME_CARRY_MAX_SEC) -> DataFrame:
    """(video_id, bin, covered) of the bins that a speech span overlaps: covered where the last frame up to the bin's end is
    at most `carry` before its start.

    Spans and frames are dealt to bins of their own range together, and aggregated to a row a bin; a running maximum
    over a video's few bins carries the last frame on. No span meets a frame."""
    bins = max(bins, 1)
    width = F.col("dur") / F.lit(float(bins))
    kind = frames.schema["t"].dataType
    spans = speech.select("video_id", "s", "e", F.lit(None).cast(kind).alias("t"))
    points = frames.select("video_id", F.lit(None).cast(speech.schema["s"].dataType).alias("s"), F.lit(None).cast(speech.schema["e"].dataType).alias("e"), "t")
    rows = union_all(spans, points).join(videos.where("dur > 0").select("video_id", "dur"), "video_id")
    inside = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(bins - 1))
    near = lambda t, off: inside(F.floor(t / width).cast("int") + off)
    low, high = near(F.col("s"), -1), near(F.col("e"), 1)
    # A frame counts from the first bin whose end it doesn't pass; the bins around the guess decide, for rounding at an edge.
    guess = inside(F.ceil(F.col("t") / width).cast("int") - 2)
    first = inside(F.when(F.col("t") <= (guess + 1) * width, guess).when(F.col("t") <= (guess + 2) * width, guess + 1).otherwise(guess + 2))
    frame = (F.col("t") >= 0) & (F.col("t") <= F.col("dur"))
    where = F.when(frame, F.array(first)).when(F.col("t").isNull() & (low <= high), F.sequence(low, high))
    each = rows.withColumn("bin", F.explode(where)).withColumn("b0", F.col("bin") * width).withColumn("b1", (F.col("bin") + 1) * width)
    per = each.where("t is not null or (s < b1 and e > b0)").groupBy("video_id", "bin").agg(F.bool_or(F.col("t").isNull()).alias("_spoken"), F.max("t").alias("_t"), F.first("b0").alias("b0"))
    w = Window.partitionBy("video_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    held = per.withColumn("_last", F.max("_t").over(w)).where("_spoken")
    return held.select("video_id", "bin", F.coalesce(F.col("b0") - F.col("_last") <= carry, F.lit(False)).alias("covered"))


def scene_coverage(speech: DataFrame, frames: DataFrame, videos: DataFrame, slides: DataFrame | None = None, bins: int = model.SCENE_BINS, carry: float | int = model.FRAME_CARRY_MAX_SEC) -> DataFrame:
    """(video_id, bins, speech_bins, covered_bins, uncovered_bins, slides_total, slides_with_text, passed, vacuous).

    `frames` are the raw samples, before any de-duplication. `vacuous` marks a pass that had no speech to check."""
    pick = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("bin"))))
    found = covered_bins(speech, frames, videos, bins, carry).groupBy("video_id").agg(
        pick(F.lit(True)).alias("speech_bins"), pick(F.col("covered")).alias("covered_bins"), pick(~F.col("covered")).alias("uncovered_bins")
    )
    none = F.array().cast("array<int>")
    arrays = [F.coalesce(c, none).alias(c) for c in ("speech_bins", "covered_bins", "uncovered_bins")]
    counts = slide_counts(slides, videos) if slides is not None else videos.select("video_id", F.lit(0).cast("bigint").alias("slides_total"), F.lit(0).cast("bigint").alias("slides_with_text")).distinct()
    out = counts.join(found, "video_id", "left").select("video_id", F.lit(max(bins, 1)).alias("bins"), *arrays, "slides_total", "slides_with_text")
    return out.withColumn("passed", (F.size("uncovered_bins") == 0) & (F.col("slides_with_text") >= F.col("slides_total"))).withColumn("vacuous", F.size("speech_bins") == 0)


def nonempty(text: Column, size: Column | None = None) -> Column:
    """Whether an artifact has content: by its text where that is given, else by its file's size."""
    by_text = F.regexp_replace(text, r"(?U)\s+", "") != ""
    return F.coalesce(by_text, F.lit(False) if size is None else F.coalesce(size, F.lit(0)) > 0)


def artifact_check(docs: DataFrame) -> DataFrame:
    """(video_id, transcript_nonempty, notes_nonempty, passed) of docs (video_id, transcript, notes[, sizes])."""
    size = lambda c: F.col(c) if c in docs.columns else None
    t, n = nonempty(F.col("transcript"), size("transcript_size")), nonempty(F.col("notes"), size("notes_size"))
    return docs.select("video_id", t.alias("transcript_nonempty"), n.alias("notes_nonempty"), (t & n).alias("passed"))


def build_coverage(videos: DataFrame, gaps: DataFrame, scenes: DataFrame, artifacts: DataFrame, problems: DataFrame | None = None, engines: DataFrame | None = None) -> DataFrame:
    """One row a video with the four checks as structs and their conjunction, `overall_pass`.

    A check without a row for a video counts as failed; without `problems` (video_id, rule, ...) notes aren't checked and pass."""
    part = lambda df, name: df.select("video_id", F.struct(*[c for c in df.columns if c != "video_id"]).alias(name))
    out = videos.join(part(gaps, "gap_check"), "video_id", "left").join(part(scenes, "scene_coverage"), "video_id", "left").join(part(artifacts, "artifacts"), "video_id", "left")
    if problems is None:
        out = out.withColumn("notes_contract", F.struct(F.lit(False).alias("checked"), F.array().cast("array<string>").alias("problems"), F.lit(True).alias("passed")))
    else:
        rules = problems.groupBy("video_id").agg(F.array_sort(F.collect_list("rule")).alias("_p"))
        out = out.join(rules, "video_id", "left").withColumn("_p", F.coalesce("_p", F.array().cast("array<string>")))
        out = out.withColumn("notes_contract", F.struct(F.lit(True).alias("checked"), F.col("_p").alias("problems"), (F.size("_p") == 0).alias("passed"))).drop("_p")
    if engines is not None:
        out = out.join(engines, "video_id", "left")
    passed = [F.coalesce(F.col(f"{c}.passed"), F.lit(False)) for c in ("gap_check", "scene_coverage", "artifacts", "notes_contract")]
    engine = F.coalesce("ocr_engine", F.lit("none")) if engines is not None else F.lit("none")
    return out.withColumn("ocr_engine", engine).withColumn("schema_version", F.lit(model.SCHEMA_VERSION)).withColumn("overall_pass", passed[0] & passed[1] & passed[2] & passed[3])


def coverage_of_extraction(
    *, videos: DataFrame, segments: DataFrame, speech: DataFrame, raw_frames: DataFrame, slides: DataFrame, documents: DataFrame, problems: DataFrame | None = None, engines: DataFrame | None = None
) -> DataFrame:
    """The coverage of what an extraction made, table by table and by name, so that no two can be taken for each other:
    `raw_frames` (video_id, t) are all samples, before any de-duplication, `slides` what was kept. Videos have `dur`."""
    gaps = gap_check(speech, segments, videos)
    scenes = scene_coverage(speech, raw_frames, videos, slides)
    return build_coverage(videos, gaps, scenes, artifact_check(documents), problems, engines)


def batch_verdict(coverage: DataFrame) -> DataFrame:
    """One row (n, n_failed, passed, exit_code) over all videos; an empty batch passes."""
    ok = F.coalesce("overall_pass", F.lit(False))
    out = coverage.agg(F.count("*").alias("n"), F.count_if(~ok).alias("n_failed"))
    return out.select("n", "n_failed", (F.col("n_failed") == 0).alias("passed"), F.when(F.col("n_failed") == 0, 0).otherwise(2).alias("exit_code"))

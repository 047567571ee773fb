"""Caption, metadata, silence and frame sources: raw text or files in, flat rows out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext import model
from chronotext.functions import scalars as S
from chronotext.operators.sequences import drop_repeats
from chronotext.operators.spans import complement_spans

#: Patterns of caption times and of silence lines.
CUE_TIME = r"(\d{1,2}):(\d{2}):(\d{2})[.,](\d{1,3})"
SILENCE_START, SILENCE_END = r"silence_start:\s*([0-9.]+)", r"silence_end:\s*([0-9.]+)"


def _numbered(rows: DataFrame) -> DataFrame:
    """Number rows (video_id, _pos, t, text) from 0 and drop repeats of the text before."""
    w = Window.partitionBy("video_id").orderBy("_pos")
    return drop_repeats(rows.withColumn("seq", F.row_number().over(w) - 1)).select("video_id", "seq", "t", "text")


def cue_start(line: Column) -> Column:
    """Start of a cue line in seconds; 0 where no time can be read."""
    part = lambda i: F.regexp_extract(line, CUE_TIME, i)
    ms = F.rpad(part(4), 3, "0").cast("int")
    whole = part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int")
    return F.when(part(1) == "", F.lit(0.0)).otherwise(whole + ms / F.lit(1000.0))


def parse_vtt(files: DataFrame) -> DataFrame:
    """Segments of caption files (video_id, body) in WebVTT or SRT form.

    A line with an arrow opens a cue; its text goes to the next blank line or arrow. Tags go, white space is collapsed."""
    raw = F.split(F.replace(F.col("body"), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    lines = files.select("video_id", F.posexplode(raw).alias("_pos", "_line"))
    w = Window.partitionBy("video_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    arrow = F.contains("_line", F.lit("-->"))
    cued = lines.withColumn("_arrow", arrow).withColumn("_cue", F.sum(F.when(arrow, 1).otherwise(0)).over(w)).where("_cue > 0")
    inside = Window.partitionBy("video_id", "_cue").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.sum(F.when(~F.col("_arrow") & (S.strip(F.col("_line")) == ""), 1).otherwise(0)).over(inside)
    body = cued.withColumn("_after", blank).where("_after = 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_arrow"), F.struct("_pos", S.strip(F.col("_line")).alias("l"))))), lambda x: x["l"]), " ")
    cues = body.groupBy("video_id", "_cue").agg(F.min("_pos").alias("_pos"), F.max(F.when(F.col("_arrow"), cue_start(F.col("_line")))).alias("t"), text.alias("text"))
    return _numbered(cues.withColumn("text", S.collapse(S.strip_tags(F.col("text")))).where("text <> ''"))


JSON3 = "events array<struct<tStartMs: bigint, segs: array<struct<utf8: string>>>>"


def parse_json3(files: DataFrame, strict: bool = True) -> DataFrame:
    """Segments of json3 caption files (video_id, body); text that isn't JSON is an error, or skipped if not strict."""
    data = F.from_json("body", JSON3, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    events = files.select("video_id", F.posexplode(data["events"]).alias("_pos", "_e")).where(F.size("_e.segs") > 0)
    text = F.array_join(F.transform("_e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
    rows = events.select("video_id", "_pos", (F.coalesce("_e.tStartMs", F.lit(0)) / F.lit(1000.0)).alias("t"), S.collapse(text).alias("text"))
    return _numbered(rows.where("text <> ''"))


def staged_captions(segments: DataFrame, languages: tuple[str, ...] = ("ko", "en")) -> DataFrame:
    """Segments of captions fetched before (video_id, language, seq, t, text), in each video's first language that is there."""
    rank = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("language"))
    ranked = segments.withColumn("_r", rank).where("_r > 0")
    best = ranked.groupBy("video_id").agg(F.min("_r").alias("_best"))
    rows = ranked.join(best, "video_id").where("_r = _best").select("video_id", F.col("seq").alias("_pos"), "t", S.collapse(F.col("text")).alias("text"))
    return _numbered(rows.where("text <> ''"))


def json_object(body: Column) -> Column:
    """The text of a JSON object; any other text, also of another JSON value, is an error."""
    opens = F.regexp_extract(body, r"(?s)^\s*(\{)", 1) == "{"
    good = opens & F.from_json(body, "map<string,string>", {"mode": "FAILFAST"}).isNotNull()
    return F.when(good, body).otherwise(F.raise_error(F.lit("metadata must be a JSON object")))


def parse_metadata(files: DataFrame) -> DataFrame:
    """(video_id, title, duration, media_id) of captured metadata JSON (video_id, body[, url]); what is blank or not positive
    is null, but for the id, which is then the URL's.

    Text that isn't a JSON object is an error."""
    get = lambda k: F.get_json_object("body", f"$.{k}")
    text = lambda c: F.nullif(S.strip(c), F.lit(""))
    duration = get("duration").try_cast("double")
    falsy = lambda c: F.when(~c.isin("", "0", "0.0", "false"), c)
    from_url = S.video_id_of(F.col("url")) if "url" in files.columns else F.lit(None).cast("string")
    rows = files.where(json_object(F.col("body")).isNotNull())
    return rows.select("video_id", text(get("title")).alias("title"), F.when(duration > 0, duration).alias("duration"), F.coalesce(text(F.coalesce(falsy(get("id")), get("display_id"))), from_url).alias("media_id"))


def parse_silence(logs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Speech spans (video_id, s, e) of silence logs (video_id, body, dur): the complement of the silences in [0, dur].

    A later start overwrites one that waits for its end; an end without a start counts from 0, a start without an end to the
    duration."""
    rows = logs.select("video_id", "dur", F.posexplode(S.lines(F.col("body"))).alias("pos", "line"))
    number = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit("")).try_cast("double")
    marks = rows.select("video_id", "dur", "pos", number(SILENCE_START).alias("a"), number(SILENCE_END).alias("b")).where("a is not null or b is not null")
    w = Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    grouped = marks.withColumn("_g", F.coalesce(F.sum(F.when(F.col("b").isNotNull(), 1).otherwise(0)).over(w), F.lit(0)))
    pairs = grouped.groupBy("video_id", "dur", "_g").agg(F.max_by("a", F.when(F.col("a").isNotNull(), F.col("pos"))).alias("a"), F.max("b").alias("b"))
    silent = pairs.select("video_id", F.coalesce("a", F.lit(0.0)).alias("s"), F.coalesce("b", "dur").cast("double").alias("e"))
    bounds = logs.select("video_id", F.lit(0.0).alias("lo"), F.col("dur").cast("double").alias("hi")).distinct()
    return complement_spans(silent, bounds)


def detect_speech(logs: DataFrame) -> DataFrame:
    """Speech spans of the logs of a silence detector (video_id, body, dur, exit_code). A run that failed is an error: its log would
    pass for a video that is all speech."""
    failed = F.raise_error(F.concat(F.lit("the silence detector failed for "), F.col("video_id"), F.lit(" with code "), F.coalesce(F.col("exit_code").cast("string"), F.lit("null"))))
    return parse_silence(logs.withColumn("body", F.when(F.col("exit_code") == 0, F.col("body")).otherwise(failed.cast("string"))))


def read_frames(spark: SparkSession, folder: str, fps: float = model.SAMPLE_FPS) -> DataFrame:
    """(path, t, ts_source, content) of frame_*.png files below a folder, times taken from their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.png").option("recursiveFileLookup", "true").load(folder)
    at = S.frame_time(F.col("path"), fps)
    return files.select("path", at["t"].alias("t"), at["source"].alias("ts_source"), "content")


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, body) of whole text files."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def run_fetcher(videos: DataFrame, make_fetch, strict: bool = True) -> DataFrame:
    """(video_id, path, warning) of the media of videos (video_id, url) by a download engine, made once in each task: url -> path
    in storage that all executors share. Without a path a video is an error, or, if not strict, a row with the reason."""

    def run(batches):
        import pyarrow as pa

        fetch = make_fetch()
        for batch in batches:
            paths, warnings = [], []
            for video, url in zip(batch["video_id"].to_pylist(), batch["url"].to_pylist(), strict=True):
                try:
                    path, warning = fetch(url), None
                    if not path:
                        raise FileNotFoundError(f"nothing was fetched from {url}")
                except Exception as e:
                    if strict:
                        raise RuntimeError(f"video {video}: {e}") from e
                    path, warning = None, f"{type(e).__name__}: {e}"
                paths.append(path)
                warnings.append(warning)
            yield pa.record_batch([batch["video_id"], pa.array(paths, pa.string()), pa.array(warnings, pa.string())], ["video_id", "path", "warning"])

    rows = videos.select("video_id", "url")
    return rows.mapInArrow(run, rows.select("video_id").schema.add("path", "string").add("warning", "string"))


def run_transcriber(audio: DataFrame, make_engine) -> DataFrame:
    """Segments of audio files (video_id, path) by a speech engine, made once in each task: path -> [(t, text)]."""

    def run(batches):
        import pandas as pd

        engine = make_engine()
        for pdf in batches:
            rows = [(v, i, float(t), text) for v, path in zip(pdf["video_id"], pdf["path"], strict=True) for i, (t, text) in enumerate(engine(path))]
            yield pd.DataFrame(rows, columns=["video_id", "seq", "t", "text"])

    raw = audio.select("video_id", "path").mapInPandas(run, model.SEGMENTS)
    return raw.withColumn("text", S.collapse(F.col("text"))).where("text <> ''")


def run_ocr(frames: DataFrame, make_engines) -> DataFrame:
    """Add ocr_text, engine and warning to frames (..., path): the first engine that reads the image. Engines are (name,
    function) pairs, made once in each task; a failing one is passed over, and the warning says why."""
    schema = frames.select("*").schema.add("ocr_text", "string").add("engine", "string").add("warning", "string")

    def run(batches):
        engines = make_engines()
        for pdf in batches:
            texts, names, warnings = [], [], []
            for path in pdf["path"]:
                text, used, failed = "", "none", []
                for name, read in engines:
                    try:
                        text, used = read(path), name
                        break
                    except Exception as e:  # noqa: BLE001  any failure of one engine means the next
                        failed.append(f"{name}: {type(e).__name__}: {e}")
                texts.append(text)
                names.append(used)
                warnings.append("; ".join(failed) or None)
            yield pdf.assign(ocr_text=texts, engine=names, warning=warnings)

    return frames.mapInPandas(run, schema)


def checked_engine(version: str | None, supported: str = ">=2.7,<3") -> None:
    """Raise where an OCR engine's version is outside the versions whose calls it is used with; unknown ones pass."""
    inside = lambda v, sign, bound: {">=": v >= bound, "<": v < bound}[sign]
    own = [int(x) for x in re.findall(r"\d+", (version or "").split("+")[0])[:3]]
    for sign, bound in re.findall(r"(>=|<)\s*([0-9.]+)", supported):
        if own and not inside(own, sign, [int(x) for x in bound.split(".")]):
            raise RuntimeError(f"OCR engine {version} is outside {supported}")

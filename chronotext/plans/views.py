"""Views that bind the operators to tables at hand: events become cues, speech and frames; conversations become captions
and slides; embeddings become hashed frames. The same definitions stand as SQL beside the DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One hour, in the milliseconds that thirty days of events are mapped to.
HOUR_MS = 3_600_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, t, text, value, ts, event_id): events at whole milliseconds of their video."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 720000")
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"), t.alias("t"), F.col("event_type").alias("text"), "value", "ts", "event_id")


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("ts", "event_id")
    return timeline(spark, sf_dir).withColumn("seq", (F.row_number().over(w) - 1).cast("bigint")).select("video_id", "seq", "t", "text")


def event_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).select("video_id").distinct().withColumn("dur", F.lit(HOUR_MS).cast("bigint"))


def event_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.least(F.col("t") + F.round(F.col("value") * 500).cast("bigint"), F.lit(HOUR_MS).cast("bigint"))
    return timeline(spark, sf_dir).where("text in ('view', 'click')").select("video_id", F.col("t").alias("s"), end.alias("e"))


def event_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).where("text <> 'view'").select("video_id", "t")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).where("text in ('purchase', 'signup')").select("video_id", "t", "event_id")


EVENTS_SQL = f"""
evt AS (SELECT CAST(user_id AS VARCHAR) AS video_id, (epoch_us(ts) - 1704067200000000) // 720000 AS t, event_type AS text, value, ts, event_id FROM events),
seg AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ts, event_id) - 1 AS seq, t, text FROM evt),
vid AS (SELECT DISTINCT video_id, {HOUR_MS} AS dur FROM evt),
speech AS (SELECT video_id, t AS s, least(t + CAST(round(value * 500) AS BIGINT), {HOUR_MS}) AS e FROM evt WHERE text IN ('view', 'click')),
cue AS (SELECT video_id, t FROM evt WHERE text <> 'view'),
frame AS (SELECT video_id, t, event_id FROM evt WHERE text IN ('purchase', 'signup'))"""


def merged_sql(name: str, source: str) -> str:
    """CTEs that merge the spans of `source` (video_id, s, e)."""
    return f"""
{name}_o AS (SELECT video_id, s, e, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE e > s),
{name}_n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_o),
{name} AS (SELECT video_id, min(s) AS s, max(e) AS e FROM {name}_n GROUP BY video_id, island)"""


COVER_SQL = f"""
cue_end AS (SELECT video_id, t AS s, least(coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY t), {HOUR_MS}), t + 30000) AS e FROM cue WHERE t BETWEEN 0 AND {HOUR_MS}),
{merged_sql("cover", "cue_end").strip()}"""

#: Speech less cover: every gap of the cover meets the speech that it overlaps.
UNCOVERED_SQL = """
holes AS (SELECT video_id, e AS s, lead(s) OVER (PARTITION BY video_id ORDER BY s, e) AS e
  FROM (SELECT video_id, s, e FROM cover UNION ALL SELECT video_id, -1, -1 FROM vid UNION ALL SELECT video_id, 4000000000, 4000000000 FROM vid)),
uncovered AS (SELECT m.video_id, greatest(m.s, h.s) AS s, least(m.e, h.e) AS e FROM merged m JOIN holes h ON m.video_id = h.video_id AND h.s < m.e AND h.e > m.s)"""


def conversation_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(((F.max("turn") + 1) * F.lit(45.0)).alias("duration_sec"))
    name = F.col("conv_id").cast("string")
    return per.select(name.alias("video_id"), F.concat(F.lit("Talk [no. "), name, F.lit("] | "), (F.col("conv_id") % 9).cast("string")).alias("title"), "duration_sec", F.when(F.col("conv_id") % 2 == 0, "caption").otherwise("stt").alias("source"))


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn") * F.lit(45.0) + (F.col("conv_id") % 7)
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("seq"), t.cast("double").alias("t"), "text")


def conversation_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer shows a slide; a talk without one has none."""
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    t = F.when(F.col("conv_id") % 4 == 0, (F.col("turn") - 1) * F.lit(45.0)).otherwise(F.col("turn") * F.lit(45.0) + 5.0)
    frame = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("frames/frame_"), F.col("turn").cast("string"), F.lit(".png")))
    return rows.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("idx"), t.alias("t"), frame.alias("frame"), F.col("text").alias("ocr_text"))


TALKS_SQL = r"""
talk AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, 'Talk [no. ' || conv_id || '] | ' || (conv_id % 9) AS title, (max(turn) + 1) * CAST(45 AS DOUBLE) AS duration_sec,
  CASE WHEN conv_id % 2 = 0 THEN 'caption' ELSE 'stt' END AS source FROM conversations GROUP BY conv_id),
line AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS seq, CAST(turn * 45 + conv_id % 7 AS DOUBLE) AS t, text FROM conversations),
slide AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS idx, CAST(CASE WHEN conv_id % 4 = 0 THEN (turn - 1) * 45 ELSE turn * 45 + 5 END AS DOUBLE) AS t,
  CASE WHEN conv_id % 3 <> 0 THEN 'frames/frame_' || turn || '.png' END AS frame, text AS ocr_text FROM conversations WHERE role = 'assistant')"""


def stamp_sql(t: str) -> str:
    """HH:MM:SS of seconds."""
    n = f"CAST(greatest(round_even({t}, 0), 0) AS BIGINT)"
    return f"(lpad(CAST({n} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({n} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({n} % 60 AS VARCHAR), 2, '0'))"


def hashed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as blocks of 64 coefficients; video is the label, and each frame stays 1 to 3 samples."""
    from chronotext.operators.kernels import phash_of_coefficients

    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("video_id"), "vec_id", phash_of_coefficients(F.col("embedding")).alias("phash"))
    each = rows.select("video_id", "vec_id", "phash", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("vec_id") % 3)).alias("dwell"))
    w = Window.partitionBy("video_id").orderBy("vec_id", "dwell")
    return each.select("video_id", (F.row_number().over(w) - 1).alias("idx"), "vec_id", "dwell", "phash")


BITS_SQL = """
bits AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > list_sort(embedding[2:64])[32] THEN 1 ELSE 0 END) AS b FROM embeddings)"""

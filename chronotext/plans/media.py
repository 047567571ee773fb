"""Queries on frames, hashes, slides, images and raw caption sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions import scalars as S
from chronotext.operators import gate as G
from chronotext.operators import kernels as K
from chronotext.operators import sequences as Q
from chronotext.operators import temporal as T
from chronotext.plans import views as V
from chronotext.sources import captions as P

SQL: dict[str, str] = {}


def phash_bits(spark: SparkSession, d: str) -> DataFrame:
    h = K.phash_of_coefficients(F.col("embedding"))
    return V.read(spark, d, "embeddings").select("vec_id", h.alias("h")).select("vec_id", F.lpad(F.bin("h"), 64, "0").alias("bits"), F.bit_count("h").alias("ones"), F.length(S.hash_hex(F.col("h"))).alias("hex_digits"))


SQL["phash_bits"] = f"WITH {V.BITS_SQL} SELECT vec_id, array_to_string(b, '') AS bits, CAST(list_sum(b) AS INTEGER) AS ones, 16 AS hex_digits FROM bits"


def hamming_previous(spark: SparkSession, d: str) -> DataFrame:
    frames = V.hashed_frames(spark, d).where("dwell = 0")
    h = S.hamming(F.lag("phash").over(Window.partitionBy("video_id").orderBy("idx")), F.col("phash"))
    return frames.select("vec_id", F.coalesce(h, F.lit(-1)).alias("distance"), F.coalesce(h <= 12, F.lit(False)).alias("same"))


SQL["hamming_previous"] = f"""WITH {V.BITS_SQL}, l AS (SELECT vec_id, b, lag(b) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM bits),
x AS (SELECT vec_id, CASE WHEN p IS NOT NULL THEN CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN b[i] <> p[i] THEN 1 ELSE 0 END)) AS INTEGER) ELSE -1 END AS distance FROM l) SELECT vec_id, distance, distance BETWEEN 0 AND 12 AS same FROM x"""


def keyframes(spark: SparkSession, d: str) -> DataFrame:
    frames = V.hashed_frames(spark, d)
    return Q.select_keyframes(frames).join(frames, ["video_id", "idx"]).select("video_id", "vec_id", "dwell")


#: A fold over the frames of each label, one step a frame: the state is the keyframe, the candidate and its run.
SQL["keyframes"] = f"""WITH RECURSIVE {V.BITS_SQL},
f AS (SELECT CAST(label AS VARCHAR) AS video_id, vec_id, k AS dwell, b, row_number() OVER (PARTITION BY label ORDER BY vec_id, k) AS n FROM bits, range(3) AS r(k) WHERE k <= vec_id % 3),
walk AS (SELECT video_id, n, b AS cur, CAST(NULL AS INTEGER[]) AS cand, CAST(NULL AS BIGINT) AS spot, 0 AS run, n AS kept FROM f WHERE n = 1
  UNION ALL SELECT video_id, n, CASE WHEN hit THEN nc ELSE cur END, CASE WHEN near OR hit THEN NULL ELSE nc END, CASE WHEN near OR hit THEN NULL ELSE na END, CASE WHEN near OR hit THEN 0 ELSE nr END, CASE WHEN hit THEN na END
  FROM (SELECT *, NOT near AND nr >= 2 AS hit FROM (SELECT w.video_id, f.n, cur, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN f.b[i] <> cur[i] THEN 1 ELSE 0 END)) <= 12 AS near,
    CASE WHEN cand IS NOT NULL AND list_sum(list_transform(range(1, 65), lambda i: CASE WHEN f.b[i] <> cand[i] THEN 1 ELSE 0 END)) <= 12 THEN cand ELSE f.b END AS nc,
    CASE WHEN cand IS NOT NULL AND list_sum(list_transform(range(1, 65), lambda i: CASE WHEN f.b[i] <> cand[i] THEN 1 ELSE 0 END)) <= 12 THEN spot ELSE f.n END AS na,
    CASE WHEN cand IS NOT NULL AND list_sum(list_transform(range(1, 65), lambda i: CASE WHEN f.b[i] <> cand[i] THEN 1 ELSE 0 END)) <= 12 THEN run + 1 ELSE 1 END AS nr
    FROM walk w JOIN f ON f.video_id = w.video_id AND f.n = w.n + 1)))
SELECT walk.video_id, f.vec_id, f.dwell FROM walk JOIN f ON f.video_id = walk.video_id AND f.n = walk.kept WHERE kept IS NOT NULL"""


def keyframes_grouped(spark: SparkSession, d: str) -> DataFrame:
    frames = V.hashed_frames(spark, d)
    return Q.select_keyframes_grouped(frames).join(frames, ["video_id", "idx"]).select("video_id", "vec_id", "dwell")


SQL["keyframes_grouped"] = SQL["keyframes"]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    rows = V.event_segments(spark, d).join(V.timeline(spark, d).select("video_id", "t", F.col("value")).groupBy("video_id", "t").agg(F.max("value").alias("value")), ["video_id", "t"])
    return rows.select("video_id", F.col("seq").alias("i"), (F.lit(0.85) + v % 16 / 100).alias("hist"), (F.lit(0.87) + v % 13 / 100).alias("ssim"))


def pair_selection(spark: SparkSession, d: str) -> DataFrame:
    return Q.select_by_pair_metrics(_pairs(spark, d))


SQL["pair_selection"] = f"""WITH {V.EVENTS_SQL}, m AS (SELECT video_id, t, max(value) AS v FROM evt GROUP BY video_id, t),
p AS (SELECT video_id, seq AS i, CAST(0.85 AS DOUBLE) + v % 16 / 100 AS hist, CAST(0.87 AS DOUBLE) + v % 13 / 100 AS ssim FROM seg JOIN m USING (video_id, t))
SELECT video_id, i + 1 AS idx FROM p WHERE NOT (hist >= CAST(0.90 AS DOUBLE) AND ssim >= CAST(0.92 AS DOUBLE)) UNION ALL SELECT DISTINCT video_id, 0 FROM p"""


def incremental_slides(spark: SparkSession, d: str) -> DataFrame:
    """All lines of each document as slides that build up over four lines, then begin anew."""
    rows = V.read(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.split("text", "\n", -1).alias("lines"))
    each = rows.select("video_id", "lines", F.explode(F.sequence(F.lit(1), F.size("lines"))).alias("idx"))
    begin = F.col("idx") - (F.col("idx") - 1) % 4
    slides = each.select("video_id", "idx", F.array_join(F.slice("lines", begin, F.col("idx") - begin + 1), "\n").alias("ocr_text"))
    return Q.dedupe_slides(slides).select(F.col("video_id").alias("doc_id"), F.col("idx").alias("k"))


_SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _norm(column: str) -> str:
    """SQL for a text whose runs of white space are one space, stripped."""
    return f"trim(regexp_replace({column}, '{_SPACE}+', ' ', 'g'))"


SQL["incremental_slides"] = f"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM l),
s AS (SELECT doc_id, k, {_norm("array_to_string(ls[k - (k - 1) % 4:k], chr(10))")} AS c, list_filter(list_transform(ls[k - (k - 1) % 4:k], lambda x: {_norm("x")}), lambda x: x <> '') AS cl FROM e),
walk AS (SELECT doc_id, k, c AS p, cl AS pl, true AS kept FROM s WHERE k = 1
  UNION ALL SELECT doc_id, k, CASE WHEN new THEN c ELSE p END, CASE WHEN new THEN cl ELSE pl END, new FROM (
    SELECT s.doc_id, s.k, c, cl, p, pl, CASE WHEN c = p THEN false WHEN c = '' OR p = '' THEN true WHEN (len(pl) > 0 AND list_has_all(cl, pl)) OR starts_with(c, p) THEN (length(c) - length(p)) / length(c) >= CAST(0.15 AS DOUBLE) ELSE true END AS new
    FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.k = w.k + 1))
SELECT doc_id, CAST(k AS INTEGER) AS k FROM walk WHERE kept"""


def slides_from_frames(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each document as the OCR of frames that build up over three lines."""
    rows = V.read(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.split("text", "\n", -1).alias("lines"))
    each = rows.select("video_id", "lines", F.explode(F.sequence(F.lit(1), F.size("lines"))).alias("idx"))
    begin = F.col("idx") - (F.col("idx") - 1) % 3
    frames = each.select("video_id", "idx", F.array_join(F.slice("lines", begin, F.col("idx") - begin + 1), "\n").alias("ocr_text"))
    return Q.slides_from_frames(frames).select(F.col("video_id").alias("doc_id"), F.col("idx").alias("k"), F.md5(F.col("ocr_text").cast("binary")).alias("text_md5"), "is_slide")


SQL["slides_from_frames"] = f"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM l),
s AS (SELECT doc_id, k, {_norm("array_to_string(ls[k - (k - 1) % 3:k], chr(10))")} AS c FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM s WHERE length(replace(c, ' ', '')) >= 12),
walk AS (SELECT doc_id, n, k, c, c AS p, true AS kept FROM f WHERE n = 1
  UNION ALL SELECT doc_id, n, k, c, CASE WHEN new THEN c ELSE p END, new FROM (
    SELECT f.doc_id, f.n, f.k, f.c, p, CASE WHEN f.c = p THEN false WHEN starts_with(f.c, p) THEN (length(f.c) - length(p)) / length(f.c) >= CAST(0.15 AS DOUBLE) ELSE true END AS new FROM walk w JOIN f ON f.doc_id = w.doc_id AND f.n = w.n + 1))
SELECT doc_id, CAST(k AS INTEGER) AS k, md5(c) AS text_md5, true AS is_slide FROM walk WHERE kept"""


def image_frames(spark: SparkSession, d: str) -> DataFrame:
    """(video_id, idx, content): embeddings painted as gray PGM files of 32 x 32, coefficients as squares of 16 pixels; of
    each fortieth the content is cut off."""
    level = lambda i: F.rint(F.least(F.greatest(128 + 40 * F.get("embedding", F.floor(i / 128).cast("int") * 8 + F.floor(i % 32 / 4).cast("int")), F.lit(0)), F.lit(255))).cast("bigint")
    pixels = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.lpad(F.hex(level(i)), 2, "0")), "")
    head = "".join(f"{b:02X}" for b in b"P5 32 32 255\n")
    content = F.unhex(F.when(F.col("vec_id") % 40 == 7, F.lit(head)).otherwise(F.concat(F.lit(head), pixels)))
    w = Window.partitionBy("label").orderBy("vec_id")
    return V.read(spark, d, "embeddings").select(F.col("label").cast("string").alias("video_id"), (F.row_number().over(w) - 1).alias("idx"), content.alias("content"))


def frame_files(spark: SparkSession, d: str) -> DataFrame:
    """Image files to hashes and keyframes; files that can't be read are left out."""
    return Q.dedupe_frames(K.phash_files(image_frames(spark, d)).where("phash is not null")).select("video_id", "idx", "phash_hex", "hamming_prev")


def frame_pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    return K.frame_pairs(image_frames(spark, d)).select("video_id", "i", F.round("hist", 6).alias("hist"), F.round("ssim", 6).alias("ssim"))


def ocr_inputs(spark: SparkSession, d: str) -> DataFrame:
    out = K.prepare_files_for_ocr(image_frames(spark, d))
    return out.select("video_id", "idx", F.length("prepared").alias("size"), F.md5("prepared").alias("prepared_md5"), "warning")


#: Queries whose kernels SQL can't express; tests hold them to other implementations.
NO_SQL = ("frame_files", "frame_pair_metrics", "ocr_inputs")


def slide_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation line against the one before, joined to it in turns, so that all kinds of transition occur."""
    rows = V.conversation_segments(spark, d)
    n = F.col("seq") % 4
    cur = F.when(n == 0, F.col("text")).when(n == 1, F.concat("text", F.lit("\n"), "text", F.lit("!"))).when(n == 2, F.concat("text", F.lit(" ."))).otherwise(F.concat(F.lit("x"), "text"))
    prev = F.when(F.col("seq") % 5 == 4, F.lit(" ")).otherwise(F.col("text"))
    return rows.select("video_id", "seq", S.slide_transition(prev, cur).alias("kind"))


SQL["slide_transitions"] = f"""WITH {V.TALKS_SQL}, x AS (SELECT video_id, seq, CASE WHEN seq % 5 = 4 THEN '' ELSE {_norm("text")} END AS p,
  CASE seq % 4 WHEN 0 THEN {_norm("text")} WHEN 1 THEN {_norm("text || chr(10) || text || '!'")} WHEN 2 THEN {_norm("text || ' .'")} ELSE {_norm("'x' || text")} END AS c FROM line)
SELECT video_id, seq, CASE WHEN c = '' AND p = '' THEN 'duplicate' WHEN c = '' OR p = '' THEN 'new' WHEN c = p THEN 'duplicate' WHEN starts_with(c, p) AND (length(c) - length(p)) / length(c) >= CAST(0.15 AS DOUBLE) THEN 'incremental' WHEN starts_with(c, p) THEN 'duplicate' ELSE 'new' END AS kind FROM x"""


def slide_filter(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents").select("doc_id", S.is_slide(F.col("text"), 900).alias("is_slide"), F.length(S.collapse(F.col("text"))).alias("n"))


SQL["slide_filter"] = f"SELECT doc_id, length(replace({_norm('text')}, ' ', '')) >= 900 AS is_slide, CAST(length({_norm('text')}) AS INTEGER) AS n FROM documents"


def frame_times(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    name = F.when(n % 5 == 0, F.format_string("/v/frame_%05d.png", n)).when(n % 5 == 1, F.format_string("a/shot-%d.%02d.png", F.expr("o_orderkey div 4"), n % 4 * 25)).when(
        n % 5 == 2, F.concat(F.lit("f_"), (n % 1000).cast("string"), F.lit("s.jpg"))
    )
    path = name.when(n % 5 == 3, F.concat(F.lit("f_"), (n % 900).cast("string"), F.lit("SEC.png"))).otherwise(F.lit("cover.png"))
    at = S.frame_time(path)
    return V.read(spark, d, "orders").select(n.alias("o_orderkey"), at["t"].alias("t"), at["source"].alias("source"))


SQL["frame_times"] = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey / 2 WHEN 1 THEN o_orderkey / 4 WHEN 2 THEN CAST(o_orderkey % 1000 AS DOUBLE) WHEN 3 THEN CAST(o_orderkey % 900 AS DOUBLE) ELSE 0 END AS t,
CASE o_orderkey % 5 WHEN 0 THEN 'filename_pts_over_fps' WHEN 4 THEN 'fallback_unparseable' ELSE 'filename_seconds' END AS source FROM orders"""


def frame_actions(spark: SparkSession, d: str) -> DataFrame:
    frames = V.hashed_frames(spark, d).select("video_id", "idx", F.concat_ws("/", "video_id", F.col("idx").cast("string")).alias("path"))
    final = Q.select_keyframes(V.hashed_frames(spark, d)).select(F.concat_ws("/", "video_id", F.col("idx").cast("string")).alias("path"))
    return T.frame_actions(frames, final)


SQL["frame_actions"] = f"""WITH kept AS ({SQL['keyframes']}), shot AS (SELECT label, vec_id, k, row_number() OVER (PARTITION BY label ORDER BY vec_id, k) - 1 AS idx FROM embeddings, range(3) AS r(k) WHERE k <= vec_id % 3)
SELECT shot.label || '/' || idx AS path, CASE WHEN kept.vec_id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM shot LEFT JOIN kept ON kept.vec_id = shot.vec_id AND kept.dwell = k"""


def vtt_parse(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as caption files, with tags and split lines, and read again."""
    rows = V.conversation_segments(spark, d)
    stamp = F.concat(S.format_timestamp(F.col("t")), F.lit(".5"))
    cue = F.concat(stamp, F.lit(" --> "), stamp, F.lit(" align:start\n<c>"), F.regexp_replace("text", r"\n+", "\n"), F.lit("</c>\n\n"))
    files = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seq", cue.alias("c")))).alias("x"))
    files = files.select("video_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("x", lambda s: s["c"]), "")).alias("body"))
    return P.parse_vtt(files).select("video_id", "t", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_CUES = """x AS (SELECT video_id, seq, t, {norm} AS text FROM line), y AS (SELECT * FROM x WHERE text <> ''), z AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY seq) AS p FROM y)"""
SQL["vtt_parse"] = f"WITH {V.TALKS_SQL}, {_CUES.format(norm=_norm('text'))} SELECT video_id, t + 0.5 AS t, md5(text) AS text_md5 FROM z WHERE p IS NULL OR p <> text"


def json3_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = V.conversation_segments(spark, d)
    event = F.struct("seq", (F.col("t") * 1000).cast("bigint").alias("tStartMs"), F.array(F.struct(F.substring("text", 1, 10).alias("utf8")), F.struct(F.substr("text", F.lit(11)).alias("utf8"))).alias("segs"))
    files = rows.groupBy("video_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(event)).alias("events"))).alias("body"))
    return P.parse_json3(files).select("video_id", "t", F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL["json3_parse"] = f"WITH {V.TALKS_SQL}, {_CUES.format(norm=_norm('text'))} SELECT video_id, t, md5(text) AS text_md5 FROM z WHERE p IS NULL OR p <> text"


def staged_captions(spark: SparkSession, d: str) -> DataFrame:
    """Talks in up to three languages, of which the first wanted one counts; texts are blank or repeat at times."""
    n, seq = F.col("video_id").cast("bigint") % 5, F.col("seq")
    rows = V.conversation_segments(spark, d).withColumn("text", F.when(seq % 4 == 1, " \n").when(seq % 4 == 2, "same").otherwise(F.col("text")))
    langs = F.when(n == 0, F.array(F.lit("fr"))).when(n == 1, F.array(F.lit("fr"), F.lit("en"))).when(n == 2, F.array(F.lit("en"), F.lit("ko"))).otherwise(F.array(F.lit("ko")))
    each = rows.withColumn("language", F.explode(langs)).withColumn("text", F.when(F.col("language") == "en", F.concat("text", F.lit("  en "))).otherwise(F.col("text")))
    return P.staged_captions(each).select("video_id", "seq", "t", F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL["staged_captions"] = f"""WITH {V.TALKS_SQL}, s AS (SELECT video_id, seq, t, CASE seq % 4 WHEN 1 THEN '' WHEN 2 THEN 'same' ELSE text END || CASE WHEN CAST(video_id AS BIGINT) % 5 = 1 THEN '  en ' ELSE '' END AS text FROM line WHERE CAST(video_id AS BIGINT) % 5 > 0),
x AS (SELECT video_id, seq, t, {_norm("text")} AS text FROM s), y AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) - 1 AS n FROM x WHERE text <> ''), z AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY seq) AS p FROM y)
SELECT video_id, CAST(n AS INTEGER) AS seq, t, md5(text) AS text_md5 FROM z WHERE p IS NULL OR p <> text"""


def silence_parse(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as silence starts, views as ends, in a log of each video; speech is what is left."""
    rows = V.event_segments(spark, d).withColumn("sec", (F.col("t") / 1000).cast("bigint"))
    line = F.when(F.col("text") == "click", F.concat(F.lit("[x] silence_start: "), F.col("sec").cast("string"))).when(F.col("text") == "view", F.concat(F.lit("[x] silence_end: "), F.col("sec").cast("string"), F.lit(" | d: 1"))).otherwise("frame")
    logs = rows.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda s: s["l"]), "\n").alias("body"))
    return P.parse_silence(logs.withColumn("dur", F.lit(3600.0)))


SQL["silence_parse"] = f"""WITH {V.EVENTS_SQL}, m AS (SELECT video_id, seq, t // 1000 AS sec, text FROM seg WHERE text IN ('click', 'view')),
g AS (SELECT *, count(*) FILTER (WHERE text = 'view') OVER (PARTITION BY video_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM m),
q AS (SELECT video_id, coalesce(arg_max(sec, seq) FILTER (WHERE text = 'click'), 0) AS s, coalesce(max(sec) FILTER (WHERE text = 'view'), 3600) AS e FROM g GROUP BY video_id, grp), {V.merged_sql("merged", "q")},
every AS (SELECT video_id, s, least(e, 3600) AS e FROM merged UNION ALL SELECT video_id, 0, 0 FROM vid UNION ALL SELECT video_id, 3600, 3600 FROM vid), gap AS (SELECT video_id, e AS s, lead(s) OVER (PARTITION BY video_id ORDER BY s, e) AS e FROM every)
SELECT video_id, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e FROM gap WHERE e > s"""


def metadata_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    body = F.to_json(
        F.struct(
            F.when(n % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Order "), n.cast("string"))).alias("title"),
            F.when(n % 3 == 0, F.lit("-1")).when(n % 3 == 1, F.lit("soon")).otherwise(n.cast("string")).alias("duration"),
            F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("id"), n.cast("string"))).alias("id"),
            F.when(n % 10 == 0, F.lit(" ")).otherwise(F.concat(F.lit("show"), n.cast("string"))).alias("display_id"),
        )
    )
    url = F.concat(F.lit("https://youtu.be/"), F.substring(F.md5(n.cast("string").cast("binary")), 1, 11))
    return P.parse_metadata(V.read(spark, d, "orders").select(n.cast("string").alias("video_id"), url.alias("url"), body.alias("body")))


SQL["metadata_parse"] = """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'Order ' || o_orderkey END AS title, CASE WHEN o_orderkey % 3 = 2 THEN CAST(o_orderkey AS DOUBLE) END AS duration,
CASE WHEN o_orderkey % 10 = 0 THEN substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 11) WHEN o_orderkey % 5 = 0 THEN 'show' || o_orderkey ELSE 'id' || o_orderkey END AS media_id FROM orders"""


def video_ids(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    own = F.substring(F.md5(F.col("url").cast("binary")), 1, 11)
    url = F.when(p % 6 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), own, F.lit("&t=3"))).when(p % 6 == 1, F.concat(F.lit("https://youtu.be/"), own)).when(p % 6 == 2, F.concat(F.lit("https://x/shorts/"), own, F.lit("zz")))
    url = url.when(p % 6 == 3, F.concat(F.lit("  "), own, F.lit(" "))).when(p % 6 == 4, F.concat(F.lit("https://x/embed/"), F.substring(own, 1, 9))).otherwise(F.concat(own, F.lit("12")))
    return V.read(spark, d, "pages").select("page_id", S.video_id_of(url).alias("media_id"))


SQL["video_ids"] = "SELECT page_id, CASE WHEN page_id % 6 < 4 THEN substring(md5(url), 1, 11) END AS media_id FROM pages"


def otsu(spark: SparkSession, d: str) -> DataFrame:
    level = (F.col("l_extendedprice") % 256).cast("int")
    pixels = V.read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") > 25, F.floor(level / 4).cast("int")).otherwise(level).alias("level"))
    h = K.gray_histogram(pixels, ["l_suppkey"]).select("l_suppkey", K.otsu_threshold(F.col("histogram")).alias("threshold"))
    return h.select("l_suppkey", "threshold", S.binarize_luma(F.lit(100), F.col("threshold")).alias("luma100"))


_OTSU = """px AS (SELECT l_suppkey, CASE WHEN l_quantity > 25 THEN CAST(trunc(l_extendedprice % 256) AS INTEGER) // 4 ELSE CAST(trunc(l_extendedprice % 256) AS INTEGER) END AS level FROM lineitem),
c AS (SELECT l_suppkey, level, count(*) AS n FROM px GROUP BY l_suppkey, level),
r AS (SELECT l_suppkey, level, CAST(sum(n) OVER w AS DOUBLE) AS n, CAST(sum(n * level) OVER w AS DOUBLE) AS s, CAST(sum(n) OVER (PARTITION BY l_suppkey) AS DOUBLE) AS t, CAST(sum(n * level) OVER (PARTITION BY l_suppkey) AS DOUBLE) AS ws FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY level)),
v AS (SELECT l_suppkey, level, n * (t - n) * (s / n - (ws - s) / (t - n)) * (s / n - (ws - s) / (t - n)) AS v FROM r WHERE t > n),
b AS (SELECT l_suppkey, CAST(coalesce(arg_min(level, (-v, level)), 127) AS INTEGER) AS threshold FROM v GROUP BY l_suppkey)"""
SQL["otsu"] = f"WITH {_OTSU} SELECT l_suppkey, threshold, CASE WHEN 100 > threshold THEN 255 ELSE 0 END AS luma100 FROM b"


def otsu_by_window(spark: SparkSession, d: str) -> DataFrame:
    level = (F.col("l_extendedprice") % 256).cast("int")
    pixels = V.read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") > 25, F.floor(level / 4).cast("int")).otherwise(level).alias("level"))
    return K.otsu_by_window(pixels.groupBy("l_suppkey", "level").agg(F.count("*").alias("n")), ["l_suppkey"])


SQL["otsu_by_window"] = f"WITH {_OTSU} SELECT l_suppkey, threshold FROM b"


def image_geometry(spark: SparkSession, d: str) -> DataFrame:
    w, h = (F.col("p_partkey") % 4000 + 1).cast("int"), (F.col("p_partkey") * 7 % 2300 + 1).cast("int")
    rows = V.read(spark, d, "part").select("p_partkey", S.roi_box(w, h).alias("box"), S.upscaled_size(w, h).alias("size"))
    return rows.select("p_partkey", "box.left", "box.top", "box.right", "box.bottom", "size.width", "size.height")


SQL["image_geometry"] = """WITH s AS (SELECT p_partkey, CAST(p_partkey % 4000 + 1 AS INTEGER) AS w, CAST(p_partkey * 7 % 2300 + 1 AS INTEGER) AS h FROM part),
m AS (SELECT *, CAST(round_even(w * CAST(0.035 AS DOUBLE), 0) AS INTEGER) AS l, CAST(round_even(h * CAST(0.035 AS DOUBLE), 0) AS INTEGER) AS t,
  CASE WHEN greatest(w, h) * 2 > 3200 THEN greatest(CAST(3200 AS DOUBLE) / greatest(w, h), 1) ELSE 2 END AS f FROM s)
SELECT p_partkey, l AS left, t AS top, w - l AS right, h - t AS bottom, CAST(greatest(1, round_even(w * f, 0)) AS INTEGER) AS width, CAST(greatest(1, round_even(h * f, 0)) AS INTEGER) AS height FROM m"""


def hash_forms(spark: SparkSession, d: str) -> DataFrame:
    """One number written in five ways is one hash; its distance to the next number is counted in bits."""
    n = F.col("o_orderkey")
    form = F.when(n % 5 == 0, F.concat(F.lit("0x"), F.hex(n))).when(n % 5 == 1, F.concat(F.lit("0b"), F.bin(n))).when(n % 5 == 2, F.lpad(F.hex(n), 16, "0")).when(n % 5 == 3, F.concat(n.cast("string"), F.lit("_"))).otherwise(F.lit(""))
    h = S.hash_to_long(form)
    return V.read(spark, d, "orders").select(n.alias("o_orderkey"), h.alias("h"), S.hamming(h, n + 1).alias("distance"))


SQL["hash_forms"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE o_orderkey END AS h, CAST(bit_count(xor(CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE o_orderkey END, o_orderkey + 1)) AS INTEGER) AS distance FROM orders"


def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = V.read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("stage"), F.col("l_quantity").alias("cpu"), (F.col("l_suppkey") * 1_000_000).cast("double").alias("rss"))
    return G.stage_summary(rows)


SQL["stage_summary"] = "SELECT l_returnflag || l_linestatus AS stage, count(*) AS n, round(avg(l_quantity), 1) AS cpu_avg, round(max(l_quantity), 1) AS cpu_peak, round(avg(l_suppkey), 1) AS rss_mb_avg, CAST(max(l_suppkey) AS DOUBLE) AS rss_mb_peak FROM lineitem GROUP BY ALL"

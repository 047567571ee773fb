"""Queries on intervals, as-of joins, ordered sequences and the completeness gate, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions import scalars as S
from chronotext.operators import coverage as C
from chronotext.operators import render as R
from chronotext.operators import sequences as Q
from chronotext.operators import spans as I
from chronotext.operators import temporal as T
from chronotext.plans import views as V

GAP_MS, CAP_MS, CARRY_MS = 60_000, 30_000, 120_000
SQL: dict[str, str] = {}


def span_merge(spark: SparkSession, d: str) -> DataFrame:
    return I.merge_spans(V.event_speech(spark, d))


SQL["span_merge"] = f"WITH {V.EVENTS_SQL}, {V.merged_sql('merged', 'speech')} SELECT * FROM merged"


def span_merge_volume(spark: SparkSession, d: str) -> DataFrame:
    day = F.expr("datediff(cast(l_shipdate as date), DATE '1992-01-01')").cast("bigint")
    rows = V.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("video_id"), day.alias("s"), (day + F.col("l_quantity").cast("bigint") % 5).alias("e"))
    return I.merge_spans(rows, piece=365)


SQL["span_merge_volume"] = f"""WITH item AS (SELECT l_suppkey AS video_id, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s,
  date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) % 5 AS e FROM lineitem), {V.merged_sql("merged", "item")} SELECT * FROM merged"""


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return V.event_videos(spark, d).select("video_id", F.lit(0).cast("bigint").alias("lo"), F.col("dur").alias("hi"))


def span_complement(spark: SparkSession, d: str) -> DataFrame:
    return I.complement_spans(V.event_speech(spark, d), _bounds(spark, d))


SQL["span_complement"] = f"""WITH {V.EVENTS_SQL}, inside AS (SELECT * FROM speech WHERE e > 0 AND s < {V.HOUR_MS}), {V.merged_sql("merged", "inside")},
ends AS (SELECT video_id, greatest(s, 0) AS s, least(e, {V.HOUR_MS}) AS e FROM merged UNION ALL SELECT video_id, 0, 0 FROM vid UNION ALL SELECT video_id, {V.HOUR_MS}, {V.HOUR_MS} FROM vid),
gap AS (SELECT video_id, e AS s, lead(s) OVER (PARTITION BY video_id ORDER BY s, e) AS e FROM ends) SELECT * FROM gap WHERE e > s"""


def cue_cover(spark: SparkSession, d: str) -> DataFrame:
    return I.cover_spans(V.event_cues(spark, d), V.event_videos(spark, d), cap=CAP_MS)


SQL["cue_cover"] = f"WITH {V.EVENTS_SQL}, {V.COVER_SQL} SELECT * FROM cover"


def span_subtract(spark: SparkSession, d: str) -> DataFrame:
    return I.subtract_spans(V.event_speech(spark, d), cue_cover(spark, d))


_UNCOVERED = f"WITH {V.EVENTS_SQL}, {V.COVER_SQL}, {V.merged_sql('merged', 'speech')}, {V.UNCOVERED_SQL}"
SQL["span_subtract"] = f"{_UNCOVERED} SELECT * FROM uncovered"


def gap_check(spark: SparkSession, d: str) -> DataFrame:
    out = C.gap_check(V.event_speech(spark, d), V.event_cues(spark, d), V.event_videos(spark, d), GAP_MS, CAP_MS)
    return out.select("video_id", F.col("gap").alias("max_gap_ms"), "passed")


_GAPS = f"gaps AS (SELECT vid.video_id, coalesce(max(u.e - u.s), 0) AS max_gap_ms, coalesce(max(u.e - u.s), 0) <= {GAP_MS} AS passed FROM vid LEFT JOIN uncovered u USING (video_id) GROUP BY vid.video_id)"
SQL["gap_check"] = f"{_UNCOVERED}, {_GAPS} SELECT * FROM gaps"


def scene_coverage(spark: SparkSession, d: str) -> DataFrame:
    out = C.scene_coverage(V.event_speech(spark, d), V.event_frames(spark, d), V.event_videos(spark, d), carry=CARRY_MS)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("video_id", text("speech_bins"), text("covered_bins"), text("uncovered_bins"), "passed", "vacuous")


_SCENES = f"""
edge AS (SELECT video_id, b, b * (dur / CAST(20 AS DOUBLE)) AS b0, (b + 1) * (dur / CAST(20 AS DOUBLE)) AS b1 FROM vid, range(20) AS r(b)),
spoken AS (SELECT * FROM edge WHERE EXISTS (SELECT 1 FROM speech p WHERE p.video_id = edge.video_id AND p.s < b1 AND p.e > b0)),
near AS (SELECT k.video_id, k.b, coalesce(k.b0 - max(f.t) <= {CARRY_MS}, false) AS ok FROM spoken k LEFT JOIN frame f ON f.video_id = k.video_id AND f.t BETWEEN 0 AND {V.HOUR_MS} AND f.t <= k.b1 GROUP BY k.video_id, k.b, k.b0),
scenes AS (SELECT vid.video_id, coalesce(string_agg(CAST(b AS VARCHAR), ',' ORDER BY b), '') AS speech_bins, coalesce(string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FILTER (WHERE ok), '') AS covered_bins,
  coalesce(string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FILTER (WHERE NOT ok), '') AS uncovered_bins, count(*) FILTER (WHERE NOT ok) = 0 AS passed, count(b) = 0 AS vacuous FROM vid LEFT JOIN near USING (video_id) GROUP BY vid.video_id)"""
SQL["scene_coverage"] = f"WITH {V.EVENTS_SQL}, {_SCENES} SELECT * FROM scenes"


def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    videos = V.event_videos(spark, d)
    gaps = C.gap_check(V.event_speech(spark, d), V.event_cues(spark, d), videos, GAP_MS, CAP_MS)
    scenes = C.scene_coverage(V.event_speech(spark, d), V.event_frames(spark, d), videos, carry=CARRY_MS)
    n = F.col("video_id").cast("bigint")
    docs = videos.select("video_id", F.when(n % 5 == 0, " \n").otherwise("text").alias("transcript"), F.when(n % 7 != 0, "notes").alias("notes"))
    out = C.build_coverage(videos, gaps, scenes, C.artifact_check(docs))
    return out.select("video_id", *[F.col(f"{c}.passed").alias(f"{c}_passed") for c in ("gap_check", "scene_coverage", "artifacts", "notes_contract")], "overall_pass")


_ROLLUP = f"""{_UNCOVERED}, {_GAPS}, {_SCENES},
verdict AS (SELECT video_id, gaps.passed AS gap_check_passed, scenes.passed AS scene_coverage_passed, CAST(video_id AS BIGINT) % 5 <> 0 AND CAST(video_id AS BIGINT) % 7 <> 0 AS artifacts_passed, true AS notes_contract_passed
  FROM gaps JOIN scenes USING (video_id))"""
SQL["coverage_rollup"] = f"{_ROLLUP} SELECT *, gap_check_passed AND scene_coverage_passed AND artifacts_passed AND notes_contract_passed AS overall_pass FROM verdict"


def batch_verdict(spark: SparkSession, d: str) -> DataFrame:
    return C.batch_verdict(coverage_rollup(spark, d))


SQL["batch_verdict"] = f"""{_ROLLUP}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT (gap_check_passed AND scene_coverage_passed AND artifacts_passed)) AS n_failed FROM verdict)
SELECT n, n_failed, n_failed = 0 AS passed, CASE WHEN n_failed = 0 THEN 0 ELSE 2 END AS exit_code FROM n"""


def coverage_detail(spark: SparkSession, d: str) -> DataFrame:
    """What a video's notes say of its coverage, with slides, engines and problems of its notes."""
    n = F.col("video_id").cast("bigint")
    videos = V.event_videos(spark, d).withColumn("duration_sec", F.col("dur") / 1000.0 + n % 5000)
    frames = V.event_frames(spark, d)
    slides = frames.withColumn("ocr_text", F.when(F.col("event_id") % 40 == 0, F.lit(" \n")).otherwise("slide"))
    engines = Q.engine_used(frames.select("video_id", F.col("event_id").alias("idx"), F.element_at(F.array(F.lit("none"), F.lit("first"), F.lit("second")), (F.col("event_id") % 3 + 1).cast("int")).alias("engine")))
    problems = videos.select("video_id", F.explode(F.when(n % 3 == 0, F.array(F.lit("marker"), F.lit("flow"))).when(n % 3 == 1, F.array(F.lit("takeaways")))).alias("rule"))
    gaps = C.gap_check(V.event_speech(spark, d), V.event_cues(spark, d), videos, GAP_MS, CAP_MS)
    scenes = C.scene_coverage(V.event_speech(spark, d), frames, videos, slides, carry=CARRY_MS)
    docs = videos.select("video_id", F.when(n % 5 == 0, " \n").otherwise("text").alias("transcript"), F.when(n % 7 != 0, "notes").alias("notes"))
    out = C.build_coverage(videos, gaps, scenes, C.artifact_check(docs), problems, engines)
    cov = F.struct(*out.columns)
    return out.select("video_id", F.array_join(R.coverage_footer(cov), "\n").alias("footer"), F.array_join("notes_contract.problems", ",").alias("problems"), F.col("notes_contract.passed").alias("notes_passed"), "overall_pass")


_DETAIL = f"""{_UNCOVERED}, {_GAPS}, {_SCENES},
shots AS (SELECT vid.video_id, count(event_id) AS total, count(event_id) FILTER (WHERE event_id % 40 <> 0) AS full, coalesce(arg_max(CASE event_id % 3 WHEN 1 THEN 'first' ELSE 'second' END, event_id) FILTER (WHERE event_id % 3 > 0), 'none') AS engine FROM vid LEFT JOIN frame USING (video_id) GROUP BY vid.video_id),
x AS (SELECT video_id, CAST(video_id AS BIGINT) AS n, max_gap_ms, gaps.passed AS gap_ok, scenes.passed AND shots.full >= total AS scene_ok, total, shots.full AS full, engine,
  CASE WHEN speech_bins = '' THEN 0 ELSE len(string_split(speech_bins, ',')) END AS spoken, CASE WHEN uncovered_bins = '' THEN 0 ELSE len(string_split(uncovered_bins, ',')) END AS bare FROM gaps JOIN scenes USING (video_id) JOIN shots USING (video_id)),
y AS (SELECT *, n % 5 <> 0 AS said, n % 7 <> 0 AS noted, n % 3 = 2 AS notes_passed FROM x)"""
SQL["coverage_detail"] = f"""{_DETAIL} SELECT video_id, array_to_string(['- 전체 길이: ' || {V.stamp_sql("CAST(3600 + n % 5000 AS DOUBLE)")}, '- 대사 공백: 최대 ' || max_gap_ms || 's (임계 {GAP_MS}s) → ' || CASE WHEN gap_ok THEN '통과' ELSE '미달' END,
  '- 장면 커버리지: 발화 구간 ' || spoken || '개 중 미커버 ' || bare || '개 → ' || CASE WHEN scene_ok THEN '통과' ELSE '미달' END, '- 슬라이드: ' || "full" || '/' || total || ' (OCR 텍스트 보유)', '- OCR 엔진: ' || engine,
  '- 산출물: transcript=' || CASE WHEN said THEN 'O' ELSE 'X' END || ', notes=' || CASE WHEN noted THEN 'O' ELSE 'X' END], chr(10)) AS footer,
  CASE n % 3 WHEN 0 THEN 'flow,marker' WHEN 1 THEN 'takeaways' ELSE '' END AS problems, notes_passed, gap_ok AND scene_ok AND said AND noted AND notes_passed AS overall_pass FROM y"""


def bin_places(spark: SparkSession, d: str) -> DataFrame:
    rows = V.timeline(spark, d)
    t, dur = F.col("t") / 1000.0, F.col("value") * 40.0
    return rows.select("event_id", S.bin_of(t, dur).alias("bin"), S.warns_long_video(dur).alias("long_video"), S.round_ms(F.col("value") / 3).alias("t3"))


SQL["bin_places"] = f"""WITH {V.EVENTS_SQL}, x AS (SELECT event_id, t / CAST(1000 AS DOUBLE) AS t, value * CAST(40 AS DOUBLE) AS dur, value FROM evt)
SELECT event_id, CASE WHEN dur > 0 THEN CAST(least(greatest(trunc(t / dur * 20), 0), 19) AS INTEGER) ELSE 0 END AS bin, dur > 2700 AS long_video, round(value / 3, 3) AS t3 FROM x"""


def assign_sections(spark: SparkSession, d: str) -> DataFrame:
    """Cues to sections that open at frames; several frames may share a start."""
    frames = V.event_frames(spark, d)
    sections = frames.select("video_id", (F.col("t") - F.col("t") % 60000).alias("win_start"), F.col("event_id").alias("index"))
    return T.assign_to_sections(V.event_segments(spark, d), sections).select("video_id", "seq", "section")


SQL["assign_sections"] = f"""WITH {V.EVENTS_SQL}, sec AS (SELECT video_id, t - t % 60000 AS w, event_id AS i FROM frame),
lastof AS (SELECT video_id, w, max(i) AS i FROM sec GROUP BY video_id, w), firstof AS (SELECT video_id, arg_min(i, (w, i)) AS i FROM sec GROUP BY video_id)
SELECT seg.video_id, seg.seq, coalesce(l.i, f.i) AS section FROM seg ASOF LEFT JOIN lastof l ON seg.video_id = l.video_id AND seg.t >= l.w LEFT JOIN firstof f ON f.video_id = seg.video_id"""


def asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """The last frame up to each cue, 90 seconds old at most."""
    frames = V.event_frames(spark, d).withColumnRenamed("t", "frame_t")
    return T.asof_backward(V.event_segments(spark, d), frames, ["video_id"], "t", "frame_t", ["event_id"], ["event_id"], tolerance=90_000).select("video_id", "seq", F.coalesce("event_id", F.lit(-1).cast("bigint")).alias("frame_event"))


SQL["asof_tolerance"] = f"""WITH {V.EVENTS_SQL}, f AS (SELECT video_id, t AS frame_t, max(event_id) AS event_id FROM frame GROUP BY video_id, t)
SELECT seg.video_id, seg.seq, CASE WHEN seg.t - f.frame_t <= 90000 THEN f.event_id ELSE -1 END AS frame_event FROM seg ASOF LEFT JOIN f ON seg.video_id = f.video_id AND seg.t >= f.frame_t"""


def citation_band(spark: SparkSession, d: str) -> DataFrame:
    rows = V.event_segments(spark, d)
    links = rows.where("text = 'error'").select("video_id", "seq", (F.floor(F.col("t") / 1000) + F.col("seq") % 4).alias("sec"))
    cues = rows.where("text in ('error', 'purchase')").select("video_id", F.floor(F.col("t") / 1000).alias("sec"))
    return T.uncited(links, cues).select("video_id", "seq", "sec")


SQL["citation_band"] = f"""WITH {V.EVENTS_SQL}, link AS (SELECT video_id, seq, t // 1000 + seq % 4 AS sec FROM seg WHERE text = 'error'), c AS (SELECT video_id, t // 1000 AS sec FROM seg WHERE text IN ('error', 'purchase'))
SELECT * FROM link WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.video_id = link.video_id AND abs(c.sec - link.sec) <= 1) AND EXISTS (SELECT 1 FROM c WHERE c.video_id = link.video_id)"""


def rolling_dedup(spark: SparkSession, d: str) -> DataFrame:
    return Q.drop_repeats(V.event_segments(spark, d))


SQL["rolling_dedup"] = f"WITH {V.EVENTS_SQL}, l AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY seq) AS p FROM seg) SELECT video_id, seq, t, text FROM l WHERE p IS NULL OR p <> text"


def anchor_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = V.event_segments(spark, d).withColumn("t", F.col("t") / 1000.0)
    out = Q.anchor_ids(rows)
    return out.select("video_id", "seq", "anchor", S.anchor_seconds(F.col("anchor")).alias("sec"))


SQL["anchor_ids"] = f"""WITH {V.EVENTS_SQL}, a AS (SELECT video_id, seq, 't' || replace({V.stamp_sql("t / CAST(1000 AS DOUBLE)")}, ':', '') AS base, CAST(round_even(t / CAST(1000 AS DOUBLE), 0) AS INTEGER) AS sec FROM seg),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id, base ORDER BY seq) AS n FROM a) SELECT video_id, seq, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS anchor, sec FROM n"""


#: Limits under which short talks count as unusable.
CUES, CHARS = 4, 2000


def captions_usable(spark: SparkSession, d: str) -> DataFrame:
    return C.captions_usable(V.conversation_segments(spark, d), V.conversation_videos(spark, d), CUES, CHARS)


_USABLE = f"""WITH {V.TALKS_SQL}, u AS (SELECT talk.video_id, count(line.seq) AS n_cues, CAST(coalesce(sum(length(line.text)), 0) AS BIGINT) AS n_chars FROM talk LEFT JOIN line USING (video_id) GROUP BY talk.video_id),
ok AS (SELECT *, n_cues >= {CUES} AND n_chars >= {CHARS} AS usable FROM u)"""
SQL["captions_usable"] = f"{_USABLE} SELECT *, CASE WHEN NOT usable THEN 'captions present but unusable (' || n_cues || ' cues)' END AS reason FROM ok"


def choose_track(spark: SparkSession, d: str) -> DataFrame:
    every = V.conversation_segments(spark, d)
    return C.choose_track(every, every, V.conversation_videos(spark, d), least=CUES, chars=CHARS).select("video_id", "seq", "source", "fallback_reason")


SQL["choose_track"] = f"""{_USABLE} SELECT video_id, seq, 'caption' AS source, CAST(NULL AS VARCHAR) AS fallback_reason FROM line JOIN ok USING (video_id) WHERE usable
UNION ALL SELECT video_id, seq, 'stt', 'captions present but unusable (' || n_cues || ' cues)' FROM line JOIN ok USING (video_id) WHERE NOT usable"""


def merge_metadata(spark: SparkSession, d: str) -> DataFrame:
    videos = V.conversation_videos(spark, d)
    n = F.col("video_id").cast("bigint")
    fetched = videos.where(n % 3 == 0).select("video_id", F.when(n % 2 == 0, F.lit("Fetched")).alias("title"), (F.col("duration_sec") + 1).alias("duration_sec"))
    return C.merge_metadata(videos, fetched)


SQL["merge_metadata"] = f"""WITH {V.TALKS_SQL}, m AS (SELECT video_id, CASE WHEN CAST(video_id AS BIGINT) % 2 = 0 THEN 'Fetched' END AS title, duration_sec + 1 AS duration_sec FROM talk WHERE CAST(video_id AS BIGINT) % 3 = 0)
SELECT t.video_id, coalesce(m.title, t.title) AS title, coalesce(m.duration_sec, t.duration_sec) AS duration_sec, t.source FROM talk t LEFT JOIN m USING (video_id)"""


def section_hints(spark: SparkSession, d: str) -> DataFrame:
    return Q.section_hints(V.conversation_slides(spark, d), V.conversation_videos(spark, d))


_HINTS = r"""o AS (SELECT s.*, duration_sec, row_number() OVER w AS n, first_value(t) OVER w AS f, lead(t) OVER w AS nt FROM slide s JOIN talk USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY t, idx)),
named AS (SELECT *, coalesce((SELECT substring(x, 1, 80) FROM (SELECT unnest(list_transform(regexp_split_to_array(ocr_text, '\n'), lambda y: trim(y))) AS x, unnest(range(len(regexp_split_to_array(ocr_text, '\n')))) AS k) WHERE x <> '' ORDER BY k LIMIT 1), '슬라이드 ' || n) AS title FROM o),
hints AS (SELECT video_id, CAST(n - 1 + CASE WHEN f > 0 THEN 1 ELSE 0 END AS INTEGER) AS index, t, t AS win_start, coalesce(nt, duration_sec) AS t_end, title, frame FROM named
  UNION ALL SELECT video_id, 0, 0, 0, t, '도입', NULL FROM o WHERE n = 1 AND t > 0
  UNION ALL SELECT video_id, 0, 0, 0, duration_sec, '전체', NULL FROM talk WHERE video_id NOT IN (SELECT video_id FROM slide))"""
SQL["section_hints"] = f"WITH {V.TALKS_SQL}, {_HINTS} SELECT * FROM hints"


def renderable_sections(spark: SparkSession, d: str) -> DataFrame:
    hints = section_hints(spark, d)
    return Q.renderable_sections(hints, T.assign_to_sections(V.conversation_segments(spark, d), hints)).select("video_id", "index", "section_no")


_SHOWN = f"""WITH {V.TALKS_SQL}, {_HINTS},
own AS (SELECT l.video_id, l.seq, coalesce((SELECT arg_max(h.index, (h.win_start, h.index)) FROM hints h WHERE h.video_id = l.video_id AND h.win_start <= l.t), (SELECT arg_min(h.index, (h.win_start, h.index)) FROM hints h WHERE h.video_id = l.video_id)) AS index FROM line l),
shown AS (SELECT h.*, row_number() OVER (PARTITION BY video_id ORDER BY index) AS section_no FROM hints h
  WHERE (SELECT count(*) FROM hints g WHERE g.video_id = h.video_id) = 1 OR coalesce(frame, '') <> '' OR EXISTS (SELECT 1 FROM own WHERE own.video_id = h.video_id AND own.index = h.index))"""
SQL["renderable_sections"] = f"{_SHOWN} SELECT video_id, index, CAST(section_no AS INTEGER) AS section_no FROM shown"

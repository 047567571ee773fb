"""Ordered text from rows: transcripts, note skeletons, the synthesis hand-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext import model
from chronotext.functions import scalars as S
from chronotext.operators.sequences import anchor_ids, renderable_sections, section_hints
from chronotext.operators.temporal import assign_to_sections

#: Words of transcripts and of the notes' titles and placeholders.
TRANSCRIPT_TITLE, TRANSCRIPT_SOURCE, NOTES_TITLE = " — 전체 전사본 (raw)\n\n- 소스: ", "unknown", " — 학습 정리"
TODO, PICTURE_WIDTH = "- 미보강: ", 480
TODO_KEY, TODO_SLIDE = f"{TODO}핵심 메시지 한 줄.", f"{TODO}이 슬라이드 핵심을 요약 글머리표로 정리하세요."
TODO_FLOW = (f"{TODO}도입→전개→마무리 흐름을 짧게 정리하세요.", f"{TODO}핵심 전개를 한 줄씩 정리하세요.")
TODO_CONCEPTS, TODO_QUESTIONS = f"{TODO}핵심 용어 → 정의를 영상 딥링크와 함께 정리하세요.", "- 미보강 질문: 핵심 확인 질문과 답을 작성하세요."


def _joined(lines: str | Column) -> Column:
    """Lines (order, line) of a group, in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")


def _finished(text: Column) -> Column:
    return F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\n"))


def transcript_md(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, transcript): a heading and a line with anchor and time for every cue, also an empty one."""
    named = anchor_ids(segments)
    line = F.concat(F.lit('<a id="'), "anchor", F.lit('"></a> ['), S.format_timestamp(F.col("t")), F.lit("] "), S.strip(F.coalesce("text", F.lit(""))))
    body = named.select("video_id", F.col("seq").cast("long").alias("ord"), line.alias("line")).groupBy("video_id").agg(_joined("line").alias("_body"))
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit(TRANSCRIPT_TITLE), F.coalesce("source", F.lit(TRANSCRIPT_SOURCE)), F.lit("\n\n"))
    return videos.join(body, "video_id", "left").select("video_id", _finished(F.concat(head, F.coalesce("_body", F.lit("")))).alias("transcript"))


def synthesis_input(videos: DataFrame, segments: DataFrame, slides: DataFrame, contract: model.Contract = model.CONTRACT) -> DataFrame:
    """One row a video: schema_version, video, transcript_segments, slides, section_hints as nested columns."""
    hints = section_hints(slides, videos, contract)
    nest = lambda df, order, fields, name: df.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("_x")).select("video_id", F.transform("_x", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))
    rows = segments.withColumn("t", S.round_ms(F.col("t")))
    parts = [nest(rows, ["seq"], ["t", "text"], "transcript_segments"), nest(slides, ["idx"], ["t", "frame", "ocr_text"], "slides"), nest(hints.withColumn("_o", F.col("index")), ["_o"], ["index", "t", "win_start", "t_end", "title", "frame"], "section_hints")]
    out = videos.select("video_id", F.lit(model.SCHEMA_VERSION).alias("schema_version"), F.struct(*[c for c in videos.columns if c != "video_id"]).alias("video"))
    for p in parts:
        out = out.join(p, "video_id", "left")
    return out


def coverage_footer(cov: Column) -> Column:
    """Lines of the coverage section from a coverage struct (see build_coverage)."""
    #: Words of the footer.
    word = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "통과").otherwise("미달")
    mark = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "O").otherwise("X")
    text = lambda x: x.cast("string")
    g, s, a = cov["gap_check"], cov["scene_coverage"], cov["artifacts"]
    return F.array(
        F.concat(F.lit("- 전체 길이: "), S.format_timestamp(cov["duration_sec"])),
        F.concat(F.lit("- 대사 공백: 최대 "), text(F.round(g["gap"], 3)), F.lit("s (임계 "), text(g["threshold"]), F.lit("s) → "), word(g["passed"])),
        F.concat(F.lit("- 장면 커버리지: 발화 구간 "), text(F.size(s["speech_bins"])), F.lit("개 중 미커버 "), text(F.size(s["uncovered_bins"])), F.lit("개 → "), word(s["passed"])),
        F.concat(F.lit("- 슬라이드: "), text(s["slides_with_text"]), F.lit("/"), text(s["slides_total"]), F.lit(" (OCR 텍스트 보유)")),
        F.concat(F.lit("- OCR 엔진: "), F.coalesce(cov["ocr_engine"], F.lit("none"))),
        F.concat(F.lit("- 산출물: transcript="), mark(a["transcript_nonempty"]), F.lit(", notes="), mark(a["notes_nonempty"])),
    )


def notes_md(videos: DataFrame, segments: DataFrame, slides: DataFrame, coverage: DataFrame, contract: model.Contract = model.CONTRACT) -> DataFrame:
    """(video_id, notes): the seven-section skeleton, with placeholders for what is written later."""
    hints = section_hints(slides, videos, contract)
    shown = renderable_sections(hints, assign_to_sections(segments, hints))
    title, no = S.safe_title(F.col("title")), F.col("section_no").cast("string")
    picture = F.array(F.lit(""), F.concat(F.lit('<img src="'), "frame", F.lit('" alt="'), F.lit(contract.slide_title), F.lit(" "), no, F.lit(f'" width="{PICTURE_WIDTH}">')), F.lit(""))
    intro = F.array(F.lit(contract.intro_marker))
    middle = F.when(F.coalesce("frame", F.lit("")) != "", picture).when(F.col("title") == contract.intro_title, intro).otherwise(F.array().cast("array<string>"))
    block = F.concat(
        F.array(F.concat(F.lit('<a id="sec-'), no, F.lit('"></a>')), F.concat(F.lit("### "), title)), middle, F.array(F.lit(TODO_SLIDE), F.lit(""))
    )
    rows = shown.select("video_id", "section_no", F.concat(F.lit("- ["), title, F.lit("](#sec-"), no, F.lit(")")).alias("toc"), F.array_join(block, "\n").alias("block"))
    lists = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "toc", "block"))).alias("_s"))
    footer = coverage.select("video_id", F.struct(*[c for c in coverage.columns if c != "video_id"]).alias("_c"))
    lit = lambda *lines: F.array(*[F.lit(x) for x in lines])
    text = F.concat(
        lit(contract.marker), F.array(F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit(NOTES_TITLE))), lit("", contract.takeaway, contract.open_marker, TODO_KEY, TODO_KEY, TODO_KEY, "", contract.toc),
        F.transform("_s", lambda x: x["toc"]),
        lit("", contract.flow, contract.open_marker, *TODO_FLOW, "", contract.concepts, contract.open_marker),
        lit(TODO_CONCEPTS, "", contract.detail, contract.open_marker),
        F.transform("_s", lambda x: x["block"]),
        lit(contract.questions, contract.open_marker, TODO_QUESTIONS, "", contract.coverage),
        coverage_footer(F.col("_c")),
    )
    out = videos.join(lists, "video_id").join(footer, "video_id", "left")
    return out.select("video_id", _finished(F.array_join(text, "\n")).alias("notes"))

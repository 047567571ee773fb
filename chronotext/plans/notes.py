"""Queries on rendered text, contract checks, run state and the gate, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions import scalars as S
from chronotext.model import CONTRACT
from chronotext.operators import contract as C
from chronotext.operators import coverage as A
from chronotext.operators import gate as G
from chronotext.operators import render as R
from chronotext.operators import temporal as T
from chronotext.plans import timeline as L
from chronotext.plans import views as V
from chronotext.sources import state as X

SQL: dict[str, str] = {}


def slugs(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 11 == 0, F.lit(" / : ")).otherwise(F.get(F.split("text", "\n", -1), F.lit(0)))
    return V.read(spark, d, "documents").select("doc_id", S.output_dir("out", title).alias("folder"), S.safe_title(F.concat(F.lit("[a|b] "), "text")).alias("safe"), S.first_line(F.col("text"), F.lit("none")).alias("first"))


SQL["slugs"] = r"""WITH x AS (SELECT doc_id, text, CASE WHEN doc_id % 11 = 0 THEN ' / : ' ELSE string_split(text, chr(10))[1] END AS title FROM documents),
y AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(title, E' \t\n\r'), '[^\p{L}\p{M}\p{N}_-]+', '-', 'g'), '^-+|-+$', '', 'g'), '-{2,}', '-', 'g') AS s FROM x)
SELECT doc_id, 'out/' || substring(CASE WHEN s = '' THEN 'video' ELSE s END, 1, 80) AS folder, translate(trim(regexp_replace('[a|b] ' || text, '\s+', ' ', 'g')), '[]|', '()/') AS safe,
coalesce((SELECT substring(v, 1, 80) FROM (SELECT unnest(list_transform(string_split(text, chr(10)), lambda z: trim(z, E' \t\r'))) AS v, unnest(range(len(string_split(text, chr(10))))) AS k) WHERE v <> '' ORDER BY k LIMIT 1), 'none') AS first FROM y"""


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    return R.transcript_md(V.conversation_videos(spark, d), V.conversation_segments(spark, d))


SQL["transcripts"] = f"""WITH {V.TALKS_SQL}, a AS (SELECT *, {V.stamp_sql("t")} AS stamp FROM line), n AS (SELECT *, row_number() OVER (PARTITION BY video_id, stamp ORDER BY seq) AS n FROM a),
b AS (SELECT video_id, string_agg('<a id="t' || replace(stamp, ':', '') || CASE WHEN n = 1 THEN '' ELSE '-' || n END || '"></a> [' || stamp || '] ' || trim(text, E' \\t\\n\\r'), chr(10) ORDER BY seq) AS body FROM n GROUP BY video_id)
SELECT video_id, rtrim('# ' || title || ' — 전체 전사본 (raw)' || chr(10) || chr(10) || '- 소스: ' || source || chr(10) || chr(10) || coalesce(body, ''), E' \\t\\n\\r') || chr(10) AS transcript FROM talk LEFT JOIN b USING (video_id)"""


def _talk_coverage(spark: SparkSession, d: str) -> DataFrame:
    videos = V.conversation_videos(spark, d).withColumn("dur", F.col("duration_sec"))
    lines, slides = V.conversation_segments(spark, d), V.conversation_slides(spark, d)
    speech = lines.select("video_id", F.col("t").alias("s"), (F.col("t") + 40.0).alias("e"))
    docs = videos.select("video_id", F.lit("x").alias("transcript"), F.lit("x").alias("notes"))
    return A.build_coverage(videos, A.gap_check(speech, lines, videos), A.scene_coverage(speech, slides, videos, slides), A.artifact_check(docs))


def notes_pages(spark: SparkSession, d: str) -> DataFrame:
    videos, lines, slides = V.conversation_videos(spark, d), V.conversation_segments(spark, d), V.conversation_slides(spark, d)
    cov = _talk_coverage(spark, d).select("video_id", "duration_sec", "ocr_engine", "gap_check", "scene_coverage", "artifacts")
    notes = R.notes_md(videos, lines, slides, cov)
    cut = F.instr("notes", CONTRACT.coverage)
    return notes.select("video_id", F.substr("notes", F.lit(1), cut - 1).alias("sections"), F.size(S.lines(F.substr("notes", cut))).alias("footer_lines"))


_TODO = "- 미보강: "
SQL["notes_pages"] = f"""{L._SHOWN}, safe AS (SELECT *, translate(trim(regexp_replace(title, '\\s+', ' ', 'g')), '[]|', '()/') AS s FROM shown),
part AS (SELECT video_id, string_agg('- [' || s || '](#sec-' || section_no || ')', chr(10) ORDER BY section_no) AS toc,
  string_agg('<a id="sec-' || section_no || '"></a>' || chr(10) || '### ' || s || chr(10) || CASE WHEN coalesce(frame, '') <> '' THEN chr(10) || '<img src="' || frame || '" alt="슬라이드 ' || section_no || '" width="480">' || chr(10) || chr(10)
    WHEN title = '도입' THEN '{CONTRACT.intro_marker}' || chr(10) ELSE '' END || '{_TODO}이 슬라이드 핵심을 요약 글머리표로 정리하세요.' || chr(10), chr(10) ORDER BY section_no) AS blocks FROM safe GROUP BY video_id)
SELECT video_id, array_to_string(['{CONTRACT.marker}', '# ' || title || ' — 학습 정리', '', '{CONTRACT.takeaway}', '{CONTRACT.open_marker}', '{_TODO}핵심 메시지 한 줄.', '{_TODO}핵심 메시지 한 줄.', '{_TODO}핵심 메시지 한 줄.', '', '{CONTRACT.toc}', toc, '',
  '{CONTRACT.flow}', '{CONTRACT.open_marker}', '{_TODO}도입→전개→마무리 흐름을 짧게 정리하세요.', '{_TODO}핵심 전개를 한 줄씩 정리하세요.', '', '{CONTRACT.concepts}', '{CONTRACT.open_marker}', '{_TODO}핵심 용어 → 정의를 영상 딥링크와 함께 정리하세요.', '',
  '{CONTRACT.detail}', '{CONTRACT.open_marker}', blocks, '{CONTRACT.questions}', '{CONTRACT.open_marker}', '- 미보강 질문: 핵심 확인 질문과 답을 작성하세요.', '', ''], chr(10)) AS sections, 7 AS footer_lines
FROM part JOIN talk USING (video_id)"""


def synthesis(spark: SparkSession, d: str) -> DataFrame:
    out = R.synthesis_input(V.conversation_videos(spark, d), V.conversation_segments(spark, d), V.conversation_slides(spark, d))
    whole = lambda x, f: x[f].cast("bigint").cast("string")

    def listed(name: str, line) -> Column:
        return F.coalesce(F.array_join(F.transform(name, line), "\n"), F.lit("")).alias(name)

    return out.select(
        "video_id", "schema_version", F.col("video.title").alias("title"), whole(F.col("video"), "duration_sec").alias("duration"),
        listed("transcript_segments", lambda x: F.concat(whole(x, "t"), F.lit(" "), x["text"])),
        listed("slides", lambda x: F.concat_ws(" ", whole(x, "t"), x["frame"], x["ocr_text"])),
        listed("section_hints", lambda x: F.concat_ws(" ", x["index"].cast("string"), whole(x, "t"), whole(x, "win_start"), whole(x, "t_end"), x["title"], x["frame"])),
    )


SQL["synthesis"] = f"""WITH {V.TALKS_SQL}, {L._HINTS},
a AS (SELECT video_id, string_agg(concat_ws(' ', CAST(t AS BIGINT), text), chr(10) ORDER BY seq) AS x FROM line GROUP BY video_id), b AS (SELECT video_id, string_agg(concat_ws(' ', CAST(t AS BIGINT), frame, ocr_text), chr(10) ORDER BY idx) AS x FROM slide GROUP BY video_id),
c AS (SELECT video_id, string_agg(concat_ws(' ', index, CAST(t AS BIGINT), CAST(win_start AS BIGINT), CAST(t_end AS BIGINT), title, frame), chr(10) ORDER BY index) AS x FROM hints GROUP BY video_id)
SELECT video_id, 1 AS schema_version, title, CAST(CAST(duration_sec AS BIGINT) AS VARCHAR) AS duration, coalesce(a.x, '') AS transcript_segments, coalesce(b.x, '') AS slides, coalesce(c.x, '') AS section_hints
FROM talk LEFT JOIN a USING (video_id) LEFT JOIN b USING (video_id) LEFT JOIN c USING (video_id)"""


def slide_counts(spark: SparkSession, d: str) -> DataFrame:
    slides = V.conversation_slides(spark, d).withColumn("ocr_text", F.when(F.col("idx") == 1, F.lit(" \n")).otherwise(F.col("ocr_text")))
    return A.slide_counts(slides, V.conversation_videos(spark, d))


SQL["slide_counts"] = f"WITH {V.TALKS_SQL} SELECT talk.video_id, count(slide.idx) AS slides_total, count(slide.idx) FILTER (WHERE slide.idx <> 1 AND trim(slide.ocr_text) <> '') AS slides_with_text FROM talk LEFT JOIN slide USING (video_id) GROUP BY talk.video_id"


def _written(spark: SparkSession, d: str) -> DataFrame:
    """Notes made from each order's number: what is missing or wrong in them follows from its remainders."""
    n = F.col("o_orderkey")
    rep = lambda line, count: F.array_join(F.array_repeat(F.lit(line), count.cast("int")), "")
    link = lambda sec: F.concat(F.lit("- x https://youtu.be/abc?t="), sec.cast("string"), F.lit("\n"))
    c = CONTRACT
    section = lambda a, body: F.concat(F.lit(f"{a}\n"), body)
    toc, flow = section(c.toc, F.lit("- t\n")), section(c.flow, rep("- f\n", n % 4))
    order = F.when(n % 13 == 1, F.concat(flow, toc)).when(n % 13 == 2, flow).otherwise(F.concat(toc, flow))
    picture = F.when(n % 3 == 0, F.lit('<IMG src="frames/a.png">\n')).otherwise("")
    detail = section(c.detail, F.concat(F.lit(f"### intro\n{c.intro_marker}\n- i\n### one\n"), F.when(n % 7 != 0, F.lit("- b\n")).otherwise(""), picture))
    text = F.concat(
        F.when(n % 5 == 0, F.lit("# \n")).otherwise(F.lit(f"{c.marker}\n")), section(c.takeaway, rep("- k\n", n % 5)), order, F.when(n % 17 == 0, F.lit(f"{c.open_marker}\n")).otherwise(""),
        section(c.concepts, F.concat(link(F.lit(59) + n % 4), F.when(n % 6 == 0, F.lit("- no link\n")).otherwise(""))), detail,
        section(c.questions, F.concat(*[F.when(n % 4 > i, link(F.lit(60))).otherwise("") for i in range(3)])), F.lit(f"{c.coverage}\n"),
    )
    transcript = F.when(n % 10 == 9, F.lit("")).otherwise(F.lit('<a id="t000100"></a> [00:01:00] x\n<a id="t000100-2"></a> y'))
    return V.read(spark, d, "orders").select(n.cast("string").alias("video_id"), text.alias("notes"), transcript.alias("transcript"), (n % 2 == 0).alias("has_frames"))


_N = "CAST(o_orderkey AS BIGINT)"


def _rule(condition: str, rule: str, ord_: int | str, detail: str) -> str:
    return f"SELECT CAST(o_orderkey AS VARCHAR) AS video_id, '{rule}' AS rule, CAST({ord_} AS INTEGER) AS ord, {detail} AS detail FROM orders WHERE {condition}"


def structure_problems(spark: SparkSession, d: str) -> DataFrame:
    return C.structure_problems(_written(spark, d))


SQL["structure_problems"] = " UNION ALL ".join([
    _rule("o_orderkey % 5 = 0", "marker", 0, f"'{CONTRACT.marker}'"), _rule("o_orderkey % 13 = 1", "section_order", 3, f"'{CONTRACT.flow}'"), _rule("o_orderkey % 13 = 2", "missing_section", 2, f"'{CONTRACT.toc}'"),
])


def enrichment_problems(spark: SparkSession, d: str) -> DataFrame:
    return C.enrichment_problems(_written(spark, d))


SQL["enrichment_problems"] = " UNION ALL ".join([
    _rule("o_orderkey % 17 = 0", "open_marker", 0, f"'{CONTRACT.open_marker}'"), _rule("o_orderkey % 5 <> 3 AND o_orderkey % 13 <> 1", "takeaways", 1, "CAST(o_orderkey % 5 AS VARCHAR)"),
    _rule("o_orderkey % 5 + o_orderkey % 4 <> 3 AND o_orderkey % 13 = 1", "takeaways", 1, "CAST(o_orderkey % 5 + o_orderkey % 4 AS VARCHAR)"), _rule("o_orderkey % 4 + CASE WHEN o_orderkey % 13 = 1 THEN 1 ELSE 0 END < 2", "flow", 2, "CAST(o_orderkey % 4 + CASE WHEN o_orderkey % 13 = 1 THEN 1 ELSE 0 END AS VARCHAR)"),
])


def detail_problems(spark: SparkSession, d: str) -> DataFrame:
    return C.detail_problems(_written(spark, d))


SQL["detail_problems"] = _rule("o_orderkey % 7 = 0", "slide_bullet", 2, "'### one'") + " UNION ALL " + _rule("o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0", "slide_image", 2, "'### one'")


def citation_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = _written(spark, d)
    return C.citation_problems(rows, rows)


SQL["citation_problems"] = " UNION ALL ".join([
    _rule("o_orderkey % 6 = 0", "concept_link_missing", 1, "'- no link'"), _rule("o_orderkey % 4 = 3 AND o_orderkey % 10 <> 9", "concept_link_off", 0, "'62'"),
    _rule("o_orderkey % 4 < 3", "few_cited_questions", 0, "CAST(o_orderkey % 4 AS VARCHAR)"),
])


def gate_contract(spark: SparkSession, d: str) -> DataFrame:
    return C.gate_contract(_written(spark, d))


SQL["gate_contract"] = " UNION ALL ".join(SQL[k] for k in ("structure_problems", "enrichment_problems", "detail_problems", "citation_problems"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "pending").otherwise("complete")
    folder = F.when(n % 4 != 0, F.concat(F.lit("/out/"), n.cast("string")))
    return V.read(spark, d, "orders").select(n.alias("index"), F.concat(F.lit("u"), n.cast("string")).alias("url"), status.alias("status"), folder.alias("output_dir"), F.when(n % 3 != 0, F.concat(F.lit("/cov/"), n.cast("string"), F.lit("/coverage.json"))).alias("coverage_json"), F.when(n % 5 == 0, F.lit("/n/notes.md")).alias("notes_md"), F.when(n % 2 == 0, F.lit("boom")).alias("error"))


_RUNS = """run AS (SELECT o_orderkey AS index, 'u' || o_orderkey AS url, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'pending' ELSE 'complete' END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN '/out/' || o_orderkey END AS output_dir,
  CASE WHEN o_orderkey % 3 <> 0 THEN '/cov/' || o_orderkey || '/coverage.json' END AS coverage_json, CASE WHEN o_orderkey % 5 = 0 THEN '/n/notes.md' END AS notes_md, CASE WHEN o_orderkey % 2 = 0 THEN 'boom' END AS error FROM orders)"""


def run_upsert(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d)
    n = F.col("index")
    at = (n + F.when(n % 2 == 0, 0).otherwise(100_000_000)).alias("index")
    first = runs.where(n % 7 == 0).select(at, F.lit("complete").alias("status"), F.when(n % 14 == 0, F.lit("/new")).alias("output_dir"), F.lit(1).alias("turn"))
    second = runs.where(n % 21 == 0).select(at, F.lit("failed").alias("status"), F.when(n % 5 == 0, F.lit("/newer")).alias("output_dir"), F.lit(2).alias("turn"))
    return T.upsert_runs(runs, first.unionByName(second), order="turn")


SQL["run_upsert"] = f"""WITH {_RUNS}, f AS (SELECT index + CASE WHEN index % 2 = 0 THEN 0 ELSE 100000000 END AS index, CASE WHEN index % 21 = 0 THEN 'failed' ELSE 'complete' END AS status,
  CASE WHEN index % 105 = 0 THEN '/newer' WHEN index % 14 = 0 THEN '/new' END AS output_dir FROM run WHERE index % 7 = 0)
SELECT coalesce(r.index, f.index) AS index, coalesce(f.status, r.status) AS status, r.url, coalesce(f.output_dir, r.output_dir) AS output_dir, r.coverage_json, r.notes_md, r.error FROM run r FULL JOIN f ON r.index = f.index"""


def run_paths(spark: SparkSession, d: str) -> DataFrame:
    runs = G.resolve_notes(_runs(spark, d))
    files = _runs(spark, d).where("index % 8 = 1").select(F.concat(F.lit("/out/"), F.col("index").cast("string"), F.lit("/frames/A.PNG")).alias("path"))
    return G.has_frame_png(runs, files).select("index", "notes_path", "transcript_path", "has_frames")


_PATH = "coalesce(notes_md, output_dir || '/notes.md', regexp_replace(coverage_json, '[^/]*$', 'notes.md'), '')"
SQL["run_paths"] = f"WITH {_RUNS} SELECT index, {_PATH} AS notes_path, regexp_replace({_PATH}, '[^/]*$', 'transcript.md') AS transcript_path, index % 8 = 1 AS has_frames FROM run"


def _gate_problems(spark: SparkSession, d: str) -> DataFrame:
    runs, n = _runs(spark, d), F.col("index")
    coverage = runs.where("coverage_json is not null").select("index", (n % 6 != 1).alias("overall_pass"), (n % 4 != 1).alias("gap_passed"), (n % 8 != 5).alias("scene_passed"), F.lit(True).alias("artifacts_passed"))
    present = runs.select("index", (n % 9 != 0).alias("has_notes"), (n % 11 != 0).alias("has_transcript"))
    found = runs.where(n % 10 == 3).select("index", F.lit("flow").alias("rule"), F.lit("0").alias("detail"))
    return G.run_problems(runs, coverage, found, present)


def gate_report(spark: SparkSession, d: str) -> DataFrame:
    out = G.gate_report(_runs(spark, d), _gate_problems(spark, d))
    return out.select("index", "label", "n_problems", F.array_join("rules", ",").alias("rules"))


_GATE = f"""WITH {_RUNS}, live AS (SELECT * FROM run WHERE status = 'complete'), seen AS (SELECT * FROM live WHERE coverage_json IS NOT NULL),
p AS (SELECT index, status AS rule FROM run WHERE status <> 'complete' UNION ALL SELECT index, 'coverage_missing' FROM live WHERE coverage_json IS NULL
  UNION ALL SELECT index, 'gap' FROM seen WHERE index % 6 = 1 AND index % 4 = 1 UNION ALL SELECT index, 'scene' FROM seen WHERE index % 6 = 1 AND index % 8 = 5
  UNION ALL SELECT index, 'notes_missing' FROM seen WHERE index % 9 = 0 UNION ALL SELECT index, 'transcript_missing' FROM seen WHERE index % 9 <> 0 AND index % 11 = 0
  UNION ALL SELECT index, 'flow' FROM seen WHERE index % 9 <> 0 AND index % 11 <> 0 AND index % 10 = 3)"""
SQL["gate_report"] = f"{_GATE} SELECT run.index, coalesce(output_dir, url) AS label, count(p.rule) AS n_problems, coalesce(string_agg(p.rule, ',' ORDER BY p.rule), '') AS rules FROM run LEFT JOIN p USING (index) GROUP BY run.index, label"


def gate_exit_code(spark: SparkSession, d: str) -> DataFrame:
    return G.gate_exit_code(_gate_problems(spark, d))


SQL["gate_exit_code"] = f"{_GATE} SELECT count(*) AS n_problems, CASE WHEN count(*) > 0 THEN 2 ELSE 0 END AS exit_code FROM p"


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    detail = F.when(n % 2 == 0, F.lit("1.0 does not satisfy >=2")).otherwise("not found")
    status = F.when(n % 97 == 0, "unfixable").when(n % 23 == 0, S.status_from_detail(detail)).otherwise("ok")
    items = V.read(spark, d, "orders").select((F.col("o_custkey") % 500).alias("host"), status.alias("status"))
    return G.status_exit_code(items, ["host"]).withColumn("overall", S.overall_status(F.col("exit_code")))


SQL["status_rollup"] = """WITH s AS (SELECT o_custkey % 500 AS host, CASE WHEN o_orderkey % 97 = 0 THEN 2 WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS w FROM orders), m AS (SELECT host, max(w) AS w FROM s GROUP BY host)
SELECT host, CASE w WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS exit_code, CASE w WHEN 2 THEN 'internal-unfixable' WHEN 1 THEN 'user-action' ELSE 'ready' END AS overall FROM m"""


def version_checks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    a = F.concat((n % 3).cast("string"), F.lit("."), (n % 12).cast("string"), F.when(n % 4 == 0, ".post1").when(n % 4 == 1, "rc2").otherwise(""))
    b = F.concat((n % 2 + 1).cast("string"), F.lit("."), (n % 7).cast("string"), F.lit(".0"))
    return V.read(spark, d, "part").select("p_partkey", S.compare_versions(a, b).alias("cmp"), S.satisfies_version(a, ">=1.4,<2, !x").alias("fits"), S.same_release(a, b).alias("same"))


SQL["version_checks"] = """WITH v AS (SELECT p_partkey, CAST(p_partkey % 3 AS BIGINT) AS a1, CAST(p_partkey % 12 AS BIGINT) AS a2, CAST(p_partkey % 2 + 1 AS BIGINT) AS b1, CAST(p_partkey % 7 AS BIGINT) AS b2 FROM part)
SELECT p_partkey, CASE WHEN (a1, a2) > (b1, b2) THEN 1 WHEN (a1, a2) < (b1, b2) THEN -1 ELSE 0 END AS cmp, a1 = 1 AND a2 >= 4 AS fits, (a1, a2) = (b1, b2) AS same FROM v"""


def ocr_languages(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("ko-KR", " KO_en ", "", "ENG", "english", "korean-english", None)])
    return V.read(spark, d, "orders").select(n, S.ocr_language(F.get(names, (n % 7).cast("int"))).alias("language"))


SQL["ocr_languages"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (3, 4) THEN 'en' ELSE 'korean' END AS language FROM orders"


def run_state_files(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    one = F.concat(F.lit('{"session_id":"s","runs":[{"index":'), n.cast("string"), F.lit(',"url":"u","status":"pending"}]}'))
    body = F.when(n % 3 == 0, one).when(n % 3 == 1, F.lit("{broken")).otherwise(F.lit('{"runs":[]}'))
    files = V.read(spark, d, "orders").select(n.cast("string").alias("path"), body.alias("body"))
    return X.parse_run_state(files).select("path", "status", F.coalesce("index", F.lit(-1)).cast("bigint").alias("index"))


SQL["run_state_files"] = "SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE o_orderkey % 3 WHEN 0 THEN 'pending' ELSE 'failed' END AS status, CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderkey ELSE -1 END AS BIGINT) AS index FROM orders WHERE o_orderkey % 3 < 2"


def release_sections(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("# Log\n## [0.1.10] - x\nten\n## [0.1.1] - y\n\n- item "), n, F.lit("\nmore\n\n[0.1.1]: http://h/"), n, F.lit("\n"))
    logs = V.read(spark, d, "orders").select(n.alias("path"), body.alias("body"))
    return X.release_notes(logs, "0.1.1").join(X.release_link(logs, "0.1.1"), "path")


SQL["release_sections"] = "SELECT CAST(o_orderkey AS VARCHAR) AS path, '- item ' || o_orderkey || chr(10) || 'more' AS notes, 'http://h/' || o_orderkey AS link FROM orders"

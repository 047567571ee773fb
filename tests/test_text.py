import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronotext.functions import scalars as S
from chronotext.model import CONTRACT
from chronotext.operators import contract, coverage, gate, render, temporal
from chronotext.sources import captions, state


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("t", "want"), [(-0.49, "00:00:00"), (-90.0, "00:00:00"), (59.6, "00:01:00"), (3599.6, "01:00:00"), (7322.4, "02:02:02"), (0.5, "00:00:00"), (1.5, "00:00:02"), (360000.0, "100:00:00")])
def test_timestamps(spark, t, want):
    assert one(spark, t, "double", S.format_timestamp) == want


@pytest.mark.parametrize(("title", "want"), [("한국어: 제목/둘", "한국어-제목-둘"), ("  ", "video"), (None, "video"), ("a" * 200, "a" * 80), ("--x  y--", "x-y"), ("é_1", "é_1")])
def test_slugs(spark, title, want):
    assert one(spark, title, "string", S.slugify) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://www.youtube.com/watch?v=abcdefghijk&t=1", "abcdefghijk"), ("https://youtu.be/abcdefghijk", "abcdefghijk"), ("x/shorts/abcdefghijklm", "abcdefghijk"), ("x/embed/abcdefghijk", "abcdefghijk"), (" abcdefghijk ", "abcdefghijk"), ("abcdefghijkl", None), ("", None)],
)
def test_video_ids(spark, url, want):
    assert one(spark, url, "string", S.video_id_of) == want


def test_frame_names(spark):
    """Names put together from a stem, a number, a unit and an ending, so that the time in them is known."""
    rows, want = [], {}
    for stem, number, unit, end in itertools.product(("shot-", "/v/x/frame_", "C:\\clips\\a_b-", ""), ("3", "0017", "4.75", "120"), ("", "s", "Sec"), (".png", ".JPEG", "")):
        if end == "" and "." in number:
            continue  # what follows the point is taken for an ending
        name, seconds = f"{stem}{number}{unit}{end}", bool(unit) or "." in number
        want[name] = (float(number), "filename_seconds") if seconds else (float(number) / 2, "filename_pts_over_fps")
        rows.append((name,))
    for name in ("intro.png", "slide12b.png", "7x.png", "/d/-.png", ""):
        want[name] = (0.0, "fallback_unparseable")
        rows.append((name,))
    got = spark.createDataFrame(rows, "x string").select("x", S.frame_time(F.col("x")).alias("at")).collect()
    assert {r["x"]: (r["at"]["t"], r["at"]["source"]) for r in got} == want


def test_geometry(spark):
    r = random.Random(4)
    sizes = [(r.randrange(1, 5000), r.randrange(1, 3000)) for _ in range(200)] + [(1, 1), (3, 700)]
    df = spark.createDataFrame(sizes, "w int, h int")
    for margin, kept in ((0.035, 0.80), (0.3, 0.5), (0.01, 1.0)):
        share = max(0.0, min(margin, (1 - kept) / 2))
        for row in df.select("w", "h", S.roi_box(F.col("w"), F.col("h"), margin, kept).alias("b")).collect():
            x, y = round(row["w"] * share), round(row["h"] * share)
            inner = (x, y, row["w"] - x, row["h"] - y)
            assert tuple(row["b"]) == (inner if inner[2] > x and inner[3] > y else (0, 0, row["w"], row["h"]))
    for row in df.select("w", "h", S.upscaled_size(F.col("w"), F.col("h"), 1.5, 2000).alias("s")).collect():
        large = max(row["w"], row["h"])
        f = 1.5 if large * 1.5 <= 2000 else max(2000 / large, 1.0)
        assert tuple(row["s"]) == tuple(max(1, round(v * f)) for v in (row["w"], row["h"]))
    for wrong in ((0, 7), (7, -1)):
        with pytest.raises(Exception, match="positive"):
            spark.createDataFrame([wrong], "w int, h int").select(S.upscaled_size(F.col("w"), F.col("h"))).collect()


def test_hashes(spark):
    f = lambda x: one(spark, x, "string", S.hash_to_long)
    r = random.Random(7)
    for _ in range(12):
        n = r.getrandbits(r.randrange(1, 65))
        signed = n - (1 << 64) if n >> 63 else n
        assert {f(x) for x in (f"0x{n:X}", f"0b{n:b}", f"0b{n:064b}", f" {n:016x} ", f"{n:_x}" if n > 0xFFFFFFFFFF else f"0x{n:x}")} == {signed}
    assert [f(str(n)) for n in (0, 9, 4_000_000_000)] == [0, 9, 4_000_000_000] and f(" ") == 0 and f("4_2") == 42
    assert one(spark, None, "string", S.hash_to_long) is None
    for wrong in ("zz", "0x" + "1" * 17, "0b2", "fg", "1" * 17, "-5"):
        with pytest.raises(Exception, match="not a hash"):
            f(wrong)
    assert one(spark, -1, "long", S.hash_hex) == "f" * 16
    assert spark.range(1).select(S.hamming(F.lit(0), F.lit(1023)), S.is_same_phash(F.lit(0), F.lit(8191))).first() == (10, False)


def test_versions(spark):
    c = lambda a, b: spark.range(1).select(S.compare_versions(F.lit(a), F.lit(b))).first()[0]
    assert (c("1.2", "1.2.0"), c("1.10", "1.9"), c("2.0rc1", "2.1"), c("1.0.post1", "1.0")) == (0, 1, -1, 0)
    ok = lambda v, s: spark.range(1).select(S.satisfies_version(F.lit(v), s)).first()[0]
    assert ok("2.7.3", ">=2.7,<3") and not ok("3.0", ">=2.7,<3") and ok("4.6.0.66", ">=4.5,<=4.6.0.66") and ok("1", "!x") and not ok("1", "==2")
    assert ok("1.5", "<=1.5") and not ok("1.5", "<1.5") and not ok("1.5", ">1.5 , <9") and ok("2", " >= 1.9 ,, < 3") and ok("7", "")
    assert c("20240101123456789012.1", "20240101123456789012.0") == 1 and c("9" * 50, "1") == 1
    same = lambda a, b: spark.range(1).select(S.same_release(F.lit(a), F.lit(b))).first()[0]
    assert same("4.6.0", "4.6.0.66") and not same("4.6.1", "4.6.0.66") and same("x", "x") and not same("x", "1")


def test_small_scalars(spark):
    assert one(spark, " a b　 c\n", "string", S.collapse) == "a b c"
    assert one(spark, "a\nb\r\nc\n", "string", S.lines) == ["a", "b", "c"] and one(spark, "", "string", S.lines) == []
    assert one(spark, "\n  first [x]|\nsecond", "string", lambda x: S.first_line(x, F.lit("none"))) == "first [x]|"
    assert one(spark, "a [b]\n|c", "string", S.safe_title) == "a (b) /c"
    assert one(spark, "t010203-4", "string", S.anchor_seconds) == 3723
    assert [one(spark, x, "string", S.ocr_language) for x in ("kor", "KO-kr", None, "", "Eng ")] == ["korean"] * 4 + ["en"]
    assert one(spark, "/out/x/frames/a.png", "string", lambda x: S.frame_link(x, F.lit("/out/x"))) == "frames/a.png"
    assert [one(spark, x, "int", S.overall_status) for x in (0, 2, 1)] == ["ready", "user-action", "internal-unfixable"]
    with pytest.raises(Exception, match="no OCR model"):
        one(spark, "xx", "string", S.ocr_language)


def test_vtt(spark):
    body = "WEBVTT\r\n\r\n00:00:01,25 --> 00:00:02.000 align:start\r\n<c>foo</c>  bar\r\nmore\r\n\r\nnoise\r\n00:00:02.5 --> x\nfoo bar more\n\n01:00.000 --> 2\nlate\n00:00:09.000 --> y\n\n"
    files = spark.createDataFrame([("v", body), ("empty", "")], "video_id string, body string")
    got = [(r["t"], r["text"]) for r in captions.parse_vtt(files).orderBy("seq").collect()]
    assert got == [(1.25, "foo bar more"), (0.0, "late")]


def test_json3(spark):
    body = '{"events":[{"tStartMs":1000,"segs":[{"utf8":"a "},{"utf8":"b"}]},{"segs":[]},{"tStartMs":2500,"segs":[{"utf8":"c"}]},{"tStartMs":4000,"segs":[{"utf8":"\\n"}]},{"segs":[{"utf8":"z"}]}]}'
    files = spark.createDataFrame([("v", body)], "video_id string, body string")
    assert [(r["t"], r["text"]) for r in captions.parse_json3(files).orderBy("seq").collect()] == [(1.0, "a b"), (2.5, "c"), (0.0, "z")]
    with pytest.raises(Exception):  # noqa: B017  Spark wraps the parser's error
        captions.parse_json3(spark.createDataFrame([("v", "{nope")], "video_id string, body string")).collect()


def test_metadata(spark):
    rows = [("a", '{"title":" T ","duration":"12.5","id":"x"}'), ("b", '{"title":" ","duration":-1,"id":"","display_id":"d"}'), ("c", '{"duration":"soon"}')]
    got = {r["video_id"]: tuple(r)[1:] for r in captions.parse_metadata(spark.createDataFrame(rows, "video_id string, body string")).collect()}
    assert got == {"a": ("T", 12.5, "x"), "b": (None, None, "d"), "c": (None, None, None)}
    with pytest.raises(Exception, match="JSON object"):
        captions.parse_metadata(spark.createDataFrame([("a", "[1]")], "video_id string, body string")).collect()


@pytest.mark.parametrize(
    ("log", "dur", "want"),
    [
        ("silence_start: 30.0\nsilence_end: 600.0", 630, [(0, 30), (600, 630)]), ("", 12, [(0, 12)]), ("silence_start: 8", 12, [(0, 8)]),
        ("silence_end: 2.0\nsilence_start: bad\nsilence_start: 5.0\nx\nsilence_end: 7.5 | silence_duration: 2.5", 10, [(2, 5), (7.5, 10)]),
        ("silence_start: 1\nsilence_start: 3\nsilence_end: 4", 5, [(0, 3), (4, 5)]), ("silence_start: -0.5\nsilence_end: 2", 5, [(2, 5)]),
    ],
)
def test_silence(spark, log, dur, want):
    logs = spark.createDataFrame([("v", log, float(dur))], "video_id string, body string, dur double")
    assert sorted((r["s"], r["e"]) for r in captions.parse_silence(logs).collect()) == want


def test_failed_detector_is_no_speech(spark):
    logs = spark.createDataFrame([("v", "silence_start: 2", 9.0, 0)], "video_id string, body string, dur double, exit_code int")
    assert [(r["s"], r["e"]) for r in captions.detect_speech(logs).collect()] == [(0.0, 2.0)]
    for code in (1, None):
        with pytest.raises(Exception, match="detector failed for v"):
            captions.detect_speech(logs.withColumn("exit_code", F.lit(code).cast("int"))).collect()


def test_json_objects(spark):
    assert one(spark, ' {"a": [1]} ', "string", captions.json_object) == ' {"a": [1]} '
    for wrong in ("[1]", '"x"', "", "{broken", None):
        with pytest.raises(Exception, match="JSON|json|MALFORMED"):
            one(spark, wrong, "string", captions.json_object)


def test_staged_captions(spark):
    rows = [("v", "en", 0, 1.0, "hello"), ("v", "ko", 0, 1.0, "안녕"), ("v", "ko", 1, 2.0, " "), ("w", "en", 0, 0.0, "x"), ("w", "fr", 0, 0.0, "y"), ("z", "fr", 0, 0.0, "y")]
    got = captions.staged_captions(spark.createDataFrame(rows, "video_id string, language string, seq int, t double, text string")).collect()
    assert sorted((r["video_id"], r["text"]) for r in got) == [("v", "안녕"), ("w", "x")]


VIDEO = "video_id string, title string, duration_sec double, source string"


def talk(spark):
    videos = spark.createDataFrame([("v", "T [x]", 80.0, "caption"), ("bare", None, 10.0, None)], VIDEO)
    segments = spark.createDataFrame([("v", i, t, x) for i, (t, x) in enumerate([(1.0, "a"), (1.0, ""), (30.0, "b"), (79.0, " c ")])], "video_id string, seq int, t double, text string")
    slides = spark.createDataFrame([("v", 0, 12.5, "frames/a.png", "Slide one\nmore")], "video_id string, idx int, t double, frame string, ocr_text string")
    return videos, segments, slides


def test_rendering_fulfils_its_contract(spark):
    videos, segments, slides = talk(spark)
    transcripts = render.transcript_md(videos, segments)
    text = {r["video_id"]: r["transcript"] for r in transcripts.collect()}
    assert text["v"].count("<a id=") == 4 and '<a id="t000001-2"></a> [00:00:01] \n' in text["v"] and text["v"].endswith("c\n") and text["bare"].startswith("# Untitled")
    v = videos.withColumn("dur", F.col("duration_sec"))
    speech = spark.createDataFrame([("v", 0.0, 80.0)], "video_id string, s double, e double")
    cov = coverage.build_coverage(v, coverage.gap_check(speech, segments, v), coverage.scene_coverage(speech, slides, v, slides), coverage.artifact_check(transcripts.withColumn("notes", F.lit("x"))))
    notes = render.notes_md(videos, segments, slides, cov.select("video_id", "duration_sec", "ocr_engine", "gap_check", "scene_coverage", "artifacts"))
    assert notes.count() == 2 and contract.coverage_contract(notes).count() == 0
    again = coverage.coverage_of_extraction(videos=v, segments=segments, speech=speech, raw_frames=slides, slides=slides, documents=transcripts.withColumn("notes", F.lit("x")))
    assert sorted(map(str, again.collect())) == sorted(map(str, cov.collect()))
    page = notes.where("video_id = 'v'").first()["notes"]
    assert "### 도입\n" + CONTRACT.intro_marker in page and '<img src="frames/a.png" alt="슬라이드 2" width="480">' in page and "- 전체 길이: 00:01:20" in page
    rules = {r["rule"] for r in contract.gate_contract(notes.join(transcripts, "video_id").withColumn("has_frames", F.lit(True)).where("video_id = 'v'")).collect()}
    assert rules == {"open_marker", "concept_link_missing", "few_cited_questions"}
    nested = render.synthesis_input(videos, segments, slides).where("video_id = 'v'").first()
    assert len(nested["transcript_segments"]) == 4 and [h["title"] for h in nested["section_hints"]] == ["도입", "Slide one"]


def finished(**change):
    part = {"take": "- a\n- b\n- c\n", "flow": "- a\n- b\n", "link": "60", "answers": 3, "detail": '### one\n- x\n<img src="frames/a.png">\n'} | change
    link = f"- x https://youtu.be/abc?t={part['link']}\n"
    c = CONTRACT
    return f"{c.marker}\n{c.takeaway}\n{part['take']}{c.toc}\n{c.flow}\n{part['flow']}{c.concepts}\n{link}{c.detail}\n{part['detail']}{c.questions}\n{link * part['answers']}{c.coverage}\n"


@pytest.mark.parametrize(
    ("change", "rules"),
    [
        ({}, []), ({"link": "61"}, []), ({"link": "62", "answers": 3}, ["concept_link_off", "question_link_off"]), ({"take": "- a\n- b\n"}, ["takeaways"]), ({"take": "- a\n" * 4}, ["takeaways"]), ({"flow": "- a\n"}, ["flow"]), ({"flow": "- a\n" * 3}, []),
        ({"answers": 2}, ["few_cited_questions"]), ({"detail": "### one\ntext\n"}, ["slide_bullet", "slide_image"]), ({"detail": f"### i\n{CONTRACT.intro_marker}\n- x\n"}, []), ({"detail": "### one\n- x\n![a](frames/b.png)\n"}, []),
    ],
)
def test_contract_mutations(spark, change, rules):
    df = spark.createDataFrame([("v", finished(**change), '<a id="t000100"></a> x', True)], "video_id string, notes string, transcript string, has_frames boolean")
    assert sorted({r["rule"] for r in contract.gate_contract(df).collect()}) == rules


def test_links_beyond_all_seconds(spark):
    df = spark.createDataFrame([("v", finished(link="9" * 25), '<a id="t000100"></a> x', True), ("w", finished(link="9223372036854775807"), "", True)], "video_id string, notes string, transcript string, has_frames boolean")
    got = {(r["video_id"], r["rule"], r["detail"]) for r in contract.gate_contract(df).collect()}
    assert got == {("v", "concept_link_off", "9" * 25), ("v", "question_link_off", "9" * 25)}
    assert got == {(r["video_id"], r["rule"], r["detail"]) for r in contract.citation_problems(df, df).collect()}


def test_contract_in_one_pass_equals_its_parts(spark):
    changes = [{}, {"link": "62"}, {"take": "- a\n"}, {"answers": 1}, {"detail": "### a\r\ntext\n### b\n- x\n### c"}, {"detail": f"- before\n### i {CONTRACT.intro_marker}\n"}, {"detail": ""}]
    rows = [(f"v{i}", finished(**c), '<a id="t000100"></a>', bool(i % 2)) for i, c in enumerate(changes * 2)] + [("none", None, None, None)]
    df = spark.createDataFrame(rows, "video_id string, notes string, transcript string, has_frames boolean")
    parts = [contract.structure_problems(df), contract.enrichment_problems(df), contract.detail_problems(df), contract.citation_problems(df, df)]
    assert sorted(map(tuple, contract.gate_contract(df).collect())) == sorted(tuple(r) for p in parts for r in p.collect())


def test_structure_of_nothing(spark):
    df = spark.createDataFrame([("v", None), ("w", finished().replace(CONTRACT.flow, "## x"))], "video_id string, notes string")
    got = contract.structure_problems(df).groupBy("video_id").count().collect()
    assert {r["video_id"]: r["count"] for r in got} == {"v": 8, "w": 1}


def test_run_state_fails_closed(spark):
    good = '{"session_id":"s","runs":[{"index":0,"url":"u","status":"complete"},{"index":1,"url":"w","status":"pending"}]}'
    files = spark.createDataFrame([("a", good), ("b", "{broken"), ("c", '{"runs":[]}')], "path string, body string")
    assert sorted((r["path"], r["status"]) for r in state.parse_run_state(files).collect()) == [("a", "complete"), ("a", "pending"), ("b", "failed")]


def test_sessions(spark, tmp_path):
    runs = gate.start_session(spark, ["u0", "u1"])
    update = spark.createDataFrame([(1, "complete", "/o"), (5, "failed", None)], "index int, status string, output_dir string")
    out = temporal.upsert_runs(runs, update)
    assert {r["index"]: (r["status"], r["url"], r["output_dir"]) for r in out.collect()} == {0: ("pending", "u0", None), 1: ("complete", "u1", "/o"), 5: ("failed", None, None)}
    turns = [("a", 0, "complete", None, 2), ("a", 0, "pending", "/p", 1), ("b", 0, "failed", None, 1), ("b", 7, "failed", "/q", 3), ("b", 7, "complete", None, 4)]
    updates = spark.createDataFrame(turns, "session_id string, index int, status string, output_dir string, turn int")
    keyed = spark.createDataFrame([("a", 0, "u", "pending", "/o"), ("b", 0, "w", "pending", "/o")], "session_id string, index int, url string, status string, output_dir string")
    got = temporal.upsert_runs(keyed, updates, ("session_id", "index"), "turn").collect()
    assert sorted(map(tuple, got), key=str) == [("a", 0, "complete", "u", "/p"), ("b", 0, "failed", "w", "/o"), ("b", 7, "complete", None, "/q")]
    state.save_runs(out, f"{tmp_path}/runs")
    assert state.load_runs(spark, f"{tmp_path}/runs").count() == 3
    assert gate.gate_exit_code(out.where("false").select("index")).first()["exit_code"] == 0


@pytest.mark.parametrize(("statuses", "code"), [(["ok", "ok"], 0), (["ok", "missing"], 2), (["incompatible"], 2), (["missing", "unfixable"], 1)])
def test_status_codes(spark, statuses, code):
    assert gate.status_exit_code(spark.createDataFrame([(s,) for s in statuses], "status string")).first()["exit_code"] == code


def test_report(spark):
    rows = [("h", 0, "python", "ok", "3.13", ""), ("h", 1, "ffmpeg", "missing", None, "install it")]
    out = gate.report_lines(spark.createDataFrame(rows, "host string, ord int, name string, status string, detail string, hint string"), ["host"])
    assert out.first()["report"] == "[ok] python: 3.13\n[missing] ffmpeg:  -> install it\nuser-action"


def test_stage_summary(spark):
    df = spark.createDataFrame([("ocr", 100.0, 500e6), ("ocr", 300.0, 900e6)], "stage string, cpu double, rss double")
    assert tuple(gate.stage_summary(df).first()) == ("ocr", 2, 200.0, 300.0, 700.0, 900.0)


def test_release_notes(spark):
    log = "# Log\n\n## [0.1.10] - x\nten\n\n## [0.1.1] - y\n\n- one\n\n- two\n\n[0.1.1]: http://l\n"
    df = spark.createDataFrame([("p", log)], "path string, body string")
    assert state.release_notes(df, "0.1.1").first()["notes"] == "- one\n\n- two" and state.release_notes(df, "9").first()["notes"] == "" and state.release_link(df, "0.1.1").first()["link"] == "http://l"


def test_sinks_and_frame_files(spark, tmp_path):
    state.write_json(spark.createDataFrame([("v", "한", None)], "video_id string, a string, b string"), f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").first()[0] == '{"video_id":"v","a":"한","b":null}'
    state.write_text(spark.createDataFrame([("v", "a\nb\n")], "video_id string, t string"), "t", f"{tmp_path}/t", ["video_id"])
    assert captions.read_texts(spark, f"{tmp_path}/t/*/*.txt").first()["body"] == "a\nb\n"
    (tmp_path / "f").mkdir()
    for name in ("frame_00004.png", "frame_7s.png", "other.png"):
        (tmp_path / "f" / name).write_bytes(b"x")
    assert sorted((r["t"], r["ts_source"]) for r in captions.read_frames(spark, f"{tmp_path}/f").collect()) == [(2.0, "filename_pts_over_fps"), (7.0, "filename_seconds")]


def test_fetchers(spark):
    videos = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", None)], "video_id string, url string")
    make = lambda: lambda url: {"u1": "/m/a.wav", "u2": ""}[url]
    got = {r["video_id"]: (r["path"], r["warning"]) for r in captions.run_fetcher(videos, make, strict=False).collect()}
    assert got["a"] == ("/m/a.wav", None) and got["b"] == (None, "FileNotFoundError: nothing was fetched from u2") and got["c"][0] is None and "KeyError" in got["c"][1]
    with pytest.raises(Exception, match="video b"):
        captions.run_fetcher(videos.where("video_id = 'b'"), make).collect()


def test_metrics_are_written(spark, tmp_path):
    state.write_metrics(spark.createDataFrame([("ocr", 100.0, 500e6), ("ocr", 300.0, 900e6)], "stage string, cpu double, rss double"), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first()["cpu_peak"] == 300.0


def test_engines_run_once_a_task(spark):
    audio = spark.createDataFrame([("v", "p")], "video_id string, path string")
    out = captions.run_transcriber(audio, lambda: lambda path: [(0.0, " a  b "), (1.0, " ")]).collect()
    assert [(r["t"], r["text"]) for r in out] == [(0.0, "a b")]

    def engines():
        def broken(path):
            raise OSError

        return [("first", broken), ("second", lambda path: "text")]

    row = captions.run_ocr(audio, engines).first()
    assert (row["engine"], row["warning"]) == ("second", "first: OSError: ")
    captions.checked_engine("2.9.1")
    captions.checked_engine(None)
    for wrong in ("3.0", "2.6.9"):
        with pytest.raises(RuntimeError, match="outside"):
            captions.checked_engine(wrong)

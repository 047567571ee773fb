import random

import pytest
from pyspark.sql import functions as F

from chronotext.operators import coverage, spans, temporal

SPAN = "video_id string, s double, e double"


def make(spark, rows, video="v"):
    return spark.createDataFrame([(video, float(a), float(b)) for a, b in rows], SPAN)


def got(df):
    return sorted((r["s"], r["e"]) for r in df.collect())


def cues(spark, times, video="v"):
    return spark.createDataFrame([(video, float(t)) for t in times], "video_id string, t double")


def videos(spark, dur, video="v"):
    return spark.createDataFrame([(video, float(dur))], "video_id string, dur double")


def test_merge(spark):
    assert got(spans.merge_spans(make(spark, [(0, 5), (4, 8), (10, 12)]))) == [(0, 8), (10, 12)]
    assert got(spans.merge_spans(make(spark, [(8, 10), (0, 4), (4, 6), (7, 7), (9, 3), (1, 2)]))) == [(0, 6), (8, 10)]
    assert got(spans.merge_spans(make(spark, []))) == []


def test_merge_in_pieces_is_the_same(spark):
    r = random.Random(1)
    rows = [(a, a + r.randrange(12)) for a in (r.randrange(500) for _ in range(300))]
    assert got(spans.merge_spans(make(spark, rows), piece=20)) == got(spans.merge_spans(make(spark, rows)))


def test_complement(spark):
    bounds = spark.createDataFrame([("v", 0.0, 20.0), ("none", 0.0, 5.0), ("flat", 3.0, 3.0)], "video_id string, lo double, hi double")
    out = spans.complement_spans(make(spark, [(0, 5), (10, 12)]), bounds).collect()
    assert sorted(map(tuple, out)) == [("none", 0, 5), ("v", 5, 10), ("v", 12, 20)]
    inside = bounds.where("video_id = 'v'")
    assert got(spans.complement_spans(make(spark, [(-5, 2), (18, 30), (40, 50)]), inside)) == [(2, 18)]


def test_subtract(spark):
    assert got(spans.subtract_spans(make(spark, [(0, 100)]), make(spark, [(10, 20), (30, 40)]))) == [(0, 10), (20, 30), (40, 100)]
    assert got(spans.subtract_spans(make(spark, [(0, 5)]), make(spark, []))) == [(0, 5)]
    assert got(spans.subtract_spans(make(spark, [(0, 5), (5, 9)]), make(spark, [(-1, 10)]))) == []
    assert got(spans.subtract_spans(make(spark, [(0, 5), (5, 9)]), make(spark, [(20, 30)]))) == [(0, 9)]


def test_cover(spark):
    assert got(spans.cover_spans(cues(spark, [50, -1, 10, 999, 0]), videos(spark, 60))) == [(0, 40), (50, 60)]
    assert got(spans.cover_spans(cues(spark, [7]), videos(spark, 20))) == [(7, 20)]
    assert got(spans.cover_spans(cues(spark, [7]), videos(spark, 100))) == [(7, 37)]


@pytest.mark.parametrize(
    ("speech", "cover", "gap"),
    [([(10, 20)], [], 10), ([(10, 20)], [(-100, 0), (30, 40)], 10), ([], [], 0), ([(80, 100), (0, 40), (30, 80)], [(70, 100), (0, 10), (8, 10)], 60)],
)
def test_longest_gap(spark, speech, cover, gap):
    assert spans.max_gap(make(spark, speech), make(spark, cover), videos(spark, 100)).first()["gap"] == gap


def test_gap_stays_within_the_speech(spark):
    r = random.Random(17)
    speech, cover, names = [], [], [f"v{i}" for i in range(60)]
    for v in names:
        for rows in (speech, cover):
            for _ in range(r.randrange(6)):
                a, b = r.uniform(-20, 120), r.uniform(-20, 120)
                rows.append((v, a, b))
    s, c = spark.createDataFrame(speech, SPAN), spark.createDataFrame(cover, SPAN)
    keys = spark.createDataFrame([(v,) for v in names], "video_id string")
    total = spans.merge_spans(s).groupBy("video_id").agg(F.sum(F.col("e") - F.col("s")).alias("total"))
    out = spans.max_gap(s, c, keys).join(total, "video_id", "left").collect()
    assert len(out) == 60 and all(0 <= r["gap"] <= (r["total"] or 0) + 1e-9 for r in out)


@pytest.mark.parametrize(
    ("speech", "times", "dur", "passed"),
    [
        ([(0, 300)], [0, 50, 100, 280, 290], 300, False), ([(0, 30), (600, 630)], [0, 10, 20, 600, 610, 620], 630, True), ([(0, 60)], [], 100, True), ([(0, 60.001)], [], 100, False),
    ],
)
def test_gap_check(spark, speech, times, dur, passed):
    assert coverage.gap_check(make(spark, speech), cues(spark, times), videos(spark, dur)).first()["passed"] is passed


def scene(spark, speech, frames, dur, bins=20, carry=120.0):
    return coverage.scene_coverage(make(spark, speech), cues(spark, frames), videos(spark, dur), bins=bins, carry=carry).first()


def test_scene_coverage(spark):
    assert not scene(spark, [(0, 200)], [150], 200, bins=10)["passed"]
    stall = scene(spark, [(0, 600)], [*range(100), 590, 595], 600)
    assert not stall["passed"] and stall["uncovered_bins"] == list(range(8, 19))
    assert scene(spark, [(0, 600)], range(600), 600)["passed"]
    empty = scene(spark, [(0, 5)], [1], 0, bins=0)
    assert (empty["bins"], empty["speech_bins"], empty["passed"], empty["vacuous"]) == (1, [], True, True)


def test_scene_coverage_with_slides(spark):
    slides = lambda texts: spark.createDataFrame([("v", i, t) for i, t in enumerate(texts)], "video_id string, idx int, ocr_text string")
    at = (make(spark, [(0, 40)]), cues(spark, [5, 15, 25, 35]), videos(spark, 40))
    good = coverage.scene_coverage(*at, slides(["a", "b", "c", "d"]), bins=4).first()
    assert good["passed"] and good["covered_bins"] == [0, 1, 2, 3]
    assert not coverage.scene_coverage(*at, slides(["a", "b", "c", " \n"]), bins=4).first()["passed"]


def brute_scene(speech, frames, dur, bins, carry):
    width, times = dur / bins, sorted(t for t in frames if 0 <= t <= dur)
    out = {}
    for b in range(bins):
        lo, hi = b * width, (b + 1) * width
        if any(s < hi and e > lo for s, e in speech):
            last = max((t for t in times if t <= hi), default=None)
            out[b] = last is not None and lo - last <= carry
    return out


def test_scene_coverage_equals_brute_force(spark):
    r = random.Random(5)
    for _ in range(6):
        dur, bins = r.choice([60.0, 97.3, 100.0]), r.choice([3, 7, 20])
        edge = [b * dur / bins for b in range(bins + 1)]
        speech = [(r.choice([*edge, r.uniform(-5, 110)]), r.choice([*edge, r.uniform(-5, 110)])) for _ in range(6)]
        frames = [r.choice([*edge, r.uniform(-5, 110)]) for _ in range(4)]
        out = scene(spark, speech, frames, dur, bins, 20.0)
        want = brute_scene(speech, frames, dur, bins, 20.0)
        assert (out["speech_bins"], out["covered_bins"]) == (sorted(want), sorted(b for b, ok in want.items() if ok))


def test_asof_ties_and_early_rows(spark):
    seg = spark.createDataFrame([("v", i, t) for i, t in enumerate([-1.0, 0.0, 5.0, 10.0, 99.0])] + [("w", 0, 1.0)], "video_id string, seq int, t double")
    sec = spark.createDataFrame([("v", 0, 0.0), ("v", 1, 5.0), ("v", 2, 5.0), ("v", 3, 50.0)], "video_id string, index int, win_start double")
    out = {(r["video_id"], r["seq"]): r["section"] for r in temporal.assign_to_sections(seg, sec).collect()}
    assert out == {("v", 0): 0, ("v", 1): 0, ("v", 2): 2, ("v", 3): 2, ("v", 4): 3, ("w", 0): None}
    near = temporal.asof_backward(seg, sec.withColumnRenamed("win_start", "at"), ["video_id"], "t", "at", ["index"], ["index"], tolerance=5.0)
    assert {(r["video_id"], r["seq"]): r["index"] for r in near.collect()} == {("v", 0): None, ("v", 1): 0, ("v", 2): 2, ("v", 3): 2, ("v", 4): None, ("w", 0): None}


def test_citation_band(spark):
    links = spark.createDataFrame([("v", 61), ("v", 62), ("none", 5)], "video_id string, sec int")
    cue = spark.createDataFrame([("v", 60)], "video_id string, sec int")
    assert [tuple(r) for r in temporal.uncited(links, cue).select("video_id", "sec").collect()] == [("v", 62)]


def test_batch_verdict_of_nothing(spark):
    empty = spark.createDataFrame([], "overall_pass boolean")
    assert tuple(coverage.batch_verdict(empty).first()) == (0, 0, True, 0)

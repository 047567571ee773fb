import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.functions import scalars as S
from chronotext.operators import kernels, sequences


def keep(spark, hashes):
    if not hashes:
        return []
    rows = [("v", i, h - (1 << 64) if h >= 1 << 63 else h) for i, h in enumerate(hashes)]
    frames = spark.createDataFrame(rows, "video_id string, idx int, phash long")
    out = sorted(r["idx"] for r in sequences.select_keyframes(frames).collect())
    assert out == sorted(r["idx"] for r in sequences.select_keyframes_grouped(frames).collect())
    return out


def far(seed, n):
    """n hashes of which any two are over 12 bits apart."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    assert all((a ^ b).bit_count() > 12 for i, a in enumerate(out) for b in out[:i])
    return out


@pytest.mark.parametrize("pattern", ["a", "abb", "aba", "abcc", "abbcbb", "abcabc", "aabbaabb", "abbbcccab"])
def test_keyframes(spark, pattern):
    hashes = [dict(zip("abc", far(5, 3)))[x] for x in pattern]
    assert keep(spark, hashes) == brute_keyframes(hashes)
    assert keep(spark, [(1 << 64) - 1, 0, 0, (1 << 63)]) == [0, 1]


def brute_keyframes(hashes, distance=12, persist=2):
    kept, current, cand = [0], hashes[0], None
    for i, h in enumerate(hashes[1:], 1):
        if (current ^ h).bit_count() <= distance:
            cand = None
            continue
        if cand and (cand[1] ^ h).bit_count() <= distance:
            cand = (*cand[:2], cand[2] + 1)
        else:
            cand = (i, h, 1)
        if cand[2] >= persist:
            kept.append(cand[0])
            current, cand = cand[1], None
    return kept


def test_keyframes_of_random_walks(spark):
    r = random.Random(3)
    rows, want = [], {}
    for v in range(30):
        h, seq = r.getrandbits(64), []
        for _ in range(r.randrange(1, 60)):
            h = r.choice([h, h ^ (1 << r.randrange(64)), r.getrandbits(64), h])
            seq.append(h)
        want[f"v{v}"] = brute_keyframes(seq)
        rows += [(f"v{v}", i * 3, x - (1 << 64) if x >= 1 << 63 else x) for i, x in enumerate(seq)]
    frames = spark.createDataFrame(rows, "video_id string, idx int, phash long")
    for select in (sequences.select_keyframes, sequences.select_keyframes_grouped):
        got = {v: [] for v in want}
        for row in select(frames).collect():
            got[row["video_id"]].append(row["idx"] // 3)
        assert {v: sorted(x) for v, x in got.items()} == want


def slides(spark, texts):
    df = spark.createDataFrame([("v", i, t) for i, t in enumerate(texts)], "video_id string, idx int, ocr_text string")
    return sorted(r["idx"] for r in sequences.dedupe_slides(df).collect())


def test_slide_build_ups(spark):
    steps = ["Title line", "Title line\nfirst point is here", "Title line\nfirst point is here\nsecond point is here", "Title line\nfirst point is here\nsecond point is here", "Something else entirely"]
    assert slides(spark, steps) == [0, 1, 2, 4]
    assert slides(spark, ["a b c", "a  b c", "x y z", "x y z", "x y z\nmore and more", "x y z\nmore and more", "last"]) == [0, 2, 4, 6]
    small = ["x" * 100 + "y" * i for i in range(0, 40, 5)]
    assert slides(spark, small) == [0, 4]  # growth adds up against the slide that was kept
    assert slides(spark, ["", "", "text"]) == [0, 2]


@pytest.mark.parametrize(
    ("prev", "cur", "kind"),
    [("", "", "duplicate"), ("", "a", "new"), ("a", " ", "new"), ("a b", "a  b\n", "duplicate"), ("one", "one\ntwo three", "incremental"), ("b\na", "a\nb\nlonger line", "incremental"), ("x" * 100, "x" * 101, "duplicate"), ("one", "two", "new"), (None, "z", "new")],
)
def test_transition(spark, prev, cur, kind):
    row = spark.createDataFrame([(prev, cur)], "p string, c string").select(S.slide_transition(F.col("p"), F.col("c"))).first()
    assert row[0] == kind


def test_repeats_and_anchors(spark):
    seg = spark.createDataFrame([("v", 0, 65.0, "foo bar"), ("v", 1, 65.0, "foo bar"), ("v", 2, 65.2, "baz qux"), ("v", 3, 70.0, None), ("v", 4, 71.0, None), ("v", 5, 72.0, "baz qux")], "video_id string, seq int, t double, text string")
    assert [r["seq"] for r in sequences.drop_repeats(seg).orderBy("seq").collect()] == [0, 2, 3, 5]
    assert [r["anchor"] for r in sequences.anchor_ids(seg).orderBy("seq").collect()][:3] == ["t000105", "t000105-2", "t000105-3"]


def hints(spark, slide_times, dur):
    rows = [("v", i, float(t), None, f"slide {t}") for i, t in enumerate(slide_times)]
    s = spark.createDataFrame(rows, "video_id string, idx int, t double, frame string, ocr_text string")
    v = spark.createDataFrame([("v", float(dur))], "video_id string, duration_sec double")
    return [(r["index"], r["t"], r["t_end"], r["title"]) for r in sequences.section_hints(s, v).orderBy("index").collect()]


def test_sections(spark):
    assert [x[:3] for x in hints(spark, [60, 0, 30], 90)] == [(0, 0, 30), (1, 30, 60), (2, 60, 90)]
    assert hints(spark, [12.5], 80) == [(0, 0, 12.5, "도입"), (1, 12.5, 80, "slide 12.5")]
    assert [x[2] for x in hints(spark, [0, 0, 40], 100)] == [0, 40, 100]
    assert [x[2] for x in hints(spark, [0, 125], 100)] == [125, 100]
    assert hints(spark, [], 50) == [(0, 0, 50, "전체")]


def test_pair_metrics(spark):
    pairs = spark.createDataFrame([("v", 0, 0.99, 0.50), ("v", 1, 0.95, 0.95)], "video_id string, i int, hist double, ssim double")
    assert sorted(r["idx"] for r in sequences.select_by_pair_metrics(pairs).collect()) == [0, 1]


def test_engine_and_frames(spark):
    f = spark.createDataFrame([("v", 0, "a"), ("v", 1, "b"), ("v", 2, "none"), ("w", 0, "none")], "video_id string, idx int, engine string")
    assert {r["video_id"]: r["ocr_engine"] for r in sequences.engine_used(f).collect()} == {"v": "b", "w": "none"}
    text = spark.createDataFrame([("v", 0, "too short"), ("v", 1, "long enough  text"), ("v", 2, "long enough\ntext"), ("v", 3, "another long text")], "video_id string, idx int, ocr_text string")
    assert [r["idx"] for r in sequences.slides_from_frames(text).orderBy("idx").collect()] == [1, 3]


def test_otsu(spark):
    h = [0] * 256
    h[10], h[200] = 50, 60
    run = lambda x: spark.createDataFrame([(x,)], "h array<int>").select(kernels.otsu_threshold(F.col("h"))).first()[0]
    assert run(h) == 10 and run([0] * 256) == 127
    with pytest.raises(Exception, match="256"):
        run([1, 2])


def test_ssim():
    r = np.random.default_rng(0)
    a = r.uniform(0, 255, (40, 40))
    b = a + r.normal(0, 30, a.shape)
    for window in (7, 3):
        pad = window // 2
        x, y = (np.pad(v, pad, mode="edge") for v in (a, b))
        local = []
        for i in range(40):
            for j in range(40):
                p, q = (v[i : i + window, j : j + window] for v in (x, y))
                cov = ((p - p.mean()) * (q - q.mean())).mean()
                local.append((2 * p.mean() * q.mean() + 6.5025) * (2 * cov + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (p.var() + q.var() + 58.5225)))
        assert kernels.ssim(a, b, window) == pytest.approx(np.mean(local))
    assert kernels.ssim(a, a) == pytest.approx(1.0)
    half = np.zeros((40, 40))
    half[:, :20] = 255
    assert kernels.ssim(half, half.T) < 0.9
    smooth = np.outer(np.linspace(0, 255, 40), np.ones(40))
    assert kernels.ssim(smooth, smooth + r.normal(0, 1, (40, 40))) > 0.9


def test_phash(spark):
    r = np.random.default_rng(2)
    gray = r.uniform(0, 255, (32, 32))
    low = kernels.low_frequencies(gray).ravel()
    in_jvm = spark.createDataFrame([(low.tolist(),)], "c array<double>").select(kernels.phash_of_coefficients(F.col("c"))).first()[0]
    pixels = spark.createDataFrame([(gray.ravel().tolist(),)], "p array<double>").select(kernels.phash_pixels("p")).first()[0]
    assert in_jvm == pixels == kernels.phash_of_gray(gray)
    noisy = kernels.phash_of_gray(gray + r.normal(0, 1, gray.shape))
    assert bin((noisy ^ in_jvm) & (2**64 - 1)).count("1") <= 12
    assert kernels.area_resize(np.ones((64, 48)), 32, 32) == pytest.approx(np.ones((32, 32)))


def pgm(gray):
    return b"P5\n# a comment\n%d %d\n255\n" % gray.shape[::-1] + gray.astype(np.uint8).tobytes()


def test_pnm_files():
    r = np.random.default_rng(5)
    gray, colour = r.integers(0, 256, (5, 9)), r.integers(0, 256, (4, 3, 3))
    assert (kernels.decode_image(pgm(gray)) == gray).all()
    assert (kernels.read_pnm(b"P6 3 4 255\n" + colour.astype(np.uint8).tobytes()) == colour).all()
    assert kernels.read_pnm(pgm(gray)[:-1]) is None and kernels.read_pnm(b"P5 0 5 255\n") is None and kernels.read_pnm(b"GIF") is None and kernels.decode_image(b"") is None
    assert (kernels.read_pnm(kernels.write_pgm(gray)) == gray).all()
    assert kernels.gray_of(np.full((2, 2, 3), 77)).tolist() == [[77, 77]] * 2


def test_frames_from_files_to_keyframes(spark):
    r = np.random.default_rng(6)
    scenes = [np.kron(r.integers(0, 256, (8, 8)), np.ones((8, 8), int)) for _ in range(4)]
    rows = [("v", i, pgm(np.clip(scenes[s] + r.integers(-2, 3, (64, 64)), 0, 255))) for i, s in enumerate([0, 0, 1, 1, 2, 0, 0, 3, 3])] + [("w", 0, pgm(scenes[0])), ("x", 0, b"P5 9 9 255\n"), ("x", 1, None)]
    files = spark.createDataFrame(rows, "video_id string, idx int, content binary")
    hashed = kernels.phash_files(files)
    assert hashed.columns == ["video_id", "idx", "phash"]
    got = {(x["video_id"], x["idx"]): x["phash"] for x in hashed.collect()}
    want = {(v, i): kernels.phash_of_image(kernels.read_pnm(c)) if v in "vw" else None for v, i, c in rows}
    assert got == want
    unsigned = [want["v", i] & (2**64 - 1) for i in range(9)]
    kept = sequences.dedupe_frames(hashed.where("phash is not null")).collect()
    assert sorted(x["idx"] for x in kept if x["video_id"] == "v") == brute_keyframes(unsigned) == [0, 2, 5, 7]
    assert all(x["phash_hex"] == f"{want[x['video_id'], x['idx']] & (2**64 - 1):016x}" for x in kept)
    assert {x["idx"]: x["hamming_prev"] for x in kept if x["video_id"] == "v"} == {0: None, 2: (unsigned[1] ^ unsigned[2]).bit_count(), 5: (unsigned[4] ^ unsigned[5]).bit_count(), 7: (unsigned[6] ^ unsigned[7]).bit_count()}


def test_frame_pairs(spark):
    r = np.random.default_rng(7)
    a = r.integers(0, 256, (20, 30))
    rows = [("v", 3, pgm(a)), ("v", 1, pgm(a)), ("v", 5, pgm(255 - a)), ("v", 8, b"P5 9 9 255\n"), ("v", 9, pgm(np.kron(a, np.ones((2, 2))))), ("w", 0, pgm(a))]
    pairs = kernels.frame_pairs(spark.createDataFrame(rows, "video_id string, idx int, content binary"))
    got = {x["i"]: (x["hist"], x["ssim"]) for x in pairs.collect()}
    assert set(got) == {0, 1, 2, 3} and got[0] == pytest.approx((1.0, 1.0)) and got[1][1] < 0 and got[2] == got[3] == (0.0, 0.0)
    assert sorted(x["idx"] for x in sequences.select_by_pair_metrics(pairs).collect()) == [0, 2, 3, 4]
    hist, like = kernels.pair_metrics_of(a, np.kron(a, np.ones((2, 2), int)))
    assert hist > 0.5 and like > 0.5 and kernels.pair_metrics_of(None, a) == (0.0, 0.0)


def test_files_prepared_for_ocr(spark):
    page = np.full((100, 200), 240)
    page[40:60, 60:140] = 10
    rows = [("a", pgm(page)), ("b", b"P5 text"), ("c", None)]
    out = {x["path"]: x for x in kernels.prepare_files_for_ocr(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (kernels.read_pnm(bytes(out["a"]["prepared"])) == kernels.prepare_for_ocr(page)).all() and out["a"]["warning"] is None
    assert bytes(out["b"]["prepared"]) == b"P5 text" and out["b"]["warning"] and out["c"]["prepared"] is None and out["c"]["warning"]


def test_cubic_resize():
    x = np.arange(12.0)[None, :] * 10 + 50
    large = kernels.cubic_resize(np.repeat(x, 3, 0), 6, 24)
    assert large.shape == (6, 24) and np.allclose(large[0, 4:-4], 50 + 10 * ((np.arange(24) + 0.5) / 2 - 0.5)[4:-4])
    assert kernels.cubic_resize(np.full((3, 4), 9.0), 7, 5) == pytest.approx(np.full((7, 5), 9.0))


def test_preparation_for_ocr():
    page = np.full((100, 200), 240.0)
    page[40:60, 60:140] = 10
    out = kernels.prepare_for_ocr(page)
    assert out.shape == (184, 372) and set(np.unique(out)) == {0, 255}
    assert out[92, 186] == 0 and out[5, 5] == 255
    h = np.zeros((1, 110))
    h[0, :50], h[0, 50:] = 10, 200
    assert kernels.otsu_of_gray(h) == 10 and kernels.otsu_of_gray(np.full((3, 3), 7)) == 127
    assert kernels.linear_resize(np.arange(4.0)[None, :], 2, 4).tolist() == [[0, 1, 2, 3]] * 2


def test_histograms(spark):
    px = spark.createDataFrame([("a", 3), ("a", 3), ("a", 255)], "k string, level int")
    h = kernels.gray_histogram(px, ["k"]).first()["histogram"]
    assert len(h) == 256 and h[3] == 2 and h[255] == 1 and sum(h) == 3
    assert kernels.histogram_correlation(np.zeros((4, 4, 3)), np.zeros((4, 4, 3))) == pytest.approx(1.0)

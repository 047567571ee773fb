"""Scalar functions as Column expressions; all stay inside generated code or the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronotext import model


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one space; the ends are stripped; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "^ | $", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def lines(text: Column) -> Column:
    """Lines without their separators; a separator at the end opens no further line."""
    some = F.nullif(text, F.lit(""))
    return F.coalesce(F.split(F.regexp_replace(some, r"\R\z", ""), r"\R", -1), F.array().cast("array<string>"))


def round_ms(t: Column) -> Column:
    return F.round(t, 3)


def format_timestamp(seconds: Column) -> Column:
    """Seconds to HH:MM:SS: half-even rounding, negative to zero, more than two digits of hours where needed."""
    s = F.greatest(F.rint(seconds), F.lit(0.0)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat_ws(":", F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), two(F.floor(s % 3600 / 60)), two(s % 60))


def anchor_base(seconds: Column) -> Column:
    return F.concat(F.lit("t"), F.replace(format_timestamp(seconds), F.lit(":"), F.lit("")))


def anchor_seconds(anchor: Column) -> Column:
    """Whole seconds of a `tHHMMSS` anchor, with or without `-n`."""
    digit = lambda at: F.substring(anchor, at, 2).cast("int")
    return digit(2) * 3600 + digit(4) * 60 + digit(6)


def slugify(title: Column, fallback: str = "video") -> Column:
    """A folder name from a title: word characters, hyphens and Hangul stay; at most 80 characters."""
    t = F.regexp_replace(strip(F.coalesce(title, F.lit(""))), r"(?U)[^\w\-가-힣]+", "-")
    t = F.regexp_replace(F.regexp_replace(t, "^-+|-+$", ""), "-{2,}", "-")
    return F.substring(F.when(t == "", F.lit(fallback)).otherwise(t), 1, 80)


def output_dir(root: str, title: Column, fallback: str = "video") -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), slugify(title, fallback))


def frame_link(path: Column, folder: Column) -> Column:
    """A frame's path below its folder, with forward slashes."""
    p, d = F.replace(path, F.lit("\\"), F.lit("/")), F.concat(F.regexp_replace(F.replace(folder, F.lit("\\"), F.lit("/")), "/+$", ""), F.lit("/"))
    return F.when(F.startswith(p, d), F.substr(p, F.length(d) + 1)).otherwise(p)


def first_line(text: Column, fallback: Column) -> Column:
    """The first line that isn't blank, stripped, at most 80 characters."""
    full = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    return F.coalesce(F.substring(F.try_element_at(full, F.lit(1)), 1, 80), fallback)


def safe_title(text: Column) -> Column:
    return F.translate(collapse(text), "[]|", "()/")


def is_slide(text: Column, least: int = model.SLIDE_MIN_CHARS) -> Column:
    return F.length(F.replace(collapse(text), F.lit(" "), F.lit(""))) >= least


def slide_lines(text: Column) -> Column:
    return F.filter(F.transform(lines(text), collapse), lambda x: x != "")


def slide_transition(prev: Column, cur: Column, min_growth: float = model.MIN_GROWTH) -> Column:
    """`duplicate`, `incremental` or `new`: how a slide's text follows on another."""
    return transition_of(slide_form(prev), slide_form(cur), min_growth)


def slide_form(text: Column) -> Column:
    """What transitions are judged by: a slide's collapsed text and its lines."""
    return F.struct(collapse(text).alias("text"), slide_lines(text).alias("lines"))


def transition_of(prev: Column, cur: Column, min_growth: float = model.MIN_GROWTH) -> Column:
    """`slide_transition` of two slide forms."""
    p, c, before = prev["text"], cur["text"], prev["lines"]
    superset = (F.size(before) > 0) & (F.size(F.array_except(before, cur["lines"])) == 0)
    growth = (F.length(c) - F.length(p)) / F.greatest(F.length(c), F.lit(1))
    return (
        F.when((c == "") & (p == ""), "duplicate")
        .when((c == "") | (p == ""), "new")
        .when(c == p, "duplicate")
        .when((superset | F.startswith(c, p)) & (growth >= min_growth), "incremental")
        .when(superset | F.startswith(c, p), "duplicate")
        .otherwise("new")
    )


def hash_to_long(text: Column) -> Column:
    """A perceptual hash written as decimal, hexadecimal, 0x or 0b digits, as the 64 bits of a BIGINT. Other text, or more than
    64 bits, is an error; null stays null."""
    t = F.replace(F.lower(strip(text)), F.lit("_"), F.lit(""))
    wrong = F.raise_error(F.concat(F.lit("not a hash of at most 64 bits: "), F.coalesce(text, F.lit("null")))).cast("long")

    def signed(x: Column, base: int, digits: str, most: int) -> Column:
        short = F.regexp_replace(x, "^0+(?=.)", "")
        return F.when(short.rlike(f"^[{digits}]{{1,{most}}}$"), F.conv(short, base, -10).cast("long")).otherwise(wrong)

    return (
        F.when(t.isNull(), F.lit(None).cast("long"))
        .when(t == "", F.lit(0).cast("long"))
        .when(F.startswith(t, F.lit("0x")), signed(F.substr(t, F.lit(3)), 16, "0-9a-f", 16))
        .when(F.startswith(t, F.lit("0b")), signed(F.substr(t, F.lit(3)), 2, "01", 64))
        .when(t.rlike("[a-f]") | (F.length(t) > 10), signed(t, 16, "0-9a-f", 16))
        .otherwise(signed(t, 10, "0-9", 10))
    )


def hash_hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def is_same_phash(a: Column, b: Column, distance: int = model.PHASH_DISTANCE) -> Column:
    return hamming(a, b) <= distance


def is_same_slide(hist: Column, ssim: Column, hist_same: float = model.HIST_SAME, ssim_same: float = model.SSIM_SAME) -> Column:
    return (hist >= hist_same) & (ssim >= ssim_same)


def bin_of(t: Column, duration: Column, bins: int = model.SCENE_BINS) -> Column:
    place = F.least(F.greatest((t / F.nullif(duration, F.lit(0.0)) * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    return F.when(duration > 0, place).otherwise(0)


def warns_long_video(duration: Column, limit: float = model.LONG_VIDEO_SEC) -> Column:
    return duration > limit


def roi_box(width: Column, height: Column, margin: float = 0.035, keep: float = 0.80) -> Column:
    """Crop box (left, top, right, bottom) inside a frame; sizes must be positive."""
    m = max(0.0, min(margin, (1.0 - keep) / 2.0))
    left, top = F.rint(width * F.lit(m)).cast("int"), F.rint(height * F.lit(m)).cast("int")
    right, bottom = width - left, height - top
    thin = (right <= left) | (bottom <= top)
    pick = lambda full, cut: F.when(thin, full).otherwise(cut).cast("int")
    box = F.struct(pick(F.lit(0), left).alias("left"), pick(F.lit(0), top).alias("top"), pick(width, right).alias("right"), pick(height, bottom).alias("bottom"))
    return F.when((width > 0) & (height > 0), box).otherwise(F.raise_error(F.lit("a region needs a positive width and height")))


def upscaled_size(width: Column, height: Column, scale: float = 2.0, most: int = 3200) -> Column:
    """(width, height) scaled up, the larger side at most `most`, never scaled down."""
    factor, largest = max(scale, 1.0), F.greatest(width, height)
    f = F.when(largest * F.lit(factor) > most, F.greatest(F.lit(float(most)) / largest, F.lit(1.0))).otherwise(factor)
    size = F.struct(*[F.greatest(F.lit(1), F.rint(x * f).cast("int")).alias(n) for x, n in ((width, "width"), (height, "height"))])
    return F.when((width > 0) & (height > 0), size).otherwise(F.raise_error(F.lit("a size needs a positive width and height")))


def binarize_luma(value: Column, threshold: Column) -> Column:
    return F.when(value.cast("int") > threshold.cast("int"), 255).otherwise(0)


VERSION_PART = "decimal(38,0)"


def version_parts(version: Column) -> Column:
    """Leading digits of the dotted parts, up to the first part (after one with digits) that has none. Parts are decimals of
    38 digits; a longer one counts as the largest of these."""
    parts = F.transform(F.split(F.translate(version, "-+", ".."), r"\."), lambda x: F.regexp_extract(x, "^[0-9]*", 0))
    number = lambda x: F.coalesce(x.try_cast(VERSION_PART), F.lit("9" * 38).cast(VERSION_PART))
    step = lambda acc, x: (
        F.when(acc["done"], acc)
        .when(x != "", F.struct(F.concat(acc["parts"], F.array(number(x))).alias("parts"), F.lit(False).alias("done")))
        .otherwise(F.struct(acc["parts"].alias("parts"), (F.size(acc["parts"]) > 0).alias("done")))
    )
    start = F.struct(F.array().cast(f"array<{VERSION_PART}>").alias("parts"), F.lit(False).alias("done"))
    return F.aggregate(parts, start, step, lambda acc: acc["parts"])


def compare_versions(left: Column, right: Column) -> Column:
    """-1, 0 or 1; the shorter version counts as filled up with zeros."""
    a, b = version_parts(left), version_parts(right)
    width = F.greatest(F.size(a), F.size(b))
    fill = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast(VERSION_PART), width - F.size(x)))
    return F.when(fill(a) > fill(b), 1).when(fill(a) < fill(b), -1).otherwise(0)


def satisfies_version(version: Column, specifier: str) -> Column:
    """All comma-separated clauses hold; a clause without a known operator is passed over."""
    # Signs of the comparison that a clause admits, by its operator.
    admits = {"<": [-1], "<=": [-1, 0], "==": [0], ">=": [0, 1], ">": [1]}
    clauses = re.findall(r"(?:^|,)\s*([<>]=?|==)\s*([^,]*?)\s*(?=,|$)", specifier)
    return reduce(Column.__and__, (compare_versions(version, F.lit(bound)).isin(*admits[sign]) for sign, bound in clauses), F.lit(True))


def same_release(a: Column, b: Column) -> Column:
    """Versions agree as far as the shorter one goes; where one has no digits, their texts must be equal."""
    x, y = version_parts(a), version_parts(b)
    width = F.least(F.size(x), F.size(y))
    return F.when(width == 0, a == b).otherwise(F.slice(x, F.lit(1), F.greatest(width, F.lit(1))) == F.slice(y, F.lit(1), F.greatest(width, F.lit(1))))


def ocr_language(lang: Column, aliases: dict[str, str] | None = None) -> Column:
    """The OCR model's language of an alias, written with - or _, in any case; null or empty is Korean, an unknown one an
    error."""
    #: Language aliases of the OCR models.
    aliases = aliases or {
        "ko": "korean", "kor": "korean", "korean": "korean", "ko_kr": "korean", "kor_eng": "korean", "ko_en": "korean", "ko/en": "korean", "korean_english": "korean",
        "en": "en", "eng": "en", "english": "en",
    }
    found = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[F.translate(F.lower(strip(F.coalesce(F.nullif(lang, F.lit("")), F.lit("korean")))), "-", "_")]
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no OCR model for language "), F.coalesce(lang, F.lit("null")))))


#: Phrases of a check's detail that mean an incompatible version.
INCOMPATIBLE_PHRASES = ("does not satisfy", "provider check failed", "version could not be checked", "version could not be determined")


def status_from_detail(detail: Column, markers: tuple[str, ...] = INCOMPATIBLE_PHRASES) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(detail, F.lit(m))
    return F.when(hit, "incompatible").otherwise("missing")


def overall_status(exit_code: Column) -> Column:
    return F.when(exit_code == 0, "ready").when(exit_code == 2, "user-action").otherwise("internal-unfixable")


#: Patterns of ids in video URLs, bare ids, and times in names of frames.
ID_IN_URL = r"(?:v=|/shorts/|youtu\.be/|/embed/)([0-9A-Za-z_-]{11})"
BARE_ID = r"^([0-9A-Za-z_-]{11})$"
FRAME_TIME = r"(?i)(?:^|[_-])([0-9]+(?:\.[0-9]+)?)(sec|s)?$"


def video_id_of(url: Column) -> Column:
    """The 11-character id in a video URL, or of a bare id; else null."""
    u = strip(url)
    inside = F.regexp_extract(u, ID_IN_URL, 1)
    bare = F.regexp_extract(u, BARE_ID, 1)
    return F.coalesce(F.nullif(inside, F.lit("")), F.nullif(bare, F.lit("")))


def frame_time(path: Column, fps: float = model.SAMPLE_FPS) -> Column:
    """(seconds, source) from a frame's file name: a whole number counts samples, one with a point or `s`/`sec` is seconds."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    token, unit = F.regexp_extract(stem, FRAME_TIME, 1), F.regexp_extract(stem, FRAME_TIME, 2)
    value = F.nullif(token, F.lit("")).try_cast("double")
    seconds = (unit != "") | F.contains(token, F.lit("."))
    pts = (value / fps, "filename_pts_over_fps") if fps > 0 else (value, "filename_pts_no_fps")
    out = lambda t, source: F.struct(t.cast("double").alias("t"), F.lit(source).alias("source"))
    return F.when(token == "", out(F.lit(0.0), "fallback_unparseable")).when(seconds, out(value, "filename_seconds")).otherwise(out(*pts))

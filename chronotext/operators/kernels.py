"""Array and image kernels: perceptual hash, SSIM, Otsu, histograms.

Pixels are arrays; whole-array arithmetic runs vectorised in pandas UDFs, small fixed folds run in the JVM. Image files need an
image library, which is loaded on the executors only when a file is to be decoded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


def phash_of_coefficients(coefficients: Column) -> Column:
    """64 low-frequency coefficients to a 64-bit hash: bit set where one exceeds the median of all but the first."""
    c = F.transform(coefficients, lambda x: x.cast("double"))
    middle = F.get(F.array_sort(F.slice(c, 2, 63)), F.lit(31))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    # The median rides along in the state: a lambda that names it would sort the array anew for every bit.
    def step(acc: Column, x: Column) -> Column:
        bit = F.when(x > acc["middle"], one).otherwise(zero)
        return F.struct(F.shiftleft(acc["bits"], 1).bitwiseOR(bit).alias("bits"), acc["middle"].alias("middle"))

    return F.aggregate(c, F.struct(zero.alias("bits"), middle.alias("middle")), step, lambda acc: acc["bits"])


def low_frequencies(gray: np.ndarray, keep: int = 8) -> np.ndarray:
    """The low `keep` x `keep` block of the orthonormal DCT-II of a square image."""
    n = gray.shape[0]
    angle = np.outer(np.arange(keep), 2 * np.arange(n) + 1) * (np.pi / (2 * n))
    scale = np.full((keep, 1), np.sqrt(2 / n))
    scale[0] = np.sqrt(1 / n)
    d = np.cos(angle) * scale
    return d @ gray.astype(np.float64) @ d.T


def phash_of_gray(gray: np.ndarray) -> int:
    """Signed 64-bit perceptual hash of a 32 x 32 image."""
    flat = low_frequencies(gray).ravel()
    on = flat > np.median(flat[1:])
    return int(np.packbits(on).view(">i8")[0])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the covered area, for shrinking; each axis is a weighted sum."""

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        lo, hi = edges[:-1, None], edges[1:, None]
        cover = np.clip(np.minimum(hi, np.arange(1, old + 1)) - np.maximum(lo, np.arange(old)), 0, None)
        return cover / cover.sum(1, keepdims=True)

    return weights(image.shape[0], height) @ image.astype(np.float64) @ weights(image.shape[1], width).T


def phash_of_image(gray: np.ndarray) -> int:
    """Hash of the upper 60 % of a frame, shrunk to 32 x 32."""
    rows = max(1, round(gray.shape[0] * 0.60))
    return phash_of_gray(np.rint(area_resize(gray[:rows], 32, 32)))


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity over windows of `window` pixels, edges repeated; -1 to 1."""
    pad = window // 2

    def mean(x: np.ndarray) -> np.ndarray:
        """Box means from running sums, along one axis and then the other: a few reads a pixel at any window."""
        x = np.pad(x, pad, mode="edge")
        for axis in (0, 1):
            x = np.insert(np.cumsum(x, axis=axis), 0, 0.0, axis=axis)
            n = x.shape[axis]
            x = np.take(x, np.arange(window, n), axis) - np.take(x, np.arange(n - window), axis)
        return x / window**2

    a, b = a.astype(np.float64), b.astype(np.float64)
    ma, mb = mean(a), mean(b)
    va, vb, cov = mean(a * a) - ma**2, mean(b * b) - mb**2, mean(a * b) - ma * mb
    #: The usual stabilising constants for 8-bit images.
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    score = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))
    return float(np.clip(score.mean(), -1.0, 1.0))


def histogram_correlation(a: np.ndarray, b: np.ndarray, bins: int = 8) -> float:
    """Correlation of two colour images' bins x bins x bins histograms."""
    one = lambda x: np.histogramdd(x.reshape(-1, 3), bins=(bins,) * 3, range=((0, 256),) * 3)[0].ravel()
    x, y = one(a) - one(a).mean(), one(b) - one(b).mean()
    size = np.sqrt((x**2).sum() * (y**2).sum())
    return float((x * y).sum() / size) if size > 0 else 1.0


@F.pandas_udf(LongType())
def phash_pixels(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Hash of 1024 gray values (32 x 32, row by row)."""
    for s in rows:
        yield s.map(lambda v: None if v is None else phash_of_gray(np.asarray(v, float).reshape(32, 32))).astype("Int64")


@F.pandas_udf(DoubleType())
def ssim_pixels(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.Series:
    """SSIM of two gray images given as arrays and their width."""
    return pd.Series([None if x is None or y is None else ssim(np.asarray(x, float).reshape(-1, w), np.asarray(y, float).reshape(-1, w)) for x, y, w in zip(a, b, width, strict=True)], dtype="float64")


#: Weights of red, green and blue in a gray level.
LUMA = (0.299, 0.587, 0.114)
Decoder = Callable[[bytes], "np.ndarray | None"]


def gray_of(image: np.ndarray) -> np.ndarray:
    """Whole gray levels of an image of height x width, or height x width x 3 with red first."""
    return image if image.ndim == 2 else np.rint(image[..., :3].astype(np.float64) @ np.array(LUMA))


def read_pnm(content: bytes) -> np.ndarray | None:
    """Pixels of a binary PGM or PPM file with levels up to 255; null for other bytes. Needs no image library."""
    head = re.match(rb"P([56])(?:\s+#[^\n]*)*\s+(\d{1,6})\s+(\d{1,6})\s+(\d{1,3})\s", content or b"")
    if not head:
        return None
    depth, width, height = (3 if head[1] == b"6" else 1), int(head[2]), int(head[3])
    data = np.frombuffer(content, np.uint8, offset=head.end())
    if width * height == 0 or len(data) < width * height * depth:
        return None
    data = data[: width * height * depth]
    return data.reshape(height, width, 3) if depth == 3 else data.reshape(height, width)


def decode_image(content: bytes) -> np.ndarray | None:
    """Pixels of an image file's bytes, turned as its metadata say; null where they can't be read. Binary PGM and PPM need
    nothing else, other formats one of two image libraries on the executors: without either they are an error."""
    if not content:
        return None
    if content[:2] in (b"P5", b"P6"):
        return read_pnm(content)
    try:
        import cv2
    except ImportError:
        import io

        from PIL import Image, ImageOps, UnidentifiedImageError

        try:
            return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("RGB"))
        except (UnidentifiedImageError, OSError):
            return None
    image = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_COLOR)
    return None if image is None else image[..., ::-1]


def phash_files(files: DataFrame, decode: Decoder = decode_image) -> DataFrame:
    """The columns of image files (..., content), as `binaryFile` reads them, with phash in place of the content; null where
    a file can't be read."""
    keep = [c for c in files.columns if c not in ("content", "phash")]
    schema = files.select(*keep).schema.add("phash", "long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            images = (decode(c) if c is not None else None for c in batch["content"].to_pylist())
            found = [None if image is None else phash_of_image(gray_of(image)) for image in images]
            yield pa.record_batch([*[batch[c] for c in keep], pa.array(found, pa.int64())], [*keep, "phash"])

    return files.select(*keep, "content").mapInArrow(run, schema)


def pair_metrics_of(a: np.ndarray | None, b: np.ndarray | None) -> tuple[float, float]:
    """(histogram correlation, SSIM) of two images; the second is brought to the first's size. (0, 0) without either."""
    if a is None or b is None:
        return 0.0, 0.0
    rgb = lambda x: np.repeat(x[..., None], 3, axis=2) if x.ndim == 2 else x[..., :3]
    a, b = rgb(a), rgb(b)
    if a.shape != b.shape:
        b = np.stack([np.rint(linear_resize(b[..., c], *a.shape[:2])) for c in range(3)], axis=2)
    return histogram_correlation(a, b), ssim(gray_of(a), gray_of(b))


def frame_pairs(frames: DataFrame, decode: Decoder = decode_image) -> DataFrame:
    """(video_id, i, hist, ssim) of each frame (video_id, idx, content) and the next one, i counted from 0 in the order of
    idx. What `select_by_pair_metrics` takes. A frame that can't be read is like no other: (0, 0)."""
    w = Window.partitionBy("video_id").orderBy("idx")
    pairs = frames.select("video_id", (F.row_number().over(w) - 1).alias("i"), F.col("content").alias("a"), F.lead("content").over(w).alias("b"), F.lead("idx").over(w).alias("next"))
    pairs = pairs.where("next is not null").select("video_id", "i", "a", "b")
    schema = pairs.select("video_id", "i").schema.add("hist", "double").add("ssim", "double")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            read = lambda c: None if c is None else decode(c)
            found = [pair_metrics_of(read(a), read(b)) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
            cols = [pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]
            yield pa.record_batch([batch["video_id"], batch["i"], *cols], ["video_id", "i", "hist", "ssim"])

    return pairs.mapInArrow(run, schema)


def otsu_threshold(histogram: Column) -> Column:
    """Otsu's level of an array of 256 counts: the first that separates the classes best; 127 without any count."""
    h = F.transform(histogram, lambda x: x.cast("double"))
    total = F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(h, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)

    # The sums ride along in the state: a lambda that names them would take them anew at every level.
    def state(level, count, weight, best, at, total, weighted) -> Column:
        return F.struct(level.alias("level"), count.alias("count"), weight.alias("weight"), best.alias("best"), at.alias("at"), total.alias("total"), weighted.alias("weighted"))

    start = state(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(127), total, weighted)

    def step(acc: Column, x: Column) -> Column:
        n, w = acc["count"] + x, acc["weight"] + acc["level"] * x
        rest = acc["total"] - n
        apart = F.try_divide(w, n) - F.try_divide(acc["weighted"] - w, rest)
        score = F.when((n > 0) & (rest > 0), n * rest * apart * apart)
        better = F.coalesce(score > acc["best"], F.lit(False))
        return state(acc["level"] + 1, n, w, F.when(better, score).otherwise(acc["best"]), F.when(better, acc["level"]).otherwise(acc["at"]), acc["total"], acc["weighted"])

    level = F.when(total > 0, F.aggregate(h, start, step, lambda acc: acc["at"])).otherwise(127)
    return F.when(F.size(histogram) == 256, level).otherwise(F.raise_error(F.lit("a gray histogram has 256 counts")))


def gray_histogram(pixels: DataFrame, key: list[str]) -> DataFrame:
    """(key..., histogram) with 256 counts, of pixels (key..., level)."""
    counts = pixels.groupBy(*key, "level").count()
    m = counts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("level", "count"))).alias("_m"))
    levels = F.sequence(F.lit(0), F.lit(255))
    return m.select(*key, F.transform(levels, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("bigint"))).alias("histogram"))


def otsu_by_window(counts: DataFrame, key: list[str]) -> DataFrame:
    """(key..., threshold) of sparse counts (key..., level, n), as running sums; for histograms that come as rows."""
    w = Window.partitionBy(*key).orderBy("level")
    run, all_ = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    n, s = F.sum("n").over(run), F.sum(F.col("level") * F.col("n")).over(run)
    total, weight = F.sum("n").over(all_), F.sum(F.col("level") * F.col("n")).over(all_)
    rows = counts.select(*key, "level", n.alias("_n"), s.alias("_s"), total.alias("_t"), weight.alias("_w"))
    rest = F.col("_t") - F.col("_n")
    apart = F.try_divide(F.col("_s"), F.col("_n")) - F.try_divide(F.col("_w") - F.col("_s"), rest)
    scored = rows.select(*key, "level", F.when((F.col("_n") > 0) & (rest > 0), F.col("_n") * rest * apart * apart).alias("_v"))
    best = F.max(F.struct(F.col("_v"), (-F.col("level")).alias("l")))
    return scored.groupBy(*key).agg(best.alias("_b")).select(*key, F.when(F.col("_b._v").isNull(), 127).otherwise(-F.col("_b.l")).cast("int").alias("threshold"))


def otsu_of_gray(gray: np.ndarray) -> int:
    """Otsu's level of an image: the first that separates the classes best; 127 for an image without pixels."""
    n = np.bincount(gray.astype(np.int64).ravel(), minlength=256).astype(np.float64)
    below, weight = np.cumsum(n), np.cumsum(n * np.arange(256))
    rest = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = weight / below - (weight[-1] - weight) / rest
        score = np.where((below > 0) & (rest > 0), below * rest * apart**2, -1.0)
    return int(score.argmax()) if score.max() >= 0 else 127


def linear_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Linear interpolation between pixel centres, for enlarging."""

    def weights(old: int, new: int) -> np.ndarray:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.minimum(at.astype(int), max(old - 2, 0))
        w = np.zeros((new, old))
        w[np.arange(new), low] = 1 - (at - low)
        w[np.arange(new), np.minimum(low + 1, old - 1)] += at - low
        return w

    return weights(image.shape[0], height) @ image.astype(np.float64) @ weights(image.shape[1], width).T


def cubic_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Cubic convolution (a = -0.5) between pixel centres, for enlarging; levels stay within 0 and 255."""

    def weights(old: int, new: int) -> np.ndarray:
        at = (np.arange(new) + 0.5) * old / new - 0.5
        near = np.floor(at).astype(int)[:, None] + np.arange(-1, 3)
        d = np.abs(at[:, None] - near)
        w = np.where(d <= 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))
        w *= (near >= 0) & (near < old)
        out = np.zeros((new, old))
        np.add.at(out, (np.arange(new)[:, None], np.clip(near, 0, old - 1)), w)
        return out / out.sum(1, keepdims=True)

    return np.clip(weights(image.shape[0], height) @ image.astype(np.float64) @ weights(image.shape[1], width).T, 0, 255)


def prepare_for_ocr(gray: np.ndarray, margin: float = 0.035, keep: float = 0.80, scale: float = 2.0, most: int = 3200) -> np.ndarray:
    """A frame's inner region, enlarged and made black and white by its own Otsu level."""
    height, width = gray.shape
    m = max(0.0, min(margin, (1.0 - keep) / 2.0))
    top, left = round(height * m), round(width * m)
    region = gray[top : height - top, left : width - left] if height > 2 * top and width > 2 * left else gray
    h, w = region.shape
    factor = max(scale, 1.0)
    if max(h, w) * factor > most:
        factor = max(most / max(h, w), 1.0)
    large = np.rint(cubic_resize(region, max(1, round(h * factor)), max(1, round(w * factor))))
    return np.where(large > otsu_of_gray(large), 255, 0).astype(np.uint8)


def write_pgm(gray: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % gray.shape[::-1] + gray.astype(np.uint8).tobytes()


def prepare_files_for_ocr(files: DataFrame, decode: Decoder = decode_image) -> DataFrame:
    """The columns of image files (..., content) with `prepared`, the black-and-white image as a PGM file, and `warning`:
    where a file can't be prepared, `prepared` is its own content and the warning says why."""
    keep = [c for c in files.columns if c not in ("prepared", "warning")]
    schema = files.select(*keep).schema.add("prepared", "binary").add("warning", "string")

    def one(content: bytes | None) -> tuple[bytes | None, str | None]:
        try:
            image = decode(content) if content else None
            if image is None:
                return content, "the image can't be read"
            return write_pgm(prepare_for_ocr(gray_of(image))), None
        except Exception as e:  # noqa: BLE001  whatever fails, the engine gets the original and the row says so
            return content, f"{type(e).__name__}: {e}"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [one(c) for c in batch["content"].to_pylist()]
            cols = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())]
            yield pa.record_batch([*[batch[c] for c in keep], *cols], [*keep, "prepared", "warning"])

    return files.select(*keep).mapInArrow(run, schema)

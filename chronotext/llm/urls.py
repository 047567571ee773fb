"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The model learns from a small labelled table of URLs (`labelled_urls`, or one that is given); host and path n-grams are features
of their own.

Defined cases: a null URL, or one without `://`, has an empty host and path; no rule fits it, and the model, which then has no
features but its bias, decides. Repeated rows are judged one by one. A labelled table without rows is an error.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import lower_ascii, map_slices

#: Rules as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words of hosts to block, of harmless ones, words that either kind has, and syllables of made-up names.
BLOCKED_WORDS = (
    "casino poker slots jackpot roulette bets betting gambling lottery sweepstakes pills pharmacy viagra steroids dietpills porn xxx adult webcams escorts hookup "
    "adserver adclick tracker trackpixel popunder banners spam backlinks linkfarm phishing malware warez keygen cracked torrents clickbait freemoney doubler payday"
).split()
HARMLESS_WORDS = (
    "library museum garden school university hospital weather recipes bakery orchestra theatre cinema painting poetry novels history geology botany physics chemistry biology astronomy "
    "mathematics medicine council parliament court embassy harbour railway airport timetable bridge castle village mountain river forest beach island farming fishing sailing cycling "
    "hiking football tennis chess choir violin piano carpenter weaving pottery furniture kitchen coffee bread cheese wine letters archive newspaper magazine radio teacher student "
    "lecture guide manual software compiler database maps travel hotel camping insurance statistics language dictionary grammar philosophy zoo"
).split()
COMMON_WORDS = "best online new my the top city world home club daily great".split()
SYLLABLES = "ba dor el fin gra hol ith jun kel lo mar nev ol pri qua ren sto thu ul ver wen xan yor zim ble tion th ng qu".split()
HOST_SHAPES = ("{a}.test", "www.{a}{b}.test", "{c}-{a}.test", "m.{a}-{c}.test", "blog.{b}{a}.test", "{c}{a}.test")
PATH_SHAPES = ("/", "/en/{n}", "/fr/{n}.html", "/{a}/{n}", "/de/{n}?page=2", "/es/{b}", "")
MADE_UP_HOSTS = 240


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table (url, 1 is block): each word in hosts and paths of every shape, in turn, both kinds alike, and
    hosts of made-up names, which are harmless."""
    out = []
    for words, label in ((BLOCKED_WORDS, 1), (HARMLESS_WORDS, 0)):
        for i, word in enumerate(words):
            for j, host in enumerate(HOST_SHAPES):
                other, common = words[(i * 7 + j * 3 + 1) % len(words)], COMMON_WORDS[(i + 5 * j) % len(COMMON_WORDS)]
                shape = host + PATH_SHAPES[(i + j) % len(PATH_SHAPES)]
                out.append((f"http{'s' * (i % 2)}://" + shape.format(a=word, b=other, c=common, n=(i * 37 + j * 11) % 1000), label))
    for i in range(MADE_UP_HOSTS):
        name = "".join(SYLLABLES[(i * k + i // k) % len(SYLLABLES)] for k in (1, 5, 11, 17)[: 2 + i % 3])
        host = ("{}.test", "www.{}.test", "m.{}.test", "blog.{}.test")[i % 4].format(name)
        out.append((f"http://{host}" + PATH_SHAPES[i % len(PATH_SHAPES)].format(a="page", b="item", n=i * 7 % 1000), 0))
    return out


HASH_BITS = 15
SIZES = (3, 4, 5)
PATH_VALUE = 0.3


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def fitting_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none does."""
    rules = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[0] + r[1]), r))
    name = verdict = None
    for h, p, v in rules:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the hashed n-grams of host and path, and their values: the host says more than the path."""
    numbers, values = [], []
    for kind, text, value in (("h", f"^{host}$", 1.0), ("p", f"^{path}$", PATH_VALUE)):
        grams = {f"{kind}{text[i : i + n]}" for n in SIZES for i in range(len(text) - n + 1)} if len(text) > 2 else set()
        numbers.append(np.unique(np.fromiter((zlib.crc32(g.encode("utf-8", "replace")) & ((1 << HASH_BITS) - 1) for g in grams), np.int64, len(grams))))
        values.append(np.full(len(numbers[-1]), value))
    return np.concatenate(numbers), np.concatenate(values)


def split_url(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    host = rest[: min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))]
    path = rest[len(host) :]
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return fold, path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]


def fit(labelled: list[tuple[str, int]], steps: int = 1500, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression by gradient descent; label 1 is block."""
    if not labelled:
        raise ValueError("a labelled table needs rows")
    rows = [features(*split_url(url)) for url, _ in labelled]
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feature, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    y = np.array([label for _, label in labelled], float)
    w, b, size = np.zeros(1 << HASH_BITS), 0.0, len(rows)
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(np.bincount(row, value * w[feature], size) + b))) - y) / size
        w -= 0.2 * (np.bincount(feature, value * g[row], len(w)) + l2 * w)
        b -= 0.2 * float(g.sum())
    return w, b


def judge(pages: DataFrame, labelled: list[tuple[str, int]] | None = None, rules=None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every url; score is the model's chance of block."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled_urls() if labelled is None else labelled))
    rows = pages.select("page_id", F.col("url").alias("_url"))
    host, path = parts(F.col("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    schema = rows.select("*").schema.add("score", "double")

    def make():
        w, b = shared.value

        def chance(host: str, path: str) -> float:
            f, v = features(host, path)
            return float(1 / (1 + np.exp(-(w[f] @ v + b))))

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            score = [chance(h, p) for h, p in zip(piece["host"].to_pylist(), piece["path"].to_pylist(), strict=True)]
            return pa.record_batch([*piece.columns, pa.array(score, pa.float64())], [*piece.schema.names, "score"])

        return work

    out = map_slices(rows, "path", make, schema)
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")

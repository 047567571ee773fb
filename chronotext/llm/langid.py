"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

Features are hashed byte n-grams (1 to 3 bytes of the lower-cased letters, other ASCII folded to one space),
as relative frequencies, so a text's score is the mean of per-position weights and needs no feature vector.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text when no labelled
row is there to learn from. A language outside FAMILIES is a family of its own. Repeated rows are judged one by one;
extra columns are ignored. Whole texts are read, at any length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm.common import map_slices, table

#: Language codes by genealogical family.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "pl": "slavic", "cs": "slavic", "ru": "slavic", "uk": "slavic",
}
UND = "und"
HASH_BITS = 12
#: Up to so many languages the bounds of the sample, a row each, are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
WIDTH = 256 + 2 * (1 << HASH_BITS)
_LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numbers such as ½ or Ⅷ, which the pattern alone lets through, are none."""
    return any(m[0].isalpha() for m in _LETTER_OR_NUMBER.finditer(text))


def _positions(text: str) -> np.ndarray:
    """Feature numbers of all n-grams of a text."""
    folded = b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    a = np.frombuffer(folded, np.uint8).astype(np.uint32)
    mask, shift = np.uint32(0xFFFFFFFF), np.uint32(32 - HASH_BITS)
    two = (a[:-1] << np.uint32(8)) | a[1:]
    three = (two[:-1] << np.uint32(8)) | a[2:]
    h2 = ((two * np.uint32(2654435761)) & mask) >> shift
    h3 = ((three * np.uint32(2246822519)) & mask) >> shift
    return np.concatenate([a, h2 + np.uint32(256), h3 + np.uint32(256 + (1 << HASH_BITS))])


def frequencies(text: str) -> np.ndarray:
    p = _positions(text)
    return (np.bincount(p, minlength=WIDTH) / len(p)).astype(np.float32)


@dataclass
class Model:
    """`weights` has a column for each family, then one for each pair of languages of one family."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray
    family_of: dict[str, str] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UND, 0.0
        z = self.weights[_positions(text)].mean(axis=0, dtype=np.float64) + self.bias
        n = len(self.families)
        e = np.exp(z[:n] - z[:n].max())
        f = int(e.argmax())
        chance, family = float(e[f] / e.sum()), self.families[f]
        mine = [x for x in self.languages if self.family_of[x] == family]
        if len(mine) == 1:
            return mine[0], chance
        votes, sure = dict.fromkeys(mine, 0.0), dict.fromkeys(mine, 0.0)
        for (a, b), m in zip(self.pairs, z[n:], strict=True):
            if self.family_of[a] == family:
                p = 1 / (1 + np.exp(-np.clip(2 * m, -40, 40)))
                votes[a] += p > 0.5
                votes[b] += p <= 0.5
                sure[a] += p
                sure[b] += 1 - p
        best = max(mine, key=lambda x: (votes[x], sure[x], x))
        return best, chance * float(sure[best]) / (len(mine) - 1)


def _softmax_fit(x: np.ndarray, y: np.ndarray, k: int, steps: int = 150, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    target, rate = np.eye(k)[y], 4.0 / max(float((x**2).sum(1).mean()), 1e-9)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) / len(x)
        w -= rate * (x.T @ g + l2 * w)
        b -= rate * 0.1 * g.sum(0)
    return w, b


def _svm_fit(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM by dual coordinate descent; y is +1 or -1. The bias is a constant feature."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    norm, w, alpha, rng = (xb**2).sum(1), np.zeros(xb.shape[1]), np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            old = alpha[i]
            alpha[i] = min(max(old - (y[i] * (xb[i] @ w) - 1) / norm[i], 0.0), c)
            if alpha[i] != old:
                w += (alpha[i] - old) * y[i] * xb[i]
                moved = max(moved, abs(alpha[i] - old))
        if moved < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str, bytes]]) -> Model:
    """Learn from (lang, float32 frequencies) rows."""
    if not rows:
        return Model([], [], [], np.zeros((WIDTH, 0)), np.zeros(0))
    rows = sorted(rows)
    x = np.stack([np.frombuffer(v, np.float32) for _, v in rows]).astype(np.float64)
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    x *= scale
    size = np.sqrt((x**2).sum(1).mean())
    x, scale = x / size, scale / size
    y = np.array([lang for lang, _ in rows])
    languages = sorted(set(y.tolist()))
    family_of = {lang: FAMILIES.get(lang, f"only {lang}") for lang in languages}
    families = sorted(set(family_of.values()))
    cols, bias = [], []
    if len(families) > 1:
        w, b = _softmax_fit(x, np.array([families.index(family_of[lang]) for lang in y]), len(families))
        cols, bias = list(w.T), list(b)
    else:
        cols, bias = [np.zeros(x.shape[1])], [0.0]
    pairs = [(a, b) for i, a in enumerate(languages) for b in languages[i + 1 :] if family_of[a] == family_of[b]]
    for a, b in pairs:
        own = (y == a) | (y == b)
        w, c = _svm_fit(x[own], np.where(y[own] == a, 1.0, -1.0))
        cols.append(w)
        bias.append(c)
    return Model(languages, families, pairs, (np.stack(cols, 1) * scale[:, None]).astype(np.float32), np.array(bias), family_of)


def bounded_sample(rows: DataFrame, per_language: int) -> DataFrame:
    """At most `per_language` texts of each language, chosen by hash of doc_id and text; equal rows count once."""
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "text"))
    w = Window.partitionBy("lang").orderBy("_h")
    # The rank is taken over hashes alone; texts are read again only up to the hash of the last one chosen.
    chosen = rows.select("lang", "_h").withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= per_language)
    last = table(chosen.groupBy(F.col("lang").alias("_lang")).agg(F.max("_h").alias("_last")))
    if last.count() <= BROADCAST_LANGUAGES:
        last = F.broadcast(last)
    near = rows.join(last, (F.col("lang") == F.col("_lang")) & (F.col("_h") <= F.col("_last"))).drop("_lang", "_last")
    return near.dropDuplicates(["lang", "_h"]).drop("_h")


def learn(labelled: DataFrame, per_language: int = 200) -> Model:
    """Fit on a bounded sample of rows (doc_id, text, lang). The bound is `per_language` rows for each language that occurs;
    their whole texts are turned into frequencies on the executors."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sample = bounded_sample(rows, per_language)

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            keep = [(lang, frequencies(t).tobytes()) for lang, t in zip(piece["lang"].to_pylist(), piece["text"].to_pylist(), strict=True) if has_letter(t)]
            return pa.record_batch([pa.array([k for k, _ in keep], pa.string()), pa.array([v for _, v in keep], pa.binary())], ["lang", "v"])

        return work

    return fit([(r["lang"], bytes(r["v"])) for r in map_slices(sample, "text", make, "lang string, v binary").collect()])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score to the columns `keep` (default: doc_id); columns of these names are replaced. One narrow
    pass, no shuffle."""
    keep = [k for k in keep or ["doc_id"] if k not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*dict.fromkeys([*keep, "text"])]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def make():
        model = shared.value

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            got = [model.predict(t) for t in piece["text"].to_pylist()]
            return pa.record_batch([*[piece[k] for k in keep], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"])

        return work

    return map_slices(docs.select(*names), "text", make, schema)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language the model can tell, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            return piece.filter(pa.array([model.predict(t)[0] != UND for t in piece["text"].to_pylist()], pa.bool_()))

        return work

    return map_slices(docs, "text", make, docs.schema)


def held_out_mask(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def language_of_documents(docs: DataFrame, per_language: int = 200) -> DataFrame:
    """Learn from rows that aren't held out, predict all: (doc_id, held_out, lang_pred, score)."""
    held = F.coalesce(held_out_mask(F.col("doc_id")), F.lit(False))
    model = learn(docs.where(~held & F.col("lang").isNotNull()), per_language)
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")

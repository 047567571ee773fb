"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over an inverted index.

1. Labelled rows are sampled up to EXAMPLES a class. All their words make the vector space; the inverse document frequency
   of each is counted over all documents.
2. The index is inverted and has block maxima. Examples are put in an order in which like ones are neighbours, by halving
   along the direction of most spread, and cut into blocks of BLOCK. The DENSE most frequent words have their postings as
   columns of a matrix, and the greatest weight of each block in a second one; the others have lists. For a text the
   lists and the block maxima bound each block's cosines from above. The FIRST_BLOCKS of the highest bounds are scored; the
   K-th best cosine so far then rules out all blocks whose bound is below it, and only the others are scored, too.
   All this is in single precision; examples that reach the K-th best within the rounding error are scored again in double
   precision, so that what is found is exact. A tie goes to the smaller example number.
3. Of the words, those whose use differs between the classes (likelihood ratio over LEAST_RATIO) make a second, smaller
   space, searched in the same way for a second vote. No word is dropped from the first for it.
4. The K nearest of each space vote with their squared cosine. A logistic scale, fitted on the examples' own votes without
   themselves and weighted back to the classes' real shares, turns both votes into a chance. The nearest neighbours over
   all words are returned as evidence.

Defined cases: a null or empty text, or one without a word of any example, has no neighbour and takes the vote of examples
without one. Without labels every score is 0. Repeated rows are scored one by one; whole texts count. Of several texts under
one labelled doc_id the one with the least hash is the example; a doc_id labelled both ways is an example of either class.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronotext.llm.common import map_slices, slices

EXAMPLES, LEAST_RATIO = 2000, 18.0
K = 15
#: Examples in a block, words as rows of the matrices, blocks scored at first, texts in one product; none changes what is found.
BLOCK, DENSE, FIRST_BLOCKS, TEXTS = 16, 1024, 4, 256
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

Vector = tuple[np.ndarray, np.ndarray]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 ... of each range, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _order(x: np.ndarray) -> np.ndarray:
    """An order of the rows of `x` in which like rows are neighbours: halves along the direction of most spread, halved again
    until they fit a block."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            done.append(rows)
            continue
        own = x[rows] - x[rows].mean(axis=0)
        # A fixed start, and a few steps of the power method: a rough direction will do.
        v = np.cos(np.arange(own.shape[1]) + 1.0).astype(own.dtype)
        for _ in range(6):
            v = own.T @ (own @ v)
            v /= max(float(np.sqrt(v @ v)), 1e-30)
        rows = rows[np.argsort(own @ v, kind="stable")]
        # Whole blocks on either side, so that no block is left half empty.
        half = -(-len(rows) // (2 * BLOCK)) * BLOCK
        todo += [rows[half:], rows[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


@dataclass
class Index:
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    #: Example at each place of the blocks' order, and the reverse.
    example_at: np.ndarray
    place_of: np.ndarray
    #: Column of a term in `dense` and `most`, or -1; the lists of the others start at `post_at`. Rows are places and blocks.
    row_of: np.ndarray
    dense: np.ndarray
    most: np.ndarray
    post_at: np.ndarray
    post_n: np.ndarray
    post_w: np.ndarray
    #: The examples' own vectors, one after the other.
    own_at: np.ndarray
    own_terms: np.ndarray
    own_w: np.ndarray

    def own(self, n: int) -> Vector:
        at = slice(self.own_at[n], self.own_at[n + 1])
        return self.own_terms[at], self.own_w[at]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1, k: int = K) -> Vector:
        """Numbers and cosines of the k nearest examples with a cosine over 0, nearest first; `skip` is left out."""
        return self.nearest_of([(terms, weights)], [skip], k)[0]

    def nearest_of(self, vectors: list[Vector], skip: list[int] | None = None, k: int = K) -> list[Vector]:
        out, full = [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors), np.zeros(len(self.idf))
        some = [j for j, (t, _) in enumerate(vectors) if len(t)] if len(self.ids) else []
        for i in range(0, len(some), TEXTS):
            own = some[i : i + TEXTS]
            part = [vectors[j] for j in own]
            score, error = self._scores(part, [skip[j] for j in own] if skip else [-1] * len(own), k)
            least = np.maximum(self._kth(score, k) * (1 - error), 2.0**-126)
            text, place = np.nonzero(score >= least[:, None])
            cuts = np.searchsorted(text, np.arange(1, len(part)))
            for j, n, v in zip(own, np.split(self.example_at[place], cuts), part, strict=True):
                out[j] = self._best(n, *v, k, full)
        return out

    def _kth(self, score: np.ndarray, k: int) -> np.ndarray:
        """Each text's k-th best cosine so far; 0 where there are fewer."""
        n = score.shape[1]
        return np.maximum(np.partition(score, n - k, axis=1)[:, n - k], 0).astype(float) if n > k else np.zeros(len(score))

    def _lists(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the words outside the matrix add to the cosine at each place."""
        rare = self.row_of[terms] < 0
        starts, sizes = self.post_at[terms[rare]], self.post_at[terms[rare] + 1] - self.post_at[terms[rare]]
        at = _spread(starts, sizes)
        return np.bincount(self.post_n[at], self.post_w[at] * np.repeat(weights[rare], sizes), len(self.ids)).astype(np.float32)

    def _scores(self, vectors: list[Vector], skip: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Single-precision cosines (text, place), -1 in blocks that were ruled out, and each text's share of rounding."""
        n, begins = len(self.ids), np.arange(0, len(self.ids), BLOCK)
        q = np.zeros((len(vectors), self.dense.shape[1]), np.float32)
        for row, (t, w) in zip(q, vectors, strict=True):
            at = self.row_of[t]
            row[at[at >= 0]] = w[at >= 0]
        # Every summand is 0 or more, so that the error of a sum is a share of it that grows with their number.
        error = np.array([(len(t) + 8) * 2.0**-22 for t, _ in vectors])
        lists = np.stack([self._lists(*v) for v in vectors])
        bound = (q @ self.most.T + np.maximum.reduceat(lists, begins, axis=1)) * (1 + error[:, None])
        score = np.full((len(vectors), n), -1.0, np.float32)
        excluded = [(j, self.place_of[s]) for j, s in enumerate(skip) if s >= 0]

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows, at = np.flatnonzero(wanted[:, b]), slice(begins[b], begins[b] + BLOCK)
                score[rows, at] = q[rows] @ self.dense[at].T + lists[rows, at]
            for j, place in excluded:
                score[j, place] = -1.0

        few = max(FIRST_BLOCKS, -(-(k + 1) // BLOCK) + 1)
        first = bound > 0
        if len(begins) > few:
            first &= bound >= np.partition(bound, len(begins) - few, axis=1)[:, [-few]]
        visit(first)
        visit((bound > 0) & (bound >= (self._kth(score, k) * (1 - error))[:, None]) & ~first)
        return score, error

    def _best(self, n: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, full: np.ndarray) -> Vector:
        """The k nearest of the examples `n`. `full` is all zeros, with a place for each term, before and after."""
        full[terms] = weights
        spans = zip(self.own_at[n].tolist(), self.own_at[n + 1].tolist(), strict=True)
        exact = np.array([full[self.own_terms[a:b]] @ self.own_w[a:b] for a, b in spans])
        full[terms] = 0
        top = np.lexsort((n, -exact))[:k]
        return n[top], exact[top]

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float | None:
        return float((cosine**2) @ self.labels[near] / (cosine**2).sum()) if len(near) else None


@dataclass
class Model:
    terms: dict[bytes, int]
    words: Index
    #: Number of a term in the second space, or -1.
    mark_of: np.ndarray
    marks: Index
    scale: np.ndarray
    nothing: float = 0.0
    id_type: T.DataType = field(default_factory=T.LongType)

    def counts(self, text: str | None) -> np.ndarray:
        """(term, times) of a text's words, by term."""
        return count_terms(Counter(_words(text)), self.terms)

    def vectors(self, counts: np.ndarray) -> tuple[Vector, Vector]:
        return weigh(counts, self.words.idf), weigh(_marked(counts, self.mark_of), self.marks.idf)

    def chance(self, words: float | None, marks: float | None) -> float:
        return self.nothing if words is None else float(1 / (1 + np.exp(-np.clip(self.scale @ _features(words, marks), -40, 40))))


def _features(words: float, marks: float | None) -> np.ndarray:
    return np.array([words, marks or 0.0, marks is not None, 1.0])


def _marked(counts: np.ndarray, mark_of: np.ndarray) -> np.ndarray:
    marks = mark_of[counts[:, 0]]
    return np.stack([marks, counts[:, 1]], axis=1)[marks >= 0]


def count_terms(counts: dict[bytes, int], terms: dict[bytes, int]) -> np.ndarray:
    at = np.fromiter(map(terms.get, counts, repeat(-1)), np.int64, len(counts))
    out = np.stack([at, np.fromiter(counts.values(), np.int64, len(counts))], axis=1)[at >= 0]
    return out[np.argsort(out[:, 0])]


def weigh(counts: dict[int, int] | np.ndarray, idf: np.ndarray) -> Vector:
    """Terms and unit-length TF-IDF weights of (term, times); a term that is in all documents weighs nothing."""
    if isinstance(counts, dict):
        counts = np.array(sorted(counts.items()), np.int64).reshape(-1, 2)
    terms = counts[:, 0].astype(np.int64)
    w = (1 + np.log(counts[:, 1])) * idf[terms]
    size = np.sqrt((w**2).sum())
    return (terms, w / size) if size > 0 else (terms[:0], w[:0])


def build_index(terms: dict[bytes, int], idf: np.ndarray, examples: list[tuple[int, int, dict[int, int] | np.ndarray]], shares: dict[int, float]) -> Index:
    """examples: (doc_id, label, term counts). shares: how many real rows an example of each label stands for."""
    examples = sorted(examples, key=lambda x: (x[1], x[0]))
    vectors = [weigh(e[2], idf) for e in examples]
    own_at = np.cumsum([0, *(len(t) for t, _ in vectors)])
    own_terms, own_w = (np.concatenate([v[i] for v in vectors]) if vectors else np.zeros(0, kind) for i, kind in ((0, np.int64), (1, np.float64)))
    number, seen = np.repeat(np.arange(len(vectors)), np.diff(own_at)), np.bincount(own_terms, minlength=len(idf))
    row_of = np.full(len(idf), -1)
    often = np.argsort(-seen, kind="stable")[:DENSE]
    row_of[often] = np.arange(len(often))
    row, rare = row_of[own_terms], np.flatnonzero(row_of[own_terms] < 0)
    dense = np.zeros((len(vectors), len(often)), np.float32)
    dense[number[row >= 0], row[row >= 0]] = own_w[row >= 0]
    example_at = _order(dense)
    place_of = np.argsort(example_at)
    dense = dense[example_at]
    most = np.maximum.reduceat(dense, np.arange(0, len(vectors), BLOCK), axis=0) if vectors else dense
    rare = rare[np.argsort(own_terms[rare], kind="stable")]
    post_at = np.searchsorted(own_terms[rare], np.arange(len(idf) + 1))
    labels = np.array([e[1] for e in examples], float)
    ids = np.empty(len(examples), object)
    ids[:] = [e[0] for e in examples]
    return Index(idf, ids, labels, example_at, place_of, row_of, dense, most, post_at, place_of[number[rare]], own_w[rare], own_at, own_terms, own_w)


def build_model(terms: dict[bytes, int], idf: np.ndarray, examples: list[tuple[int, int, np.ndarray]], shares: dict[int, float]) -> Model:
    examples = sorted(examples, key=lambda x: (x[1], x[0]))
    mark_of = contrast(len(terms), examples)
    marked = [(i, y, _marked(c, mark_of)) for i, y, c in examples]
    words, marks = build_index(terms, idf, examples, shares), build_index({}, idf[mark_of >= 0], marked, shares)
    model, numbers = Model(terms, words, mark_of, marks, np.zeros(4)), list(range(len(examples)))
    votes = [[x.vote(*near) for near in x.nearest_of([x.own(n) for n in numbers], numbers)] for x in (words, marks)]
    labels, weight = words.labels, np.array([shares[int(y)] for y in words.labels])
    none = np.array([v is None for v in votes[0]], bool)
    model.nothing = float((weight[none] * labels[none]).sum() / weight[none].sum()) if none.any() else float((weight * labels).sum() / weight.sum()) if numbers else 0.0
    if (~none).any():
        x = np.stack([_features(v, m) for v, m in zip(*votes, strict=True) if v is not None])
        y, w = labels[~none], weight[~none] / weight[~none].sum()
        # Platt's targets, so that separable votes don't run to infinity; Newton's steps.
        high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
        target, scale = np.where(y == 1, high, low), np.array([1.0, 1.0, 0.0, -1.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ scale, -40, 40)))
            step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + 1e-4 * np.eye(4), x.T @ (w * (p - target)) + 1e-4 * scale)
            scale = scale - np.clip(step, -5, 5)
        model.scale = scale
    return model


def contrast(terms: int, examples: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """A number for each term whose use differs between the classes by a likelihood ratio over LEAST_RATIO, -1 for others."""
    sizes = [sum(y == c for _, y, _ in examples) for c in (0, 1)]
    seen = [np.bincount(np.concatenate([x[:, 0] for _, y, x in examples if y == c] or [np.zeros(0, np.int64)]), minlength=terms) for c in (0, 1)]
    n, both = sum(sizes), seen[0] + seen[1]
    ratio = np.zeros(terms)
    for size, own in zip(sizes, seen, strict=True):
        for there, expected in ((own, both * size / max(n, 1)), (size - own, (n - both) * size / max(n, 1))):
            ratio += 2 * there * np.log(np.where(there > 0, there, 1) / np.where(there > 0, expected, 1))
    chosen = (ratio > LEAST_RATIO) & (min(sizes) > 0)
    return np.where(chosen, np.cumsum(chosen) - 1, -1)


def _count_terms(rows: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(term, n): in how many texts each term stands, over whole texts; one row a term and task, then summed."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms = shared.value
        counts = np.zeros(len(terms), np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                for t in piece["text"].to_pylist():
                    own = set(_words(t))
                    at = np.fromiter(map(terms.get, own, repeat(-1)), np.int64, len(own))
                    counts[at[at >= 0]] += 1
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["term", "n"])

    return rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def sample_labels(labels: DataFrame, examples: int) -> tuple[DataFrame, dict[int, float]]:
    """At most `examples` (doc_id, toxic) rows a class, chosen by hash, and how many rows one of each class stands for."""
    counts = {r["toxic"]: r["count"] for r in labels.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    if not counts:
        return labels.where("false").select("doc_id", "toxic"), {0: 1.0, 1: 1.0}
    grain = 1 << 20
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, 2 * examples / n) * grain) + 1)])
    near = labels.where("toxic in (0, 1)").where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < share[F.col("toxic")])
    w = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    out = near.select("doc_id", "toxic").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= examples).drop("_n")
    return out, {k: max(1.0, n / examples) for k, n in counts.items()} | {k: 1.0 for k in (0, 1) if k not in counts}


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Fit on documents that have a label. Bound: `examples` rows a class, whose words are gathered; the sample of ids is
    what is broadcast to find their texts."""
    chosen, shares = sample_labels(labels, examples)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    texts = own.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).getField("text").alias("text"))

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            own = [Counter(_words(t)) for t in piece["text"].to_pylist()]
            cols = [pa.array([b" ".join(c) for c in own], pa.binary()), pa.array([np.array(list(c.values()), "<i4").tobytes() for c in own], pa.binary())]
            return pa.record_batch([piece["doc_id"], pa.array(piece["toxic"]).cast(pa.int64()), *cols], ["doc_id", "toxic", "words", "counts"])

        return work

    schema = texts.select("doc_id").schema.add("toxic", "long").add("words", "binary").add("counts", "binary")
    got = map_slices(texts, "text", make, schema).collect()
    # Common words get the small numbers, so that most look-ups stay in a small part of the arrays.
    often = Counter(w for r in got for w in bytes(r["words"]).split())
    terms = {w: i for i, w in enumerate(sorted(often, key=lambda w: (-often[w], w)))}
    rows = [(r["doc_id"], r["toxic"], count_terms(dict(zip(bytes(r["words"]).split(), np.frombuffer(bytes(r["counts"]), "<i4").tolist(), strict=True)), terms)) for r in got]
    seen = np.zeros(len(terms), np.int64)
    total = 0
    if terms:
        total = docs.count()
        found = _count_terms(docs, terms).toArrow()
        seen[found["term"].to_numpy()] = found["n"].to_numpy()
    model = build_model(terms, np.log((1 + total) / (1 + seen)), rows, shares)
    model.id_type = docs.schema["doc_id"].dataType
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) with score, predicted and evidence (doc_ids of the nearest examples)."""
    keep = [k for k in keep or ["doc_id"] if k not in ("score", "predicted", "evidence")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer").add("evidence", T.ArrayType(model.id_type))
    id_type = to_arrow_type(model.id_type)

    def make():
        model = shared.value
        known: dict[bytes, tuple[float, list[int]]] = {}

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            if len(known) >= 20_000:
                known.clear()
            counts = [model.counts(t) for t in piece["text"].to_pylist()]
            keys = [hashlib.sha256(c.tobytes()).digest() for c in counts]
            new = {k: model.vectors(c) for k, c in zip(keys, counts, strict=True) if k not in known}
            near, marks = (x.nearest_of([v[i] for v in new.values()]) for i, x in enumerate((model.words, model.marks)))
            for k, n, m in zip(new, near, marks, strict=True):
                known[k] = model.chance(model.words.vote(*n), model.marks.vote(*m)), model.words.ids[n[0][:5]].tolist()
            scores, evidence = [known[k][0] for k in keys], [known[k][1] for k in keys]
            cols = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.list_(id_type))]
            return pa.record_batch([*[piece[k] for k in keep], *cols], [*keep, "score", "predicted", "evidence"])

        return work

    return map_slices(docs.select(*dict.fromkeys([*keep, "text"])), "text", make, schema)


def held_out_mask(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_of_documents(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Learn from labels that aren't held out, score all: (doc_id, held_out, score, predicted, evidence)."""
    model = learn(docs, labels.where(~held_out_mask(F.col("doc_id"))), examples)
    return score(docs, model).select("doc_id", held_out_mask(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")

"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only: no Python runs on the executors.

A mask names the positions of a short run of tokens that are hashed; the others may differ. MASKS are chosen so that any
WINDOW tokens of which at most a fifth are substituted keep one mask intact (all placements were tried for 15 tokens).
In shorter items the masks can miss a placement; for the lengths where they do (6, 7, 10, 11 and 12, found by trying all),
the item is cut into one run of tokens more than substitutions are permitted, so that one run stays intact. Documents get
seeds of runs only of the lengths that the benchmark at hand needs.
Documents' seeds meet the benchmark's in a join on the hash; around each hit, the aligned windows of WINDOW
tokens that contain the seed are compared token by token, and one with SIMILARITY or more equal tokens is an overlap.

The benchmark is the stated query set. Its seeds, a row of bounded size each, are counted first: up to BROADCAST_SEEDS
are broadcast, so that the documents are read once and nothing of them is shuffled. More are met in shuffled joins: places
of documents meet the distinct seeds (one row a key, so that Spark can split a hot seed's places), those that are left go back
to their texts for the tokens around them, and only then meet the benchmark's tokens.

Defined cases: tokens are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null or empty texts
and those under six tokens have no seeds and no overlap; so have benchmark items that short. An item under WINDOW tokens is
compared as a whole. Rows that share a doc_id, or an item_id, are reported together. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.functions.frames import union_all
from chronotext.llm.common import lower_ascii

MASKS = ("110111", "1011011")
SPAN = min(map(len, MASKS))
WINDOW = 15
SIMILARITY = (4, 5)  # 0.8, as whole numbers
BROADCAST_SEEDS = 200_000
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _runs(w: int) -> list[tuple[int, int]]:
    """(offset, tokens) of the runs of a window of w tokens; none where the masks catch every permitted placement."""
    num, den = SIMILARITY
    lost = w - -(-w * num // den)
    places = [{s + i for i, bit in enumerate(m) if bit == "1"} for m in MASKS for s in range(w - len(m) + 1)]
    if w < SPAN or all(any(p.isdisjoint(c) for p in places) for c in combinations(range(w), lost)):
        return []
    cuts = [w * k // (lost + 1) for k in range(lost + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


RUNS = {w: r for w in range(SPAN, WINDOW) if (r := _runs(w))}


def token_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(lower_ascii(text), _BREAK), ""), lambda w: F.xxhash64(w))


def _run_seed(at: Column, n: int) -> Column:
    parts = [F.get("h", at + i) for i in range(n)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(len(MASKS) + n), *parts))


def _seeds(rows: DataFrame, runs: list[int] | None = None) -> DataFrame:
    """Each position of the token array `h`, with its seeds, also of the given lengths of runs: columns at, seed are added."""
    least = min([SPAN, *(runs or [])])
    placed = rows.withColumn("at", F.explode(F.expr(f"case when size(h) >= {SPAN} then sequence(0, size(h) - {least}) end")))

    def seed(n: int, mask: str) -> Column:
        parts = [F.get("h", F.col("at") + i) for i, bit in enumerate(mask) if bit == "1"]
        return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(n), *parts))

    return placed.withColumn("seed", F.explode(F.array(*[seed(n, m) for n, m in enumerate(MASKS)], *[_run_seed(F.col("at"), n) for n in runs or []])))


def _benchmark_seeds(items: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """(seed, item_id, item_at, w, base, around): `around` are the tokens of all windows that contain the seed, `base` how
    many of them precede it, `w` the window's size. Bounded by two windows a seed. Also the lengths of runs among the seeds."""
    rows = items.where("text is not null").select("item_id", token_hashes(F.col("text")).alias("h")).withColumn("w", F.least(F.lit(window), F.size("h")))
    # The least span of a mask is used for all: a wider mask is contained in one more window at most.
    parts = [_seeds(rows).where("seed is not null").withColumn("n", F.lit(SPAN))]
    found = sorted(r["w"] for r in rows.where(F.col("w").isin(*RUNS)).select("w").distinct().collect())
    for w in found:
        starts = rows.where(F.col("w") == w).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("h") - w)))
        for offset, n in RUNS[w]:
            at = F.col("start") + offset
            parts.append(starts.select("item_id", "h", "w", at.alias("at"), _run_seed(at, n).alias("seed"), F.lit(n).alias("n")))
    low = F.greatest(F.lit(0), F.col("at") + F.col("n") - F.col("w"))
    high = F.least(F.col("at"), F.size("h") - F.col("w"))
    seeds = union_all(*(p.select("item_id", "h", "w", "at", "seed", "n") for p in parts)).withColumn("low", low).withColumn("high", high)
    out = seeds.select("seed", "item_id", "w", (F.col("at") - F.col("low")).alias("base"), F.slice("h", F.col("low") + 1, F.col("high") + F.col("w") - F.col("low")).alias("around"))
    return out, sorted({n for w in found for _, n in RUNS[w]})


def _near(rows: DataFrame, seeds: DataFrame, runs: list[int], window: int) -> DataFrame:
    """Hits by shuffled joins: the columns of `seeds`, doc_id, and the tokens `h` around place `at` of a document, without its
    first `skipped` tokens."""
    named = rows.withColumn("own", F.md5(F.concat_ws(" ", F.transform("h", lambda x: x.cast("string")))))
    places = _seeds(named.select("own", "h"), runs).where("seed is not null").select("own", "at", "seed")
    met = places.join(seeds.select("seed").distinct(), "seed", "left_semi")
    # Rows of equal tokens share their places; a text has no more than a fixed number for each of its tokens.
    each = met.groupBy("own").agg(F.collect_set(F.struct("at", "seed")).alias("places"))
    skipped = F.greatest(F.lit(0), F.col("place.at") - window)
    cut = named.join(each, "own").withColumn("place", F.explode("places")).withColumn("skipped", skipped)
    around = cut.select("doc_id", F.slice("h", F.col("skipped") + 1, 3 * window).alias("h"), (F.col("place.at") - F.col("skipped")).alias("at"), "skipped", F.col("place.seed").alias("seed"))
    return around.join(seeds, "seed")


def _windows(hits: DataFrame, window: int) -> DataFrame:
    """The aligned windows around hits that are overlaps."""
    # `first` is the position of the window's first token in `h`.
    each = hits.withColumn("t", F.explode(F.sequence(F.lit(0), F.size("around") - F.col("w")))).withColumn("first", F.col("at") - F.col("base") + F.col("t"))
    equal = sum(
        (F.when((F.lit(j) < F.col("w")) & (F.get("h", F.col("first") + j) == F.get("around", F.col("t") + j)), 1).otherwise(0) for j in range(window)),
        F.lit(0),
    )
    num, den = SIMILARITY
    found = each.select("doc_id", "item_id", (F.col("first") + F.col("skipped")).alias("first"), "w", equal.alias("equal"))
    return found.where(F.col("equal") * den >= F.col("w") * num)


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, last_word): documents with a passage of an item, the best window's share
    of equal tokens, and the first and last token (from 0) of all such windows."""
    seeds, runs = _benchmark_seeds(items, window)
    rows = docs.select("doc_id", token_hashes(F.col("text")).alias("h"))
    if seeds.count() <= BROADCAST_SEEDS:
        hits = _seeds(rows, runs).withColumn("skipped", F.lit(0)).join(F.broadcast(seeds), "seed")
    else:
        hits = _near(rows, seeds, runs, window)
    return _windows(hits, window).groupBy("doc_id", "item_id").agg(
        F.max(F.col("equal") / F.col("w")).alias("similarity"), F.min("first").cast("long").alias("first_word"), F.max(F.col("first") + F.col("w") - 1).cast("long").alias("last_word")
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without an overlap, all columns kept. Each row is judged by its own text, whatever its doc_id is and
    whichever rows share it: texts are named by a 128-bit digest here."""
    own = F.md5(F.coalesce(docs["text"], F.lit("")))
    leaked = overlaps(docs.select(own.alias("doc_id"), "text"), items, window).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, own == leaked["_leaked"], "left_anti")

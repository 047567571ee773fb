"""Exact removal of long passages that an earlier document has, on a compacted de Bruijn graph of words.

Edges of the graph are the k-mers of WINDOW words, its nodes the runs of words that two edges share. As consecutive edges with
one minimizer are a path without a choice, the graph is written path by path (superwindows.py), never edge by edge where it
needn't be:

1. Paths: rows are grouped by minimizer; those whose minimizer one document only has hold no repeat and go (aggregate, join).
2. Equal paths fold into one class, with the coordinate (document, first word) of the smallest document that has it. Every
   other document's path of that class is a repeat of that coordinate, whatever happens around it (aggregate, join).
3. A minimizer with several classes is a branch. There the first document of each class is unpacked into single edges,
   which fold and meet in the same way (join with the documents, aggregate, join).
4. Compaction: two repeated paths are linked where one follows the other in a document (join on the place). A node that one
   path enters and one leaves, and where the source goes on without a gap, is no branch: its paths are contracted by
   pointer doubling, a join a round, until every path knows the head of its chain. Repeats of one chain that touch in a
   document become one span.
5. Verification: of each document's spans those that cover the same words go. The words at each span's source coordinate are
   cut out of the source document, once for all copies, sent to the copies and compared word by word before anything is
   removed. If any differ, which needs a collision of hashes, the whole attempt is made again with other hashes.

Only documents with a span, or with the source of one, are shuffled, as long as their number allows their ids to be broadcast
(BROADCAST_ROWS); beyond that all documents are.

Hot passages: aggregates combine on the map side first, and joins have a one-row-a-key side, so that Spark's skew handling
can split the other.

Defined cases: null or empty text has no word; documents under WINDOW words lose nothing; repeats inside one document
alone stay; rows that share a doc_id (told apart by a hash of the text) are judged each on its own and never against each
other; a null doc_id is neither smaller nor larger, so its row loses nothing and takes nothing from others. A doc_id may have
any type that can be ordered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions.frames import union_all
from chronotext.llm.common import free, map_slices, packed, table
from chronotext.llm.superwindows import Pieces, WordHashes, window_hashes

WINDOW, MINIMIZER = 50, 16
#: So many doc_ids are broadcast at most.
BROADCAST_ROWS = 500_000
_COUNT_BITS = 8


def _words(texts: list[str | None]) -> list[list[bytes]]:
    return [t.encode("utf-8", "replace").split() if t else [] for t in texts]


def tag_of(docs: DataFrame) -> Column:
    """What tells apart rows with one doc_id: a hash of the text; nothing, where every doc_id is there once."""
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return F.lit(0).cast("long")
    return F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))


def named(docs: DataFrame, tag: Column) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select("doc_id", tag.alias("tag"), "text")


def _first_of(at: Column) -> Column:
    return F.shiftright(at, _COUNT_BITS)


def _count_of(at: Column) -> Column:
    return at.bitwiseAND(F.lit((1 << _COUNT_BITS) - 1))


def paths(rows: DataFrame, window: int = WINDOW, seed: int = 7, bits: int = 64) -> DataFrame:
    """(minimizer, d, doc_id, tag, at) of every super-window; `d` is the digest of its words, `at` packs first word and windows."""
    schema = rows.select(F.lit(0).cast("long").alias("minimizer"), F.lit(0).cast("long").alias("d"), "doc_id", "tag", F.lit(0).cast("long").alias("at")).schema

    def make():
        hashes = WordHashes(seed, bits)

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            p = Pieces(_words(piece["text"].to_pylist()), hashes, window, MINIMIZER)
            of = pa.array(p.doc)
            cols = [pa.array(p.minimizer), pa.array(p.digest()), piece["doc_id"].take(of), piece["tag"].take(of), pa.array((p.first << _COUNT_BITS) | p.count)]
            return pa.record_batch(cols, schema.names)

        return work

    return map_slices(rows, "text", make, schema)


def _with_text(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The named rows that `wanted` (doc_id, tag, ..., a row each) has, with its columns."""
    near = rows.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi") if wanted.count() <= BROADCAST_ROWS else rows
    return near.join(wanted, ["doc_id", "tag"])


def _edges(texts: DataFrame, window: int, seed: int, bits: int) -> DataFrame:
    """(w1, w2, doc_id, tag, first) of each window of the paths `places` of documents (doc_id, tag, text, places)."""
    schema = texts.select(F.lit(0).cast("long").alias("w1"), F.lit(0).cast("long").alias("w2"), "doc_id", "tag", F.lit(0).cast("long").alias("first")).schema

    def make():
        hashes = WordHashes(seed, bits)

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            at = [np.array(x, np.int64) for x in piece["places"].to_pylist()]
            doc, first, w = window_hashes(_words(piece["text"].to_pylist()), hashes, window, [x >> _COUNT_BITS for x in at], [x & ((1 << _COUNT_BITS) - 1) for x in at])
            of = pa.array(doc)
            return pa.record_batch([pa.array(w[:, 0]), pa.array(w[:, 1]), piece["doc_id"].take(of), piece["tag"].take(of), pa.array(first)], schema.names)

        return work

    return map_slices(texts.select("doc_id", "tag", "text", "places"), "text", make, schema)


def _source(source: str, first: Column) -> list[Column]:
    return [F.col(f"{source}.doc_id").alias("s_doc"), F.col(f"{source}.tag").alias("s_tag"), first.alias("s_first")]


def _repeats(rows: DataFrame, window: int, seed: int, bits: int) -> DataFrame:
    """(doc_id, tag, first, count, s_doc, s_tag, s_first): `count` windows from a document's word `first` that an earlier
    document, the first to have them, has from its word `s_first`."""
    found = table(paths(rows, window, seed, bits))
    shared = table(found.groupBy("minimizer").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("minimizer"))
    kept = table(found.join(shared, "minimizer"))
    free(found, shared)
    classes = table(kept.groupBy("minimizer", "d").agg(F.min(F.struct("doc_id", "tag", "at")).alias("source"), F.max("doc_id").alias("last")))
    whole = kept.join(classes.where("source.doc_id < last").select("minimizer", "d", "source"), ["minimizer", "d"]).where("doc_id > source.doc_id")
    wholes = whole.select("doc_id", "tag", _first_of(F.col("at")).alias("first"), _count_of(F.col("at")).alias("count"), *_source("source", _first_of(F.col("source.at"))))

    # What a join takes one row a key from is written first: both sides then have an exchange, and a hot key can be split.
    branches = table(classes.groupBy("minimizer").count().where("count > 1").select("minimizer"))
    open_ = classes.join(branches, "minimizer").groupBy(F.col("source.doc_id").alias("doc_id"), F.col("source.tag").alias("tag"))
    places = table(open_.agg(F.collect_set("source.at").alias("places")))
    edges = table(_edges(_with_text(rows, places), window, seed, bits))
    # Most edges have no equal; half the hash and the range of documents, which is all that is shuffled of them, rule them out.
    twice = table(edges.groupBy("w1").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("w1"))
    again = table(edges.join(twice, "w1"))
    first = table(again.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "tag", "first")).alias("source"), F.max("doc_id").alias("last")).where("source.doc_id < last").drop("last"))
    single = again.join(first, ["w1", "w2"]).where("doc_id > source.doc_id")
    singles = _runs(single.select("doc_id", "tag", "first", F.lit(1).cast("long").alias("count"), *_source("source", F.col("source.first"))))
    out = table(union_all(wholes, singles))
    free(kept, classes, branches, places, edges, twice, again, first)
    return out


def _runs(repeats: DataFrame, *chain: str) -> DataFrame:
    """Repeats of one document and one source that touch or overlap along the same shift as one; those of different `chain`
    stay apart."""
    line = ["doc_id", "tag", "s_doc", "s_tag", "shift", *chain]
    w = Window.partitionBy(*line).orderBy("first", "count")
    end = F.col("first") + F.col("count")
    rows = repeats.withColumn("shift", F.col("s_first") - F.col("first"))
    rows = rows.withColumn("reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach")), 1).otherwise(0)
    runs = rows.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*line, "run").agg(F.min("first").alias("first"), (F.max(end) - F.min("first")).alias("count"))
    return out.select("doc_id", "tag", "first", "count", "s_doc", "s_tag", (F.col("first") + F.col("shift")).alias("s_first"))


def _chains(repeats: DataFrame) -> DataFrame:
    """(node, head) of the repeated paths that a node without a branch joins to one before them; `head` begins the chain.

    A path is named by a hash of its source coordinate. A collision could only part or name chains otherwise than they are:
    spans are made of repeats that touch at both coordinates in any case."""
    end = F.col("s_first") + F.col("count")
    step = lambda name, at, edge: repeats.select("doc_id", "tag", at.alias("at"), F.col("node").alias(name), F.struct("s_doc", "s_tag", edge.alias("s_at")).alias(f"{name}_at"))
    after = step("u", F.col("first") + F.col("count"), end).join(step("v", F.col("first"), F.col("s_first")), ["doc_id", "tag", "at"])
    pairs = table(after.groupBy("u", "v").agg(F.first(F.col("u_at") == F.col("v_at")).alias("goes_on")))
    out = pairs.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"), F.bool_and("goes_on").alias("goes_on")).where("n = 1 and goes_on").select("u", "v")
    into = pairs.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("u")).where("n = 1").select("u", "v")
    links = table(out.join(into, ["u", "v"]).where("u <> v"))
    heads = links.select(F.col("u").alias("node")).join(links.select(F.col("v").alias("node")), "node", "left_anti").select("node", F.col("node").alias("head"))
    now = table(union_all(links.select(F.col("v").alias("node"), F.col("u").alias("head")), heads))
    free(pairs, links)
    # Doubling: 64 rounds are enough for any chain that has fewer than 2 ** 64 paths.
    for _ in range(64):
        ahead = now.select(F.col("node").alias("head"), F.col("head").alias("further"))
        then = table(now.join(ahead, "head").select("node", F.col("further").alias("head"), (F.col("further") != F.col("head")).alias("moved")))
        free(now)
        now = then
        if now.where("moved").isEmpty():
            break
    return now.select("node", "head")


def _cover(repeats: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, first, size, s_doc, s_tag, s_first) of the fewest spans that cover what a document's repeats cover, so
    that no word is in more than two of them."""
    spans = F.array_sort(F.collect_list(F.struct("first", (F.col("count") + window - 1).alias("size"), "s_doc", "s_tag", "s_first")))
    rows = repeats.groupBy("doc_id", "tag").agg(spans.alias("spans"))
    one = F.explode("spans").alias("s")
    schema = rows.select("doc_id", "tag", one).select("doc_id", "tag", "s.*").schema

    def run(batches):
        for batch in batches:
            take, picked = [], []
            spans = batch["spans"]
            flat, offsets = spans.flatten(), spans.offsets.to_numpy()
            firsts, sizes = (flat.field(k).to_numpy() for k in (0, 1))
            base = offsets[0]
            for doc in range(batch.num_rows):
                low, high = int(offsets[doc] - base), int(offsets[doc + 1] - base)
                covered, n = -1, low
                while n < high:
                    if firsts[n] + sizes[n] <= covered:
                        n += 1
                        continue
                    # Of the spans that begin where all is covered so far, or at the next place, the one that reaches furthest.
                    limit, best = max(covered, int(firsts[n])), n
                    while n < high and firsts[n] <= limit:
                        best = n if firsts[n] + sizes[n] > firsts[best] + sizes[best] else best
                        n += 1
                    take.append(doc)
                    picked.append(best)
                    covered = int(firsts[best] + sizes[best])
            of, at = pa.array(take, pa.int64()), pa.array(picked, pa.int64())
            chosen = [flat.field(k).take(at) for k in range(5)]
            yield pa.record_batch([batch["doc_id"].take(of), batch["tag"].take(of), *chosen], schema.names)

    return rows.mapInArrow(run, schema)


def repeated_spans(rows: DataFrame, window: int = WINDOW, seed: int = 7, bits: int = 64) -> DataFrame:
    """(doc_id, tag, first, size, s_doc, s_tag, s_first) of spans that windows of earlier documents cover, with the
    coordinate where the source has them; not verified yet."""
    repeats = _repeats(rows, window, seed, bits)
    nodes = repeats.withColumn("node", F.xxhash64("s_doc", "s_tag", "s_first", "count"))
    heads = _chains(nodes)
    chained = nodes.join(heads, "node", "left").withColumn("chain", F.coalesce("head", "node"))
    out = table(_cover(_runs(chained, "chain"), window))
    free(repeats)
    return out


def _passages(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(s_doc, s_tag, s_first, size, words): the words at each source coordinate, each cut out once."""
    wanted = spans.groupBy(F.col("s_doc").alias("doc_id"), F.col("s_tag").alias("tag")).agg(F.collect_set(F.struct("s_first", "size")).alias("cuts"))
    texts = _with_text(rows, table(wanted)).select("doc_id", "tag", "text", "cuts")
    schema = spans.select("s_doc", "s_tag", "s_first", "size").schema.add("words", "string")

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            got = []
            for n, (words, cuts) in enumerate(zip(_words(piece["text"].to_pylist()), piece["cuts"].to_pylist(), strict=True)):
                got += [(n, c["s_first"], c["size"], b" ".join(words[c["s_first"] : c["s_first"] + c["size"]]).decode()) for c in cuts]
            of = pa.array([g[0] for g in got], pa.int64())
            cols = [pa.array([g[k] for g in got], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()))]
            return pa.record_batch([piece["doc_id"].take(of), piece["tag"].take(of), *cols], schema.names)

        return work

    return map_slices(texts, "text", make, schema)


def _cut_out(rows: DataFrame) -> DataFrame:
    """Rows (row, text, spans) to (row, n_words, n_removed, kept_text, wrong): the words that no span covers, and how many spans'
    words aren't those of their source."""
    schema = rows.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("wrong", "long")

    def make():
        def one(text: str | None, spans: list[dict] | None) -> tuple[int, int, str, int]:
            words = text.encode("utf-8", "replace").split() if text else []
            kept, at, wrong = [], 0, 0
            for s in sorted(spans or (), key=lambda s: s["first"]):
                first, end = s["first"], s["first"] + s["size"]
                if end > len(words) or b" ".join(words[first:end]) != s["words"].encode("utf-8", "replace"):
                    wrong += 1
                    continue
                kept += words[at:first] if first > at else []
                at = max(at, end)
            kept += words[at:]
            return len(words), len(words) - len(kept), b" ".join(kept).decode(), wrong

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            got = [one(t, s) for t, s in zip(piece["text"].to_pylist(), piece["spans"].to_pylist(), strict=True)]
            more = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            return pa.record_batch([piece["row"], *more], schema.names)

        return work

    return map_slices(rows, "text", make, schema)


def _attempt(docs: DataFrame, window: int, seed: int, bits: int) -> tuple[DataFrame, bool]:
    """The rows cut, and whether every removed span was verified."""
    tag = tag_of(docs)
    rows = named(docs, tag)
    spans = repeated_spans(rows, window, seed, bits)
    met = spans.join(_passages(rows, spans), ["s_doc", "s_tag", "s_first", "size"])
    own = table(met.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "size", "words")).alias("spans")))
    marked = packed(docs, docs["doc_id"].alias("own"), tag.alias("own_tag"))
    none = F.lit(None).cast(own.schema["spans"].dataType).alias("spans")
    whole = lambda df, spans: df.select("row", F.col("row").getField("text").alias("text"), spans)
    same = (F.col("own") == F.col("doc_id")) & (F.col("own_tag") == F.col("tag"))
    if own.count() <= BROADCAST_ROWS:
        ids = F.broadcast(own.select(F.col("doc_id").alias("own")).distinct())
        cut = table(_cut_out(whole(marked.join(ids, "own", "left_semi").join(own, same, "left"), F.col("spans"))))
        out = union_all(_cut_out(whole(marked.join(ids, "own", "left_anti"), none)), cut)
    else:
        out = cut = table(_cut_out(whole(marked.join(own, same, "left"), F.col("spans"))))
    free(spans)
    return out.drop("wrong"), cut.where("wrong > 0").isEmpty()


def cut_repeats(docs: DataFrame, window: int = WINDOW, bits: tuple[int, ...] = (64,)) -> DataFrame:
    """Each row's columns as the struct `row`, with n_words, n_removed and kept_text: the words left, joined by one space.

    `bits` are the bits of the hashes that attempts use, the last for all further ones; fewer than 64 make collisions, which
    verification must find."""
    seed = 7
    while True:
        out, verified = _attempt(docs, window, seed, bits[0])
        if verified:
            return out
        seed, bits = seed + 1, bits[1:] or bits


def remove_repeats(docs: DataFrame, window: int = WINDOW, bits: tuple[int, ...] = (64,)) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row."""
    return cut_repeats(docs.select("doc_id", "text"), window, bits).select("row.doc_id", "n_words", "n_removed", "kept_text")

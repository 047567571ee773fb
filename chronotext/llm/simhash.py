"""SimHash near-duplicates, candidates pruned by the pigeonring principle.

A 64-bit fingerprint is a ring of four 16-bit segments. If two differ in at most three bits, then from some segment
on every chain of consecutive segments keeps within its share of the budget: 1 segment 0 bits, 2 segments 1 bit,
3 segments 2 bits, 4 segments 3 bits. The first two conditions are a join key (the segment itself and the next one up to
one flipped bit: 32 bits selective, so a bucket stays small as the table grows); the others filter the joined rows
before the full Hamming distance is taken.

Defined cases: a null or empty text has no word and fingerprint zero, and links like any other; texts of one or two
words are one shingle. Exact copies share a fingerprint and are one node. Repeated rows keep their count. A null
doc_id gets a component but never names one. Of each component `keep_first` keeps exactly one row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm.common import free, map_slices, packed, shuffled, table, unpacked
from chronotext.llm.components import components

SEED = 42
SEGMENTS, SEGMENT_BITS, BUDGET = 4, 16, 3


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) with fp: the majority vote of the bits of all 3-word shingles' XXH64."""
    keep = keep or ["doc_id"]

    def make():
        import numpy as np
        from xxhash import xxh64_intdigest

        fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

        def one(text: str | None) -> int:
            words = text.encode("utf-8", "replace").translate(fold).split() if text else []
            if not words:
                return 0
            if len(words) < 4:
                return int(np.uint64(xxh64_intdigest(b" ".join(words), SEED)).view(np.int64))
            line, ends, at = b" ".join(words), [], -1
            for w in words:
                at += len(w) + 1
                ends.append(at)
            starts = [0, *[e + 1 for e in ends[:-3]]]
            n = len(starts)
            votes = np.zeros(64, np.int64)
            for i in range(0, n, 1 << 15):
                h = np.fromiter((xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[i : i + (1 << 15)], ends[i + 2 : i + 2 + (1 << 15)], strict=False)), np.uint64)
                votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
            return int(np.packbits(votes * 2 > n).view(">i8")[0])

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([*[piece[k] for k in keep], pa.array([one(t) for t in piece["text"].to_pylist()], pa.int64())], [*keep, "fp"])

        return work

    return map_slices(docs.select(*keep, "text"), "text", make, docs.select(*keep).schema.add("fp", "long"))


def _segment(fp, i: int):
    return F.shiftrightunsigned(fp, SEGMENT_BITS * (SEGMENTS - 1 - i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def links(distinct_fps: DataFrame) -> DataFrame:
    """Pairs (u, v) of different fingerprints at most BUDGET bits apart, u < v. Input: distinct fp values.

    Emits 4 index rows and 4 x 17 probe rows a fingerprint; each pair meets in as many buckets as it has valid
    chains, never more than four. However many copies a text has, a fingerprint has at most 43,744 others within three bits.
    """
    fp = F.col("fp")

    def key(start: int, second):
        return F.lit(start << 32).bitwiseOR(F.shiftleft(_segment(fp, start), SEGMENT_BITS)).bitwiseOR(second)

    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b).cast("bigint") for b in range(SEGMENT_BITS)])
    index = distinct_fps.select(fp.alias("u"), F.explode(F.array(*[key(i, _segment(fp, i + 1)) for i in range(SEGMENTS)])).alias("key"))
    probe = distinct_fps.select("fp", F.explode(flips).alias("flip")).select(
        fp.alias("v"), F.explode(F.array(*[key(i, _segment(fp, i + 1).bitwiseXOR(F.col("flip"))) for i in range(SEGMENTS)])).alias("key")
    )
    d = F.col("u").bitwiseXOR(F.col("v"))
    # Bits of the first three segments of the chain; the fourth is the one before its start.
    last = F.expr("shiftrightunsigned(u ^ v, 16 * (3 - cast((shiftrightunsigned(key, 32) + 3) % 4 as int))) & 65535")
    three = F.bit_count(d) - F.bit_count(last)
    return index.join(shuffled(probe), "key").where((F.col("u") < F.col("v")) & (three <= 2) & (F.bit_count(d) <= BUDGET)).select("u", "v").distinct()


def _rooted(fps: DataFrame, first: Column) -> DataFrame:
    """(fp, root, first) of each fingerprint: `root` names its component, `first` is an aggregate over its rows."""
    each = table(fps.groupBy("fp").agg(first.alias("first")))
    stars = components(links(each.select("fp")))
    return each.join(shuffled(stars.select(F.col("u").alias("fp"), F.col("v").alias("root"))), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: component_id is the smallest doc_id reachable over links."""
    fps = table(fingerprints(docs))
    named = _rooted(fps, F.min("doc_id"))
    # Written, so that a join has an exchange on either side and Spark can split a component or fingerprint with very many rows.
    roots = table(named.groupBy("root").agg(F.min("first").alias("component_id")))
    linked = table(named.join(shuffled(roots), "root").select("fp", "component_id"))
    free(roots)
    return fps.join(shuffled(linked), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Exactly one row of each component, columns unchanged: the one with its smallest doc_id; rows without a doc_id come
    last. Of several texts under that doc_id the one with the least digest stays, and of rows that are equal in both, the
    one with the least hash over all columns."""
    own = F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.concat(F.lit("="), docs["text"]), F.lit(""))))
    fps = table(fingerprints(docs.select("doc_id", own.alias("_own"), "text"), ["doc_id", "_own"]))
    named = _rooted(fps, F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_own")))
    first = table(named.groupBy("root").agg(F.min("first").getField("_own").alias("_first")).select("_first"))
    free(fps)
    # Equal rows are thinned in each task before they are shuffled, so that one with very many copies makes no large task.
    plain = [docs[f.name] for f in docs.schema if "map" not in f.dataType.simpleString()]
    w = Window.partitionBy("own").orderBy("fold")
    rows = packed(docs, own.alias("own"), F.xxhash64(*plain).alias("fold")).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return unpacked(rows.join(shuffled(first), rows["own"] == first["_first"], "left_semi"))

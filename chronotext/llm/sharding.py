"""Byte-limited shards by extendible hashing.

The directory is indexed by the leading bits of a row's hash. A bucket over the byte limit splits on its next bit, and
only it does; a bucket that fits keeps its depth. Rows meet the directory as sums: one aggregation gives the bytes of each
prefix of a chosen length, and all shorter prefixes are sums of these. Prefixes that are still too large go on with more
bits, with their rows only.

Rows that share all bits (one key) can't be split by the key. Their bucket is an overflow chain: it gets a second directory
on a hash of a number of each row, so that it, too, splits until it fits. One row over the limit is a shard of its own.

Defined cases: a null text has 0 bytes; a null key hashes as the empty string. Repeated rows are rows of their own. An empty
table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions.frames import union_all
from chronotext.llm.common import table

BITS = 60
SHARD_BYTES = 2 << 20
#: A directory of one step has at most 2**STEP_BITS entries, which bounds what is broadcast.
STEP_BITS = 14


def key_hash(key: Column) -> Column:
    """60 bits of MD5, which other engines compute alike."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, bits) -> Column:
    return F.shiftrightunsigned(h, BITS - bits) if bits else F.lit(0).cast("long")


def _bits(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))


def _step(rows: DataFrame, known: int, bits: int, limit: int) -> DataFrame:
    """The directory of one step for rows whose first `known` bits are decided too large: a row for each prefix of `bits`
    bits, with the depth, bytes and rows of its bucket; depth is null where it must be split further."""
    base = rows.groupBy(_prefix(F.col("_h"), bits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    each = base.withColumn("d", F.explode(F.sequence(F.lit(known), F.lit(bits))))
    at = F.expr(f"shiftrightunsigned(p, {bits} - d)")
    w = Window.partitionBy("d", at)
    summed = each.select("p", "d", F.sum("b").over(w).alias("b"), F.sum("n").over(w).alias("n"))
    fits = (F.col("b") <= limit) | (F.col("n") == 1)
    best = F.min(F.when(fits, F.struct("d", "b", "n")))
    return summed.groupBy("p").agg(best.alias("s")).select("p", F.col("s.d").alias("depth"), F.col("s.b").alias("shard_bytes"), F.col("s.n").alias("shard_rows"))


def _assign(rows: DataFrame, limit: int, chain: bool) -> DataFrame:
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = min(max(math.ceil(math.log2(max(total, 1) / limit)) + 2 if total > limit else 1, 1), STEP_BITS)
    known, done = 0, []
    columns = [c for c in rows.columns if c not in ("_h", "_id")]
    while True:
        directory = table(_step(rows, known, bits, limit))
        at = rows.withColumn("p", _prefix(F.col("_h"), bits))
        entry = F.broadcast(directory) if bits <= STEP_BITS else directory
        found = at.join(entry, "p")
        where = _bits(F.expr(f"shiftrightunsigned(p, {bits} - depth)"), F.col("depth"))
        done.append(found.where("depth is not null").select(*columns, where.alias("bits"), "depth", "shard_bytes", "shard_rows"))
        if directory.where("depth is null").isEmpty():
            break
        rows = table(found.where("depth is null").select(*columns, "_h", "_id"))
        if bits == BITS:
            if chain:
                done.append(rows.select(*columns, F.lpad(F.bin("_h"), BITS, "0").alias("bits"), F.lit(BITS).alias("depth"), F.col("bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_rows")))
                break
            again = rows.select(*columns, F.col("_h").alias("_key"), key_hash(F.col("_id")).alias("_h"), "_id")
            over = _assign(again, limit, chain=True)
            done.append(over.select(*columns, F.concat_ws(".", F.lpad(F.bin("_key"), BITS, "0"), "bits").alias("bits"), (F.col("depth") + BITS).alias("depth"), "shard_bytes", "shard_rows"))
            break
        known, bits = bits + 1, min(bits + 8, BITS)
    return union_all(*done)


def _sized(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """Written, so that a row's number stays the same when a task runs again."""
    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("bytes")
    return table(docs.select(*more, size, key_hash(docs[key]).alias("_h"), F.monotonically_increasing_id().alias("_id")))


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """(key, bytes, shard, depth, shard_bytes, shard_rows) of every row; shard is `s` and the bucket's hash prefix in bits."""
    out = _assign(_sized(docs, key, text, docs[key]), limit, chain=False)
    return out.select(key, "bytes", F.concat(F.lit("s"), "bits").alias("shard"), F.col("depth").cast("int").alias("depth"), F.col("shard_bytes").cast("long").alias("shard_bytes"), F.col("shard_rows").cast("long").alias("shard_rows"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """Write the documents as one folder a shard. Each row carries its own columns through the directory, so that it is
    written once, whichever rows share its key."""
    name = "_shard"
    while name in docs.columns:
        name = f"_{name}"
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    out = _assign(_sized(docs, key, text, whole), limit, chain=False).select("row", F.concat(F.lit("s"), "bits").alias("shard"))
    rows = out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("shard").alias(name))
    rows.repartition(name).write.partitionBy(name).parquet(path)

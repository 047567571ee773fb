"""Byte-level BPE encoding and decoding; long texts are encoded in parallel leaves and joined in a tree.

A leaf is LEAF characters cut anywhere. Two neighbours are joined by encoding a window around the cut again, and the window
grows until both sides agree exactly:

* Splits of the pattern: a match depends only on where it starts and on at most two characters after its end. So the splits
  of the left part are final up to the last that ends at least two characters before the cut. From there the text is split
  anew, ever further into the right part, until a final split coincides with one that the right part has; from
  there on both are the same.
* A split that spans the cut may itself be long (text without spaces). Its BPE is not repeated as a whole: the last and
  first tokens of both sides are encoded again, and more of them, until the result begins with the token
  that the left side has there and ends with the one that the right side has. A sequence is a BPE encoding exactly
  if each pair of neighbours is, so that this agreement settles the join.

Defined cases: null is the empty text, which has no tokens. Special tokens in a text get their id, as the tokenizers
library does by default, and are never cut. Repeated rows are encoded each. The vocabulary file is a parameter.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.functions.frames import union_all
from chronotext.llm.common import map_slices

#: Fixed value: the published split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 1 << 15
_SETTLED = 8  # bytes of two characters at most


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Part:
    """An encoded piece: its bytes, token ids and where the pattern's splits begin (byte offsets, then the end)."""

    data: bytes
    ids: np.ndarray
    splits: np.ndarray


class Codec:
    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {k: v for k, v in ranks.items() if v not in self.special.values()}
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._split = regex.compile(PATTERN)
        top = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for k, v in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.bytes_of[v] = k
        self._length = np.array([len(b) for b in self.bytes_of], np.int64)
        self._special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def plain(self, text: str) -> list[int]:
        return self._bpe.encode_ordinary(text)

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """(is a special token, text) in order, without empty pieces."""
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [(False, text[at : m.start()]), (True, m[0])]
            at = m.end()
        return [s for s in [*out, (False, text[at:])] if s[1]]

    def encode(self, text: str | None) -> list[int]:
        """A text in one go."""
        if not text:
            return []
        if not self.special or not self._special.search(text):
            return self.plain(text)
        return [i for special, s in self.segments(text) for i in ([self.special[s]] if special else self.plain(s))]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _splits(self, data: bytes) -> np.ndarray:
        sizes = [len(s.encode("utf-8", "replace")) for s in self._split.findall(data.decode("utf-8"))]
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(np.array(sizes, np.int64))])

    def leaf(self, text: str) -> Part:
        data = text.encode("utf-8", "replace")
        return Part(data, np.array(self.plain(text), np.uint32), self._splits(data))

    def _tokens_before(self, ids: np.ndarray, offset: int) -> int:
        return int(np.searchsorted(np.cumsum(self._length[ids]), offset, side="right")) if offset else 0

    def _join_tokens(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """BPE of one split from the BPE of its halves."""
        k = 8
        while True:
            i, j = max(len(a) - k, 0), min(k, len(b))
            window = b"".join(map(self.bytes_of.__getitem__, [*a[i:].tolist(), *b[:j].tolist()]))
            got = np.array(self._bpe._core_bpe.encode_single_piece(window), np.uint32)
            if (i == 0 or got[0] == a[i]) and (j == len(b) or got[-1] == b[j - 1]):
                return np.concatenate([a[:i], got, b[j:]])
            k *= 2

    def join(self, a: Part, b: Part) -> Part:
        if not a.data or not b.data:
            return a if a.data else b
        cut, whole = len(a.data), a.data + b.data
        start = int(a.splits[: np.searchsorted(a.splits, cut - _SETTLED, side="right")].max(initial=0))
        reach, own = 64, set(b.splits.tolist())
        while True:
            stop = min(cut + reach, len(whole))
            while stop < len(whole) and whole[stop] & 0xC0 == 0x80:
                stop += 1
            splits = self._splits(whole[start:stop]) + start
            final = splits if stop == len(whole) else splits[splits + _SETTLED <= stop]
            meet = next((int(s) for s in final if s >= cut and int(s) - cut in own), None)
            if meet is not None:
                break
            reach *= 2
        new = splits[splits <= meet]
        ids = [a.ids[: self._tokens_before(a.ids, start)]]
        for x, y in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
            left = x < cut < y and a.splits[np.searchsorted(a.splits, x)] == x and not np.any((a.splits > x) & (a.splits < cut))
            if left and y - x > 256 and not np.any((b.splits > 0) & (b.splits < y - cut)):
                ids.append(self._join_tokens(a.ids[self._tokens_before(a.ids, x) :], b.ids[: self._tokens_before(b.ids, y - cut)]))
            else:
                ids.append(np.array(self._bpe._core_bpe.encode_single_piece(whole[x:y]), np.uint32))
        ids.append(b.ids[self._tokens_before(b.ids, meet - cut) :])
        return Part(whole, np.concatenate(ids), np.concatenate([a.splits[a.splits < start], new, b.splits[b.splits > meet - cut] + cut]))

    def tree(self, parts: list[Part]) -> Part:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _row_key():
    """Rows with one doc_id are told apart by their text. Equal rows of one input partition share leaves and count; those of
    other partitions are groups of their own, so that a text with very many copies makes no group beyond a partition's size."""
    return F.col("doc_id").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("own"), F.spark_partition_id().alias("part")


def _leaves(long: DataFrame, path: str, leaf: int) -> DataFrame:
    """One row a leaf: (doc_id, own, part, place, total, special, piece)."""
    schema = long.select("doc_id").schema.add("own", "string").add("part", "integer").add("place", "long").add("total", "long").add("special", "boolean").add("piece", "string")

    def make():
        c = codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for i, text in enumerate(batch["text"].to_pylist()):
                mine = [(sp, s[at : at + leaf]) for sp, s in c.segments(text) for at in range(0, len(s), len(s) if sp else leaf)]
                rows += [(i, n, len(mine), sp, s) for n, (sp, s) in enumerate(mine)]
            of = pa.array([r[0] for r in rows], pa.int64())
            cols = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.bool_()), (4, pa.string()))]
            return pa.record_batch([*[batch[k].take(of) for k in ("doc_id", "own", "part")], *cols], ["doc_id", "own", "part", "place", "total", "special", "piece"])

        return work

    return map_slices(long, "text", make, schema)


def _encode_leaves(leaves: DataFrame, path: str) -> DataFrame:
    schema = leaves.select("*").schema.add("ids", "binary")

    def make():
        c = codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.array([c.special[s]] if sp else c.plain(s), "<u4").tobytes() for sp, s in zip(batch["special"].to_pylist(), batch["piece"].to_pylist(), strict=True)]
            return pa.record_batch([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, "ids"])

        return work

    return map_slices(leaves, "piece", make, schema)


def encode_decode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded the text that they decode to.

    Texts of up to `leaf` characters are encoded where they are read. Longer ones become leaves, spread over the
    cluster by hash, encoded there, and joined in a tree in one task a text.
    """
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id").schema.add("ids", "binary").add("decoded", "string")

    def make():
        c = codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [c.encode(t) for t in batch["text"].to_pylist()]
            packed = pa.array([np.array(i, "<u4").tobytes() for i in ids], pa.binary())
            return pa.record_batch([batch["doc_id"], packed, pa.array([c.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

        return work

    short = map_slices(rows.where(F.coalesce(F.length("text"), F.lit(0)) <= leaf), "text", make, schema)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    leaves = _leaves(rows.where(F.length("text") > leaf).select(*_row_key(), "text"), path, leaf)
    encoded = _encode_leaves(leaves.repartition(n, "doc_id", "own", "part", "place"), path)

    def merge(table: pa.Table) -> pa.Table:
        c, t = codec(path), table.sort_by("place")
        copies = t.num_rows // t["total"][0].as_py()
        ids, run = [], []

        def close():
            if run:
                ids.append(c.tree(run).ids)
                run.clear()

        at = list(range(0, t.num_rows, copies))
        for special, piece, own in zip(*(t[k].take(at).to_pylist() for k in ("special", "piece", "ids")), strict=True):
            own = np.frombuffer(own, "<u4")
            if special:
                close()
                ids.append(own)
            else:
                data = piece.encode("utf-8", "replace")
                run.append(Part(data, own, c._splits(data)))
        close()
        whole = np.concatenate(ids).astype("<u4")
        first = t["doc_id"].slice(0, 1).combine_chunks()
        return pa.table([pa.concat_arrays([first] * copies), pa.array([whole.tobytes()] * copies, pa.binary()), pa.array([c.decode(whole.tolist())] * copies, pa.string())], ["doc_id", "ids", "decoded"])

    return union_all(short, encoded.groupBy("doc_id", "own", "part").applyInArrow(merge, schema))

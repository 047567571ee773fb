"""Quality rules on repetition inside a text, from a suffix array over its words.

Many texts are handled at once. A suffix is sorted by its text and words, by prefix doubling that goes on only with suffixes that
are still equal to another; one array of ranks is kept. The longest common prefixes of neighbours are taken in the order of
the text: where the words before a suffix and its neighbour are equal, too, the value is one less than at the place before;
only at the other places words are compared, which is n log n words in all. So memory is a few numbers a word, for any text.

An interval of the array with a common prefix is a repeated substring that can't be longer to the right; it is maximal if
the words before its places differ. The union of the spans of all maximal repeats is the part of the text that repeats: at each
place the innermost interval is the longest, and where it isn't maximal, it lies within one that is.

Verdict of the method: a text fails if maximal repeats of MIN_REPEAT words or more cover over MAX_COVERED of its words, or if
the longest has over MAX_LONGEST words.

Defined cases: null has no words; a text under ten words fails the base rules. Repeated rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronotext.llm.common import map_slices

MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.2, 50
#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
BASE_WINDOW = 5


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where any of the sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _grouped(new: np.ndarray) -> np.ndarray:
    """Members of groups of two or more; `new` marks each group's first."""
    return ~(new & np.append(new[1:], True))


def suffix_array(words: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Places of all suffixes, those of one text together and in the order of their words.

    words: word numbers of texts one after another; stop: for each place, where its text ends.
    """
    n = len(words)
    # A rank is the number of suffixes in smaller groups, so a group can be refined in its own room.
    key = stop * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key)
    new, at = _starts(key[order]), np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    live, size = order[_grouped(new)], 1
    while len(live):
        after = live + size
        second = np.where(after < stop[live], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + second
        by = np.argsort(key)
        live, key = live[by], key[by]
        r, at = key // (n + 1), np.arange(len(live))
        new = _starts(key)
        rank[live] = r + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(_starts(r), at, 0))
        live, size = live[_grouped(new)], size * 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    return array


def _match(words: np.ndarray, stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words two places of one text have in common; `a` and `b` pair by pair."""
    out, room = np.zeros(len(a), np.int64), np.minimum(stop[a] - a, stop[b] - b)
    left = np.flatnonzero(room > 0)
    while len(left):
        # The fewer pairs are left, the more words of each are compared at once.
        step = int(np.clip((1 << 16) // len(left), 4, 1 << 14))
        ahead = out[left, None] + np.arange(step)
        inside = ahead < room[left, None]
        ahead = np.minimum(ahead, room[left, None] - 1)
        same = inside & (words[a[left, None] + ahead] == words[b[left, None] + ahead])
        equal = np.where(same.all(axis=1), step, same.argmin(axis=1))
        out[left] += equal
        left = left[equal == step]
    return out


def common_prefixes(words: np.ndarray, stop: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each suffix of the array, the words that it shares with the one before it of the same text; 0 without one."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    pair = np.flatnonzero(stop[array[1:]] == stop[array[:-1]])
    before[array[pair + 1]] = array[pair]
    # Is the place one further on than the place before it, and so is its neighbour?
    goes_on = np.zeros(n, bool)
    here = np.flatnonzero(before > 0)
    here = here[here > 0]
    there = before[here]
    goes_on[here] = (stop[here - 1] == stop[here]) & (stop[there - 1] == stop[there]) & (words[here - 1] == words[there - 1])
    by_place = np.zeros(n, np.int64)
    fresh = np.flatnonzero((before >= 0) & ~goes_on)
    by_place[fresh] = _match(words, stop, fresh, before[fresh])
    last = np.maximum.accumulate(np.where(goes_on, 0, np.arange(n)))
    return (by_place[last] - (np.arange(n) - last))[array]


def longest_shared(words: np.ndarray, stop: np.ndarray, array: np.ndarray | None = None, common: np.ndarray | None = None) -> np.ndarray:
    """For each place, the most words that its suffix shares with another of its text: the length of its innermost interval."""
    array = suffix_array(words, stop) if array is None else array
    common = common_prefixes(words, stop, array) if common is None else common
    out = np.zeros(len(words), np.int64)
    out[array] = np.maximum(common, np.append(common[1:], 0)) if len(words) else 0
    return out


def maximal_repeats(words: np.ndarray, stop: np.ndarray, array: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """(low, high, length) of the intervals low..high of the array whose suffixes share `length` words, `least` or more, and
    neither more to the right nor more to the left."""
    n = len(array)
    if n == 0:
        return np.zeros((0, 3), np.int64)
    # Differences between the words before neighbours; a text's first place has none and differs from all.
    first = np.ones(n, bool)
    first[1:] = stop[1:] != stop[:-1]
    prior = np.where(first[array], -1 - array, words[array - 1])
    changes = np.concatenate([[0], np.cumsum(prior[1:] != prior[:-1])])
    found: list[tuple[int, int, int]] = []
    deep = np.flatnonzero(common >= least)
    for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else []:
        open_: list[tuple[int, int]] = []
        lengths = common[run].tolist()
        for at, length in zip([*run.tolist(), int(run[-1]) + 1], [*lengths, 0], strict=True):
            low = at - 1
            while open_ and open_[-1][1] > length:
                low, size = open_.pop()
                found.append((low, at - 1, size))
            if length and (not open_ or open_[-1][1] < length):
                open_.append((low, length))
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[changes[out[:, 1]] > changes[out[:, 0]]]


def _covered(shared: np.ndarray, least: int) -> np.ndarray:
    """Positions within a repeat of `least` words or more: the union of the repeats' spans."""
    at = np.flatnonzero(shared >= least)
    edge = np.zeros(len(shared) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + shared[at], -1)
    return np.cumsum(edge[:-1]) > 0


def _duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    count = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            count += line in seen
            seen.add(line)
    return count


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts, one after another, and how many words each text has."""
    split = [t.encode("utf-8", "replace").split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for t in split for w in t), np.int64, int(sizes.sum())), sizes


def repeats(docs: DataFrame, least: int = MIN_REPEAT, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) with first, words and times of every maximal repeat of a text: the first word (from 0)
    of its first place, its length, and at how many places it stands. A row for each."""
    keep = [k for k in keep or ["doc_id"] if k not in ("first", "words", "times")]
    schema = docs.select(*keep).schema.add("first", "long").add("words", "long").add("times", "long")

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            words, sizes = _numbered([t or "" for t in piece["text"].to_pylist()])
            ends = np.cumsum(sizes)
            stop = np.repeat(ends, sizes)
            array = suffix_array(words, stop)
            found = maximal_repeats(words, stop, array, common_prefixes(words, stop, array), least)
            first = np.array([array[low : high + 1].min() for low, high, _ in found], np.int64)
            text = np.searchsorted(ends, first, side="right")
            cols = [pa.array(first - (ends - sizes)[text]), pa.array(found[:, 2]), pa.array(found[:, 1] - found[:, 0] + 1)]
            return pa.record_batch([*[piece[k].take(pa.array(text)) for k in keep], *cols], [*keep, "first", "words", "times"])

        return work

    return map_slices(docs.select(*dict.fromkeys([*keep, "text"])), "text", make, schema)


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) with the base counts, covered_words, n_repeats and longest_repeat of the method,
    base_failed and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "n_repeats", "longest_repeat"]
    keep = [k for k in keep or ["doc_id"] if k not in (*names, "base_failed", "kept")]
    schema = docs.select(*keep).schema
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean")

    def make():
        breaks = {ord(c): None for c in " \t\n\v\f\r"}

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in piece["text"].to_pylist()]
            words, sizes = _numbered(texts)
            ends = np.cumsum(sizes)
            stop = np.repeat(ends, sizes)
            array = suffix_array(words, stop)
            common = common_prefixes(words, stop, array)
            found = maximal_repeats(words, stop, array, common, MIN_REPEAT)
            shared = longest_shared(words, stop, array, common)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
            of, longest = np.searchsorted(ends, array[found[:, 0]], side="right"), np.zeros(len(texts), np.int64)
            np.maximum.at(longest, of, found[:, 2])
            number = np.bincount(of, minlength=len(texts))
            repeated, covered = total(_covered(shared, BASE_WINDOW)), total(_covered(shared, MIN_REPEAT))
            chars = [len(t.translate(breaks)) for t in texts]
            marks = [sum(map(t.count, SYMBOLS)) for t in texts]
            lines = [_duplicate_lines(t) for t in texts]
            failed = (sizes < 10) | (100 * repeated > 20 * sizes)
            good = ~failed & (covered <= MAX_COVERED * sizes) & (longest <= MAX_LONGEST)
            cols = [sizes, np.array(chars, np.int64), np.array(marks, np.int64), np.array(lines, np.int64), repeated, covered, number, longest]
            return pa.record_batch([*[piece[k] for k in keep], *map(pa.array, cols), pa.array(failed), pa.array(good)], [*keep, *names, "base_failed", "kept"])

        return work

    return map_slices(docs.select(*dict.fromkeys([*keep, "text"])), "text", make, schema)

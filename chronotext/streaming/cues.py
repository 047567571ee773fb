"""Stateful operators on streams of cues and frames; these go beyond the reference, which has no streams.

State is kept by video: the last text that was let through, or the keyframe and its candidate. Rows of a micro-batch are
ordered by `seq` (or `idx`) within their video; a video's rows must arrive in that order from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronotext import model


def drop_repeats_stream(cues: DataFrame) -> DataFrame:
    """Cues (video_id, seq, t, text) whose text differs from the one before, across micro-batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        before = rows["text"].shift(1)
        if len(rows):
            before.iloc[0] = last
        first = not state.exists
        keep = rows["text"] != before
        if first and len(rows):
            keep.iloc[0] = True
        if len(rows):
            state.update((rows["text"].iloc[-1],))
        yield rows[keep]

    return cues.groupBy("video_id").applyInPandasWithState(step, model.SEGMENTS, "text string", "append", GroupStateTimeout.NoTimeout)


def keyframes_stream(frames: DataFrame, distance: int = model.PHASH_DISTANCE, persistence: int = model.PHASH_PERSISTENCE) -> DataFrame:
    """(video_id, idx) of keyframes of a stream (video_id, idx, phash), each as soon as its persistence is reached."""
    need, mask = max(persistence, 1), (1 << 64) - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, candidate, at, run = state.get if state.exists else (None, None, None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("idx")
        for i, h in zip(rows["idx"].tolist(), rows["phash"].tolist(), strict=True):
            if current is None:
                current = h
                out.append(i)
            elif ((current ^ h) & mask).bit_count() <= distance:
                candidate, run = None, 0
            else:
                if candidate is None or ((candidate ^ h) & mask).bit_count() > distance:
                    candidate, at, run = h, i, 0
                run += 1
                if run >= need:
                    out.append(at)
                    current, candidate, run = candidate, None, 0
        if current is not None:
            state.update((current, candidate, at, run))
        yield pd.DataFrame({"video_id": [key[0]] * len(out), "idx": pd.Series(out, dtype="int32")})

    return frames.groupBy("video_id").applyInPandasWithState(step, "video_id string, idx int", "cur long, cand long, at int, run int", "append", GroupStateTimeout.NoTimeout)

"""Order-dependent folds over one stream: drift-free rescaling and stable increments.

Rows are dealt by stream and block of packets and sorted within partitions; a task holds one
running value or one small function, so a stream of any length needs no memory and many
tasks share it.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timebase import delta_range, delta_step, stable_step

#: Rows of a timeline that are put out at once.
BLOCK = 10_000


class Entry:
    """What a block of packets makes of the state it is entered with, for every such state at once.

    A step leaves a state as it is but for the duration where it lies within the rounding
    range of the timestamp, moves it to the nearer end of that range where it lies close by,
    and forgets it otherwise. So after any number of steps the result is the entered state
    plus a shift on one interval, and constants beside it: ``cuts`` are the first states of
    each piece but the first, ``values`` its constants (None: entered state plus ``shift``).
    """

    __slots__ = ("cuts", "values", "shift")

    def __init__(self):
        self.cuts, self.values, self.shift = [], [None], 0

    def step(self, ts: int, duration: int, bases: tuple) -> None:
        fixed: dict[int, int] = {}

        def after(x: int) -> int:
            if x not in fixed:
                fixed[x] = delta_step(ts, duration, x, *bases)[1]
            return fixed[x]

        edges = delta_range(ts, duration, *bases)
        forgotten = delta_step(ts, duration, None, *bases)[1]
        cuts, values = [], []
        starts = [None, *self.cuts]
        for k, value in enumerate(self.values):
            low, high = starts[k], self.cuts[k] if k < len(self.cuts) else None
            if value is not None:
                found = [(low, after(value))]
            elif edges is None:
                found = [(low, forgotten)]
            else:  # the piece that shifts falls into five
                outer, first, last, end = (e - self.shift for e in edges)
                parts = [(None, forgotten), (outer, edges[1] + duration), (first, None), (last + 1, edges[2] + duration), (end + 1, forgotten)]
                found = [(low if s is None or low is not None and s < low else s, v) for (s, v), (e, _) in zip(parts, [*parts[1:], (None, None)]) if (e is None or low is None or e > low) and (s is None or high is None or s < high)]
            for s, v in found:
                if values and values[-1] == v and v is not None:
                    continue
                if values:
                    cuts.append(s)
                values.append(v)
        self.cuts, self.values, self.shift = cuts, values, self.shift + duration

    def __call__(self, state: int) -> int:
        value = self.values[bisect_right(self.cuts, state)]
        return state + self.shift if value is None else value


def _folded(rows: DataFrame, kind: str, bases: tuple) -> DataFrame:
    """Timestamps of ``rows`` dealt by stream and block, each block entered with its ``entry``."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for frame in frames:
            out = []
            for f, s, block, ts, duration, entry in zip(*(frame[c] for c in ("file_id", "stream_index", "block", "pts", "duration", "entry"))):
                if (f, s, block) != now:
                    now, last = (f, s, block), None if pd.isna(entry) else int(entry)
                value, last = delta_step(int(ts), int(duration), last, *bases)
                out.append(value)
            yield frame[["file_id", "stream_index", "packet_index"]].assign(pts=out)

    dealt = rows.repartition("file_id", "stream_index", "block").sortWithinPartitions("file_id", "stream_index", "block", "packet_index")
    return dealt.mapInPandas(fold, f"file_id {kind}, stream_index int, packet_index bigint, pts bigint")


def _entries(rows: DataFrame, kind: str, bases: tuple) -> DataFrame:
    """``file_id, stream_index, block, entry`` of all blocks but a stream's first: blocks are summed up as functions side by side, then these are put one after another."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made, first = None, None, None

        def row() -> tuple:
            return *now, json.dumps([made.cuts, made.values, made.shift]), first

        for frame in frames:
            done = []
            for f, s, block, ts, duration in zip(*(frame[c] for c in ("file_id", "stream_index", "block", "pts", "duration"))):
                if (f, s, block) != now:
                    if now is not None:
                        done.append(row())
                    now, made, first = (f, s, block), Entry(), None
                made.step(int(ts), int(duration), bases)
                first = delta_step(int(ts), int(duration), first, *bases)[1]
            yield pd.DataFrame(done, columns=["file_id", "stream_index", "block", "made", "first"])
        if now is not None:
            yield pd.DataFrame([row()], columns=["file_id", "stream_index", "block", "made", "first"])

    def chained(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        state, out = None, []
        for made, first in zip(group["made"], group["first"]):
            out.append(state)
            if state is None:
                state = int(first)
            else:
                e = Entry()
                e.cuts, e.values, e.shift = json.loads(made)
                state = e(state)
        return group[["file_id", "stream_index", "block"]].assign(entry=pd.Series(out, index=group.index, dtype="Int64"))

    dealt = rows.repartition("file_id", "stream_index", "block").sortWithinPartitions("file_id", "stream_index", "block", "packet_index")
    made = dealt.mapInPandas(summed, f"file_id {kind}, stream_index int, block bigint, made string, first bigint")
    return made.groupBy("file_id", "stream_index").applyInPandas(chained, f"file_id {kind}, stream_index int, block bigint, entry bigint").where("entry is not null")


def rescale_delta(packets: DataFrame, in_tb: tuple[int, int], fs_tb: tuple[int, int], out_tb: tuple[int, int], block: int = 1 << 16) -> DataFrame:
    """``file_id, stream_index, packet_index, pts``: timestamps in ``out_tb`` that follow the durations while these agree.

    A stream is cut into blocks of packet numbers, so that one of any length is folded by
    many tasks. Streams of one block are folded at once; of longer ones every block is first
    turned into a function of the state it is entered with, and these (one small row a
    block) give the states. Packets have a timestamp and a duration, file_id isn't null.
    """
    kind, bases = packets.schema["file_id"].dataType.simpleString(), (in_tb, fs_tb, out_tb)
    key = ["file_id", "stream_index"]
    rows = packets.select("file_id", F.col("stream_index").cast("int").alias("stream_index"), F.col("packet_index").cast("bigint").alias("packet_index"), "pts", "duration", F.floor(F.col("packet_index") / block).alias("block"))
    spans = rows.groupBy(*key).agg(F.min("block").alias("_first"), F.max("block").alias("_last")).where("_first < _last")
    several = rows.join(spans.select(*key), key, "left_semi")
    entered = rows.join(_entries(several, kind, bases), [*key, "block"], "left")
    return _folded(entered, kind, bases)


def stable_timeline(streams: DataFrame, ts_tb: tuple[int, int], inc_tb: tuple[int, int], count: str = "count", start: str = "start") -> DataFrame:
    """``file_id, stream_index, n, ts``: ``count`` repeated increments from ``start``, without drift."""
    key = streams.schema["file_id"].dataType.simpleString()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f, s, n, ts in frame.itertuples(index=False, name=None):
                rows = []
                for i in range(int(n)):
                    ts = stable_step(int(ts), ts_tb, inc_tb)
                    rows.append((f, s, i, ts))
                    if len(rows) == BLOCK or i == n - 1:
                        yield pd.DataFrame(rows, columns=["file_id", "stream_index", "n", "ts"])
                        rows = []

    return streams.select("file_id", "stream_index", count, start).mapInPandas(fold, f"file_id {key}, stream_index int, n bigint, ts bigint")

"""Best-fit packing with length patterns fitted by non-negative least squares.

1. Texts become pieces of at most ``limit`` tokens; from here on only a piece's place,
   length and checksum travel.
2. The histogram of lengths, at most ``limit`` numbers however many documents there are,
   goes to the driver. Lengths are binned, every pattern of one to three bins that fills a
   sequence is enumerated, and the patterns' repeat counts are fitted to the histogram by
   non-negative least squares and rounded down to what is there.
3. What is left is packed on the histogram too: longest first, each into the fullest
   sequence that still has room, those of the patterns included.
4. The plan says, for each length, which ranks of that length go where. Pieces get their
   rank within their length through salted groups and look their place up; the plan's size
   depends on ``limit`` alone.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Bins of lengths that patterns are made of, and documents in a pattern.
BINS, MOST_DOCS = 256, 3
#: Pieces that one salted group of a length is meant to hold.
GROUP_ROWS = 50_000
#: Texts of these characters alone are read by the faster library (see ``Ids``).
COMMON = regex.compile(r"[\x00-\u0377\u0400-\u052f\u2010-\u2027\u2030-\u205e\u20ac]*+")


class Ids:
    """Token ids of a text as the vocabulary file's own library gives them.

    ``ranks`` names the same vocabulary as a rank file, whose library is some four times
    faster. The two agree on how characters are classed in the long-settled blocks of
    COMMON; any other text, and a very long one, goes to the first library.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.own.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and len(text) < 500_000 and COMMON.fullmatch(text):
            return self.fast.encode(text, allowed_special="all")
        return self.own.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def ids_of(path: str, ranks: str | None, pattern: str | None) -> Ids:
    return Ids(path, ranks, pattern)


def pieces(docs: DataFrame, path: str, limit: int, end_id: int = 0, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents with their end token, cut where longer than ``limit``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path, ranks, pattern)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.array([*encode(value.as_py()), end_id], dtype="<u4")
                first = (len(ids) - 1) % limit + 1
                for k, at in enumerate([0, *range(first, len(ids), limit)]):
                    part = ids[at : at + limit if k else first]
                    row.append(i), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(bins: int = BINS, most_docs: int = MOST_DOCS) -> list[tuple[int, ...]]:
    """Every multiset of one to ``most_docs`` bins that fills a sequence, longest first."""
    found: list[tuple[int, ...]] = []

    def grow(taken: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(taken)
        elif len(taken) < most_docs:
            for b in range(min(left, taken[-1] if taken else bins), 0, -1):
                if b * (most_docs - len(taken)) >= left:
                    grow((*taken, b), left - b)

    grow((), bins)
    return found


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Non-negative least squares by active sets: min |a x - b| with x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(most or 3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        if (k := int(gain.argmax())) is None or gain[k] <= scale:
            break
        active[k] = True
        while True:
            at = np.nonzero(active)[0]
            part = a[:, at]
            try:
                s = np.linalg.solve(part.T @ part, part.T @ b)
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(part, b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            x[gone], active[gone] = 0, False
    return x


class Plan:
    """Runs of equally filled sequences, and for each length which of its ranks go where."""

    def __init__(self, limit: int, histogram: dict[int, int]):
        self.limit, self.left = limit, np.zeros(limit + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.runs: list[tuple[int, list[tuple[int, int]]]] = []  # (sequences, [(length, how many)])
        self._fit_patterns()
        self._best_fit()

    def _fit_patterns(self) -> None:
        width = -(-self.limit // BINS)
        bins = -(-self.limit // width)
        tall = np.zeros(bins, np.int64)
        np.add.at(tall, -(-np.arange(1, self.limit + 1) // width) - 1, self.left[1:])
        kinds = patterns(bins)
        a = np.zeros((bins, len(kinds)))
        for k, kind in enumerate(kinds):
            for b in kind:
                a[b - 1, k] += 1
        repeats = np.floor(nnls(a, tall.astype(float)) + 1e-6).astype(np.int64)
        by_bin = {b: [n for n in range(min(b * width, self.limit), (b - 1) * width, -1)] for b in range(1, bins + 1)}
        for k in np.argsort(-repeats, kind="stable"):
            need = defaultdict(int)
            for b in kinds[k]:
                need[b] += 1
            n = min([int(repeats[k]), *(int(tall[b - 1]) // m for b, m in need.items())])
            if n <= 0:
                continue
            for b, m in need.items():
                tall[b - 1] -= n * m
            self._exact(kinds[k], n, by_bin)

    def _exact(self, kind: tuple[int, ...], n: int, by_bin: dict[int, list[int]]) -> None:
        """Turn n repeats of a bin pattern into runs of exact lengths."""
        while n:
            lengths: list[int] = []
            for b in kind:
                lengths.append(next(x for x in by_bin[b] if self.left[x] > lengths.count(x)))
            t = min([n, *(int(self.left[x]) // lengths.count(x) for x in set(lengths))])
            for x in lengths:
                self.left[x] -= t
            self.runs.append((t, [(x, 1) for x in lengths]))
            n -= t

    def _best_fit(self) -> None:
        room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
        for t, held in self.runs:
            room[self.limit - sum(x * m for x, m in held)].append((t, held))
        for length in range(self.limit, 0, -1):
            n = int(self.left[length])
            while n:
                free = next((f for f in range(length, self.limit) if room[f]), None)
                if free is None:
                    t, held, free = n, [], self.limit
                else:
                    t, held = room[free].pop()
                per = min(free // length, n)
                full = min(t, n // per)
                if t > full and held:
                    room[free].append((t - full, held))
                room[free - per * length].append((full, [*held, (length, per)]))
                n -= full * per
        self.left[:] = 0
        self.runs = [run for f in sorted(room) for run in room[f]]

    def slots(self) -> np.ndarray:
        """Rows (length, first rank, how many, per sequence, first sequence, offset), by length and rank."""
        rank, rows, sequence = np.zeros(self.limit + 1, np.int64), [], 0
        for t, held in self.runs:
            offset = 0
            for length, per in held:
                rows.append((length, rank[length], t * per, per, sequence, offset))
                rank[length] += t * per
                offset += length * per
            sequence += t
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def packed(parts: DataFrame, limit: int) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces (``doc_id, piece, start, length, ids_crc32``)."""
    total = parts.count()
    groups = max(1, -(-total // GROUP_ROWS))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialise(counts.select("length", "salt", "n", before.alias("before")), "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Plan(limit, histogram).slots()
    key = slots[:, 0] << 44 | slots[:, 1]

    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32")) - 1
    ranked = salted.join(counts.drop("n"), ["length", "salt"]).withColumn("rank", F.col("before") + own).drop("salt", "before")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            slot = slots[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth, place = np.divmod(rank - slot[:, 1], slot[:, 3])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(slot[:, 4] + nth), pa.array(slot[:, 5] + place * length)], [*names, "sequence_id", "offset"])

    kind = parts.schema["doc_id"].dataType.simpleString()
    return ranked.select(*names, "rank").mapInArrow(put, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every whole text with its sequence and offset there.

    Null texts count as empty and hold just the end token. Rows that repeat an id are
    packed each; their pieces are told apart by their places only. A null id is kept.
    Longer documents are cut into pieces of ``limit`` tokens, of which the first may be
    shorter. With ``ranks``, texts of long-settled characters below half a million of them
    are read by the faster library of the same vocabulary, any other by the vocabulary
    file's own; a test holds both to the same ids, character by character.
    An empty table gives an empty result; other columns are ignored.
    """
    return packed(materialise(pieces(docs, path, limit, end_id, ranks, pattern, id_col, text_col), "pieces"), limit)

"""SimHash near-duplicates, linked exactly through vantage-point trees.

1. One pass makes a 64-bit fingerprint of every text; equal fingerprints fold into one.
2. A shallow vantage-point tree, built from a bounded sample, partitions the fingerprints
   by Hamming distance into shards. A fingerprint lives in one shard and visits each later
   shard that a triangle bound (radius 4) cannot rule out, so each pair within the radius
   meets in exactly one shard. The sample decides only where the cuts lie.
3. Shards over a set size are split into chunks, and a shard's rows visit its later chunks.
   Inside a chunk a local tree prunes by the same bounds; leaves compare in numpy blocks.
   A chunk emits each class it finds as a star, never all of its pairs.
4. Components of these stars give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import materialise

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints that a shard is meant to hold; a chunk holds no more than twice as many of its own.
SHARD_ROWS = 16_384
#: Fingerprints from which the upper tree is built, and the most shards it may have.
SAMPLE_ROWS, MOST_SHARDS = 32_768, 4_096
#: Visitors that meet a chunk's rows in one group, in multiples of ``SHARD_ROWS``.
SLICE_CHUNKS = 8
#: Pairs that one numpy block compares.
BLOCK_PAIRS = 1 << 20


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash over word shingles of the text with A-Z lower-cased."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    width = min(width, len(words))
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long); null texts count as empty: fp 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return rows.mapInArrow(make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def distance(points: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ one)


class ShardTree:
    """The upper tree as arrays in heap order: node i has the children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, shards)))))
        inner = (1 << self.depth) - 1
        self.vantage, self.cut = np.zeros(inner, np.uint64), np.zeros(inner, np.int64)
        held = {0: sample}
        for i in range(inner):
            points = held.pop(i)
            if len(points):
                tried = [(np.var(d := distance(points, v)), -k, v, d) for k, v in enumerate(points[:: max(1, len(points) // 8)][:8])]
                _, _, self.vantage[i], d = max(tried, key=lambda t: t[:2])
                self.cut[i] = int(np.median(d))
                near = d <= self.cut[i]
            else:
                near = np.zeros(0, bool)
            held[2 * i + 1], held[2 * i + 2] = points[near], points[~near]

    def home(self, points: np.ndarray) -> np.ndarray:
        """The shard in which each point lives."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.bitwise_count(points ^ self.vantage[node]) > self.cut[node])
        return node - ((1 << self.depth) - 1)

    def visits(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard with the indexes of the points that live in an earlier one but may be within radius of its own."""
        home, inner = self.home(points), (1 << self.depth) - 1
        stack = [(0, 0, np.arange(len(points)))]
        while stack:
            i, level, at = stack.pop()
            if not len(at):
                continue
            if level == self.depth:
                yield i - inner, at[home[at] < i - inner]
                continue
            d = distance(points[at], self.vantage[i]).astype(np.int64)
            for child, may in ((2 * i + 1, d <= self.cut[i] + radius), (2 * i + 2, d > self.cut[i] - radius)):
                last = (child + 2 << self.depth - level - 1) - 2 - inner  # the child's last shard
                stack.append((child, level + 1, at[may & (home[at] <= last)]))


class Classes:
    """Union-find over the points of one chunk."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            a, b = self.root(a), self.root(b)
            self.up[max(a, b)] = min(a, b)


def link_block(points: np.ndarray, rows: np.ndarray, asks: np.ndarray, radius: int, classes: Classes) -> None:
    """Join every row with every asking point within the radius of it."""
    step = max(1, BLOCK_PAIRS // max(1, len(rows)))
    for k in range(0, len(asks), step):
        part = asks[k : k + step]
        near = np.bitwise_count(points[part][:, None] ^ points[rows][None, :]) <= radius
        some = near.any(axis=1)
        first = np.stack([part[some], rows[near[some].argmax(axis=1)]], axis=1)
        classes.join(first[first[:, 0] != first[:, 1]])
        roots = classes.roots()
        rest = near & (roots[part][:, None] != roots[rows][None, :])
        if rest.any():
            i, j = np.nonzero(rest)
            classes.join(np.unique(np.stack([roots[part[i]], roots[rows[j]]], axis=1), axis=0))


def link_chunk(points: np.ndarray, own: np.ndarray, radius: int, within: bool = True) -> Classes:
    """Classes of the points, linking own points with visitors and, if ``within``, with each other; visitors aren't compared with each other."""
    classes = Classes(len(points))
    stack = [(np.nonzero(own)[0], np.arange(len(points)) if within else np.nonzero(~own)[0])]
    while stack:
        rows, asks = stack.pop()
        if not len(rows) or not len(asks):
            continue
        if len(rows) <= 256:
            link_block(points, rows, asks, radius, classes)
            continue
        vantage = points[rows[len(rows) // 2]]
        d, e = distance(points[rows], vantage).astype(np.int64), distance(points[asks], vantage).astype(np.int64)
        cut = int(np.median(d))
        if (d <= cut).all():
            cut = int(d.max()) - 1
        near = d <= cut
        if not near.any():
            link_block(points, rows, asks, radius, classes)
            continue
        stack += [(rows[near], asks[e <= cut + radius]), (rows[~near], asks[e > cut - radius])]
    return classes


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``u, v``: stars over all of ``distinct(fp)`` that join exactly what lies within ``radius`` of each other, link by link."""
    n = distinct.count()
    shards = min(MOST_SHARDS, 1 << max(0, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    sample = [r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_ROWS).collect()] if shards > 1 else []
    tree = ShardTree(np.array(sample, dtype=np.int64).view(np.uint64), shards)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.home(b.column(0).to_numpy().view(np.uint64)))], ["shard"])

    counts = {r.shard: r["count"] for r in distinct.select("fp").mapInArrow(homes, "shard bigint").groupBy("shard").count().collect()}
    chunks = np.ones(1 << tree.depth, np.int64)
    for shard, rows in counts.items():
        chunks[shard] = -(-rows // (2 * shard_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            points = fps.view(np.uint64)
            home = tree.home(points)
            chunk = ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % chunks[home]
            yield sent(home, chunk, fps, True)
            for c in range(1, int(chunks[home].max(initial=1))):
                later = np.nonzero((chunks[home] > c) & (chunk < c))[0]
                if len(later):
                    yield sent(home[later], np.full(len(later), c), fps[later], False)
            for shard, at in tree.visits(points, radius):
                for c in range(chunks[shard] if len(at) else 0):
                    yield sent(np.full(len(at), shard), np.full(len(at), c), fps[at], False)

    def sent(shard: np.ndarray, chunk: np.ndarray, fps: np.ndarray, own: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(chunk), pa.array(fps), pa.array(np.full(len(fps), own))], ["shard", "chunk", "fp", "own"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy()
        up = link_chunk(fps.view(np.uint64), rows["own"].to_numpy(), radius, bool((rows["slice"] == 0).all())).roots()
        moved = np.nonzero(up != np.arange(len(fps)))[0]
        return pd.DataFrame({"u": fps[moved], "v": fps[up[moved]]})

    routed = distinct.select("fp").mapInArrow(route, "shard bigint, chunk bigint, fp bigint, own boolean")
    return sliced(materialise(routed, "simhash-routed"), SLICE_CHUNKS * shard_rows).groupBy("shard", "chunk", "slice").applyInPandas(link, "u bigint, v bigint")


def sliced(routed: DataFrame, most: int) -> DataFrame:
    """Adds ``slice``: a chunk's visitors are dealt over as many slices as keep each near ``most``, its own rows are in all of them.

    So no group holds more than a chunk's own rows and about ``most`` visitors, however
    many fingerprints visit a shard.
    """
    visitors = routed.where("not own").groupBy("shard", "chunk").agg(F.ceil(F.count("*") / most).cast("int").alias("slices"))
    each = routed.join(visitors, ["shard", "chunk"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = each.where("own").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    others = each.where("not own").withColumn("slice", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    return own.unionByName(others).drop("slices")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    component_id is the smallest doc_id that a row reaches over links of at most
    ``radius`` differing bits, its own included. Null or wordless texts have fingerprint
    zero and are linked like any other. Rows with a null id are classed too; their id is
    never the smallest unless a class has no other. Repeated rows come back as often as
    they came; an empty table gives an empty result; extra columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash")
    roots = components(links(distinct, radius, shard_rows))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = rooted.join(classes, "root").select("fp", "component_id")
    return prints.join(classed, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Near-duplicates by exact Jaccard similarity of word shingles, candidates from SimHash trees and MinHash bands.

The pipeline's form of near-duplicate removal: candidates come from op4's method first,
fingerprints linked through vantage-point trees, and every one is checked exactly. At a
similarity of 0.8, fingerprints of 64 bits differ in some ten bits and up to about twenty,
where the triangle bounds of vantage-point trees rule out nothing, so candidates that the
trees' 4 bits miss come from bands of minimum hashes.

1. One pass makes every text's shingle set and fingerprint; equal sets fold into one node.
   A node has BANDS keys of ROWS minimum hashes each. Two nodes that share a key are
   candidates: a pair with similarity s shares none with probability (1 - s^ROWS)^BANDS,
   which is 6 in 100,000 at 0.8 and falls quickly above.
2. Fingerprints within 4 bits are linked by ``simhash.links``. Each node is compared with
   the first one of its fingerprint, the first ones of linked fingerprints with each other,
   and each node with the leader of each of its buckets, by exact intersection of the
   sets; nodes linked to the same leader are one class, as are most buckets then.
3. Buckets that still hold several classes are cut into chunks of a set volume, and each
   two chunks meet in one task that intersects all their sets across classes by matrix
   products. A task puts out a spanning forest of the links it finds, never its pairs.
   So every candidate pair of the bands is compared itself or lies in one class already.
4. Components of all links give the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .storage import materialise, remove_table

SHINGLE = 5
#: The least similarity, in fifths, so that the comparison is one of whole numbers.
FIFTHS = 4
BANDS, ROWS = 32, 6
#: Shingles that a chunk of a bucket is meant to hold, and distinct ones that one matrix product counts.
CHUNK_VOLUME, SLAB = 250_000, 2048
SEED = 42
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z lower-cased; a shorter text is one shingle, a wordless one has none."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """The bucket keys of a shingle set."""
    if not len(found):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 512):  # a long text in blocks that stay in the cache
        np.minimum(least, (found[None, k : k + 512] * _FACTORS[:, :1] + _FACTORS[:, 1:]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def _alike(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 5 >= F.greatest(n, m) * FIFTHS


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose sets have the least similarity or more."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    return both.where(common * (5 + FIFTHS) >= total * FIFTHS).select("u", "v")  # common / (total - common) >= FIFTHS / 5


def _led(links: DataFrame) -> DataFrame:
    """``node, root`` of linked nodes: the first leader that a node is linked to, two links on; equal roots are in one class."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    one = materialise(both.groupBy("u").agg(F.least(F.min(order("v")), F.first(order("u"))).alias("lead")).select(F.col("u").alias("node"), F.col("lead.node").alias("lead")), "near-led")
    return one.join(one.select(F.col("node").alias("lead"), F.col("lead").alias("root")), "lead").select("node", "root")


def crossing(nodes: np.ndarray, roots: np.ndarray, chunk: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, over classes ``roots``, of the similar sets of different classes; of two chunks only sets of different ones are compared."""
    n = np.array([len(s) for s in sets])
    left, right = np.nonzero(chunk == chunk.min())[0], np.nonzero(chunk == chunk.max())[0]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), n), times >= 2  # what only one set holds is common to none
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(shared.sum()), SLAB):
        a, b = np.searchsorted(column, [first, first + SLAB])
        held = np.zeros((len(sets), SLAB), np.float32)
        held[row[a:b], column[a:b] - first] = 1.0
        common += held[left] @ held[right].T
    like = common * (5 + FIFTHS) >= (n[left][:, None] + n[right][None, :]) * FIFTHS
    like &= roots[left][:, None] != roots[right][None, :]
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.get(i, i) != i:
            i = up[i]
        return i

    found = []
    for i, j in zip(*np.nonzero(like)):
        u, v = int(left[i]), int(right[j])
        if (a := root(int(roots[u]))) != (b := root(int(roots[v]))):
            up[max(a, b)] = min(a, b)
            found.append((int(nodes[u]), int(nodes[v])))
    return found


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    sets = [np.asarray(s) for s in rows["shingles"]]
    return pd.DataFrame(crossing(rows["node"].to_numpy(), rows["root"].to_numpy(), rows["chunk"].to_numpy(), sets), columns=["u", "v"], dtype=np.int64)


def tree_candidates(nodes: DataFrame) -> DataFrame:
    """``u, v`` over ``nodes(node, n, fp)`` whose sizes let them be similar: by vantage-point trees over the fingerprints, whose classes come as stars."""
    first = materialise(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("f")), "near-fps")
    same = nodes.join(first, "fp").select("node", "n", F.col("f.node").alias("other"), F.col("f.n").alias("m"))
    of = lambda c, node, n: first.select(F.col("fp").alias(c), F.col("f.node").alias(node), F.col("f.n").alias(n))
    linked = simhash.links(first.select("fp")).join(of("u", "node", "n"), "u").join(of("v", "other", "m"), "v").select("node", "n", "other", "m")
    return same.unionByName(linked).where("node != other").where(_alike(F.col("n"), F.col("m"))).select(F.col("node").alias("u"), F.col("other").alias("v"))


def near_links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``u, v`` over ``nodes(node, n, bands, fp)``: links of similar sets that join all similar candidates."""
    treed = materialise(tree_candidates(nodes.select("node", "n", "fp")), "near-treed")
    spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    leads = spread.groupBy("bucket").agg(F.count("*").alias("rows"), F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("lead")).where("rows > 1")
    rows = materialise(spread.join(leads, "bucket").select("bucket", "node", "n", F.col("lead.node").alias("other"), F.col("lead.n").alias("m")), "near-buckets")
    ends = treed.select(F.explode(F.array("u", "v")).alias("node"))
    sets = materialise(sets_of(rows.select("node").unionByName(ends).distinct()), "near-sets")
    banded = rows.where("node != other").where(_alike(F.col("n"), F.col("m"))).select(F.col("node").alias("u"), F.col("other").alias("v"))
    tried = treed.unionByName(banded).distinct()
    links = materialise(_verified(tried, sets), "near-links")

    classed = materialise(rows.select("bucket", "node", "n").join(_led(links), "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root")), "near-classes")
    held = classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"), F.sum("n").alias("volume"), F.bit_xor(F.xxhash64("node")).alias("all")).where("low < high")
    # buckets with the same nodes are compared once
    several = held.groupBy("all", "rows", "volume").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("volume") / CHUNK_VOLUME).cast("int").alias("chunks"))
    dealt = classed.join(several, "bucket").withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("chunks")).cast("int"))
    pairs = dealt.select("bucket", "node", "root", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    pairs = pairs.select("bucket", "node", "root", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")).join(sets, "node")
    across = materialise(pairs.groupBy("bucket", "low", "high").applyInPandas(_meet, "u bigint, v bigint"), "near-links")
    for table in (rows, sets, classed):
        remove_table(table)
    return links.unionByName(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` for every row.

    component_id is the smallest doc_id that a row reaches over links of texts whose
    five-word shingle sets have a Jaccard similarity of 0.8 or more, its own included.
    Null texts count as empty; wordless texts are alike. Rows with a null id are classed
    too; their id is never the smallest unless a class has no other. Repeated rows come
    back as often as they came; an empty table gives an empty result; other columns are not
    looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, keys, fps = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                fps.append(simhash.fingerprint(text.as_py()))
                node.append(xxhash.xxh64_intdigest(found.tobytes(), SEED)), n.append(len(found)), keys.append(np.array(bands(found), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text", "node", "n", "bands", "fp"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], ["node", "shingles"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        return prints.select("node", "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")).mapInArrow(split, "node bigint, shingles array<bigint>")

    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = materialise(rows.mapInArrow(make, f"doc_id {kind}, text string, node bigint, n int, bands array<bigint>, fp bigint"), "near-prints")
    least = materialise(prints.groupBy("node").agg(F.min("doc_id").alias("least")), "near-nodes")
    # texts of one shingle set may repeat shingles differently and have several fingerprints; one stands for them
    nodes = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp"))
    roots = components(near_links(nodes, sets_of))
    rooted = least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = materialise(prints.select("doc_id", "node").join(rooted.join(classes, "root").select("node", "component_id"), "node").select("doc_id", "component_id"), "near-classes")
    remove_table(prints)
    return classed

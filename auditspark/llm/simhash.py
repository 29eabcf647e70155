"""Operator 10: SimHash near-duplicates by BK-trees.

A fingerprint is the bitwise majority of the hashes of a text's shingles.  Fingerprints within
RADIUS bits are linked.  Two of them agree on at least BLOCKS - RADIUS of BLOCKS bit blocks, so each
fingerprint joins one shard per choice of that many blocks, and links lie within shards; the more
fingerprints there are, the more blocks make the shards narrower (see blocks_for).  A shard's
fingerprints form a BK-tree - children keyed by their Hamming distance to the parent - and a
search follows only the edges within the radius of its distance to a node.  Shards above
SHARD_ROWS are cut into trees of that size, each searched by the members of every other cut.

From each tree only a spanning forest of its links leaves the task, so a group of m copies gives
m - 1 rows; alternating large-star and small-star steps join the forests to components.

Null and empty texts have fingerprint zero and are linked like any other; repeated rows and equal
texts share a fingerprint.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, read

SHINGLE, RADIUS, BLOCKS = 4, 4, 6
SHARD_ROWS = 8192
SEED = 42
#: Query-node pairs that one step of a search holds.
FRONT = 1 << 19


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """ASCII letters are lower-cased; words are separated by ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, n, 1 << 16):
        ones += np.unpackbits(h[part : part + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


class Forest:
    """The BK-trees of many shards at once.  `fp` is sorted by shard, `first` says where each begins.

    Trees are grown level by level: the first member of each group becomes a node and the others
    fall into groups by their distance to it, its children's edges.
    """

    def __init__(self, fp: np.ndarray, first: np.ndarray):
        self.fp = fp
        n = len(fp)
        self.root = first.copy()
        edges = []
        rows = np.arange(n)
        group = np.repeat(first, np.diff(np.append(first, n)))  # the node its group hangs on
        while True:
            rest = rows != group
            rows, group = rows[rest], group[rest]
            if not len(rows):
                break
            d = np.bitwise_count(fp[rows] ^ fp[group]).astype(np.int64)
            key = group * 128 + d
            o = np.argsort(key, kind="stable")
            rows, key = rows[o], key[o]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            child = rows[new]
            edges.append((key[new], child))
            group = child[np.cumsum(new) - 1]
        keys = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, np.int64)
        nodes = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.int64)
        o = np.argsort(keys)
        self.keys, self.nodes = keys[o], nodes[o]

    def search(self, query: np.ndarray, at: np.ndarray, who: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(who, node) pairs within the radius; each query starts at the root `at`."""
        open_ = [(query, at, who)]
        while open_:
            q, node, w = open_.pop()
            if len(q) > FRONT:
                half = len(q) // 2
                open_ += [(q[half:], node[half:], w[half:]), (q[:half], node[:half], w[:half])]
                continue
            d = np.bitwise_count(q ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield w[hit], node[hit]
            lo = np.searchsorted(self.keys, node * 128 + np.maximum(0, d - radius))
            many = np.searchsorted(self.keys, node * 128 + d + radius, "right") - lo
            total = int(many.sum())
            if total:
                i = np.repeat(np.arange(len(q)), many)
                step = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
                open_.append((q[i], self.nodes[lo[i] + step], w[i]))


class Union:
    """Components of row numbers; the smallest number stands for its component."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.up[a], self.up[b]
            m = ra != rb
            if not m.any():
                return
            np.minimum.at(self.up, np.maximum(ra, rb)[m], np.minimum(ra, rb)[m])
            while (nxt := self.up[self.up]).tobytes() != self.up.tobytes():
                self.up = nxt
            a, b = a[m], b[m]


def forest_links(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the shards given (arrays sorted by shard)."""
    keep = np.flatnonzero(np.concatenate([[False], shard[1:] == shard[:-1]]) | np.concatenate([shard[1:] == shard[:-1], [False]]))
    if not len(keep):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    shard, fp = shard[keep], fp[keep]
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    tree, u = Forest(fp, first), Union(len(fp))
    at = np.repeat(first, np.diff(np.append(first, len(fp))))
    for w, node in tree.search(fp, at, np.arange(len(fp)), radius):
        m = node < w
        u.join(w[m], node[m])
    low = np.flatnonzero(u.up != np.arange(len(fp)))
    return fp[low], fp[u.up[low]]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks such that a shard of n even fingerprints holds some hundred at most: BLOCKS up to 10**8."""
    blocks = max(BLOCKS, radius + 2)
    while n >> (64 * (blocks - radius) // blocks) > 64 and blocks < radius + 4:
        blocks += 1
    return blocks


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): linked fingerprints, a spanning forest of each shard; `fps` has distinct fp."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    shards = []
    for i, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        shards.append(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed).cast("bigint"))))
    rows = fps.select("fp", F.explode(F.array(*shards)).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    # single rows have no partner; large shards are cut into trees and paired, each pair a shard of its own
    rows = rows.join(sizes.where("n > 1"), "shard")
    pieces = F.ceil(F.col("n") / (shard_rows // 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), pieces).cast("int")
    pair = F.when(F.col("n") <= shard_rows, F.array(F.col("shard"))).otherwise(
        F.transform(F.sequence(F.lit(0), pieces - 1), lambda j: F.xxhash64("shard", F.least(mine, j), F.greatest(mine, j)))
    )
    rows = rows.select("fp", F.explode(pair).alias("shard")).repartition("shard").sortWithinPartitions("shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def flush(shard, fp):
            a, b = forest_links(shard, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(h[0]) for h in held) < 50_000:
                continue
            fp, shard = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            if whole:
                yield flush(shard[:whole], fp[:whole])
            held = [(fp[whole:], shard[whole:])]
        if held:
            fp, shard = (np.concatenate(x) for x in zip(*held, strict=True))
            yield flush(shard, fp)

    return rows.mapInArrow(run, "a bigint, b bigint")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the links, by alternating
    large-star and small-star steps until nothing changes; each round is checkpointed."""
    stars = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u")
        stars = cut_lineage(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def least_ids(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """node and component_id for `nodes` (node, low: the smallest id of the node's documents).

    The minima are checkpointed, so that the join with them can be split where a component is large."""
    rooted = nodes.join(roots.withColumnRenamed("node", node), node, "left").select(node, "low", F.coalesce("root", node).alias("root"))
    ids = cut_lineage(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    return rooted.join(ids, "root").select(node, "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links."""
    marked = cut_lineage(fingerprints(docs, shingle))
    firsts = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(firsts.select("fp"), radius, blocks_for(firsts.count(), radius)))
    return marked.join(least_ids(firsts, roots, "fp"), "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Near copies for the pipeline: texts whose sets of five-word shingles overlap by SIMILAR or more.

Equal sets are one node.  Candidates come from MinHash bands: two sets of Jaccard similarity s agree
on some of BANDS bands of ROWS minima with probability 1 - (1 - s**ROWS)**BANDS, 0.999993 at 0.8.
Within a band's bucket, nodes whose SimHashes are within RADIUS bits (about ten differ at 0.8, with
a deviation of three) are found by the trees of operator 10, and only a spanning forest of them
leaves the task.  The components of these forests hold every candidate pair; each one's sets then
meet, where links are confirmed by the exact similarity, and only those form groups.  A component of
more than MEETING sets is cut into pieces and every two pieces meet, so no task holds more.

Null and empty texts have the empty set, and are copies of each other; words and shingles are those
of operator 10, and a text of fewer than five words is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .simhash import SEED, Forest, Union, components, least_ids

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS, RADIUS = 30, 5, 22
#: Nodes of one bucket that one tree holds.
SHARD_ROWS = 8192
#: Sets of a candidate component that meet in one place.
MEETING = 4096
FACTORS = (np.random.default_rng(11).integers(0, 2**32, (BANDS * ROWS, 1), np.uint64).astype(np.uint32) | np.uint32(1))
SHIFTS = np.random.default_rng(12).integers(0, 2**32, (BANDS * ROWS, 1), np.uint64).astype(np.uint32)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - SHINGLE + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def simhash(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def bands(h: np.ndarray) -> np.ndarray:
    """A number for each band's minima."""
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1 << 12):
        y = (x[None, i : i + (1 << 12)] ^ SHIFTS) * FACTORS
        low = np.minimum(low, (y ^ (y >> np.uint32(15))).min(1))
    out = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for column in low.reshape(BANDS, ROWS).T:
            out = (out ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both >= SIMILAR * (len(a) + len(b) - both)


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), node (the set's), fp and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, band = [], [], []
            for t in b.column(2).to_pylist():
                h = shingles(t)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                fp.append(simhash(h))
                band.append(bands(h).view(np.int64))
            band = pa.ListArray.from_arrays(np.arange(len(band) + 1, dtype=np.int32) * BANDS, pa.array(np.concatenate(band) if band else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)), band], names=["doc_id", "th", "node", "fp", "bands"])

    return keyed(docs).mapInArrow(run, "doc_id bigint, th bigint, node bigint, fp bigint, bands array<bigint>")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of at least `least` rows that never split a value of the first column."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        key = t.column(0).to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cut:
            yield t.slice(0, cut)
        held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def meetings(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows (with `key` and node) under keys that at most about `most` rows share: rows of a larger key
    are cut by node, and every two of its pieces get a key of their own; keys of one row go."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cuts = F.ceil(F.col("n") / (most // 2)).cast("int")
    mine = F.pmod(F.xxhash64("node"), cuts).cast("int")
    pair = F.when(F.col("n") <= most, F.array(key)).otherwise(F.transform(F.sequence(F.lit(0), cuts - 1), lambda j: F.xxhash64(key, F.least(mine, j), F.greatest(mine, j))))
    return rows.join(sizes, key).withColumn(key, F.explode(pair)).drop("n")


def candidates(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): a spanning forest of each bucket's pairs within RADIUS bits."""
    rows = meetings(nodes.select(F.explode("bands").alias("shard"), "node", "fp"), "shard", shard_rows)
    rows = rows.select("shard", "node", "fp").repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 50_000):
            shard, node, fp = (t.column(i).to_numpy() for i in range(3))
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            u, fp = Union(len(fp)), fp.view(np.uint64)
            at = np.repeat(first, np.diff(np.append(first, len(fp))))
            for w, found in Forest(fp, first).search(fp, at, np.arange(len(fp)), RADIUS):
                m = found < w
                u.join(w[m], found[m])
            low = np.flatnonzero(u.up != np.arange(len(fp)))
            yield pairs(node[low], node[u.up[low]])

    return rows.mapInArrow(run, "a bigint, b bigint")


def confirmed(node: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of exact similarity among the texts of one candidate component."""
    sets = [shingles(t) for t in texts]
    o = np.argsort([len(s) for s in sets], kind="stable")
    sets, node = [sets[i] for i in o], node[o]
    size, fp = np.array([len(s) for s in sets]), np.array([simhash(s) for s in sets], np.uint64)
    group, a, b = np.arange(len(node)), [], []
    for i in range(1, len(node)):
        lo = int(np.searchsorted(size[:i], SIMILAR * size[i] - 1e-9))  # smaller sets cannot reach it
        near = lo + np.flatnonzero(np.bitwise_count(fp[lo:i] ^ fp[i]) <= RADIUS)
        while len(near):
            j = int(near[-1])
            near = near[:-1]
            if similar(sets[i], sets[j]):
                a.append(node[i])
                b.append(node[j])
                group[group == group[j]] = group[i]
                near = near[group[near] != group[i]]
    return np.array(a, np.int64), np.array(b, np.int64)


def near_copies(docs: DataFrame, meeting: int = MEETING) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links."""
    marked = cut_lineage(marks(docs))
    nodes = marked.groupBy("node").agg(F.min("th").alias("th"), F.min("doc_id").alias("low"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    rough = components(candidates(nodes))
    ends = rough.unionByName(rough.select(F.col("root").alias("node"), "root")).distinct()
    wanted = cut_lineage(meetings(nodes.select("node", "th").join(ends, "node"), "root", meeting).select("th", "root", "node"))
    # one text a node, wherever its copies stand, and then to each of the node's meetings
    chosen = wanted.select("th", "node").distinct()
    texts = keyed(docs).join(chosen, "th").groupBy("node").agg(F.first("text").alias("text"))
    dealt = texts.join(wanted, "node").select("root", "node", "text").repartition("root").sortWithinPartitions("root")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 500):
            root, node, text = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2)
            first = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])).tolist()
            for x, y in zip(first, [*first[1:], len(root)], strict=True):
                yield pairs(*confirmed(node[x:y], text.slice(x, y - x).to_pylist()))

    roots = components(dealt.mapInArrow(confirm, "a bigint, b bigint"))
    low = marked.groupBy("node").agg(F.min("doc_id").alias("low"))
    return marked.select("doc_id", "node").join(least_ids(low, roots, "node"), "node").select("doc_id", "component_id")

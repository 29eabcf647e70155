"""Operator 9: packing along a space-filling curve.

Every document becomes a hashed vector of its tokens, projected to DIMENSIONS numbers; the point's
Hilbert key orders documents so that neighbours on the curve are alike.  Documents are range-sorted by
(key, hash of the id) - equal texts share a key, the hash spreads them - over as many partitions as
Spark shuffles to, and each partition is packed along the curve: its tokens, one after the other, fill
sequences of `capacity` ids, so that at most its last sequence is padded, and then only to the next
power of two.

Documents are tokenized once; ids and keys wait as Parquet in the shared folder, so that Spark's range
bounds, drawn from the keys of every partition, don't tokenize again.

Null texts count as empty: their one id is the end mark.  Empty tables give no pieces.  Equal ids
and repeated rows are packed like any others; very long texts are cut over many sequences.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, through_parquet

CAPACITY = 1024
END = 0
DIMENSIONS, DEPTH = 4, 9  # with 24 bits of tie-break the order stays below 2**63
VOCABULARY = "byte_bpe_50k.json"


class Tokens:
    """ids of whole texts, encoded from the ranks file of the vocabulary where there is one.

    Without it the tokenizer itself encodes, and ids of pieces between single spaces are remembered.  In this
    vocabulary's split a single space between two other characters always starts a token, so pieces can be looked
    up one by one.  A text in which a space touches other white space is encoded as a whole.
    """

    def __init__(self, path: str, most: int = 250_000, ranks: bool = True):
        self.path, ranks_path, self.fast = path, path.removesuffix(".json") + ".tiktoken", None
        if ranks and os.path.exists(ranks_path):  # the same vocabulary
            import base64

            import public_tokenizers
            import tiktoken

            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
        self.pieces: dict[str, bytes | None] = {}
        self.most = most

    @functools.cached_property
    def whole(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = True
        return whole

    def encode(self, text: str) -> bytes:
        return array("H", self.fast.encode_ordinary(text) if self.fast else self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian 16-bit ids."""
        if self.fast:
            return self.encode(text)
        pieces = text.split(" ")
        get, out = self.pieces.get, []
        if len(self.pieces) > self.most:
            self.pieces.clear()
        for i, p in enumerate(pieces):
            b = get(p) if i else None
            if b is None:
                if not p or p[0].isspace() or p[-1].isspace() or p[-1] == "\x00":
                    if len(pieces) > 1 or not p:
                        return self.encode(text)
                b = self.encode(" " + p if i else p)
                if i:
                    self.pieces[p] = b
            out.append(b)
        return b"".join(out)


def projection(size: int, dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    """A random direction for each token id."""
    return np.random.default_rng(seed).normal(size=(size, dimensions)).astype(np.float32)


def hilbert(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Hilbert keys of integer points (n x d, below 2**depth), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    d, m = len(x), 1 << (depth - 1)
    q = m
    while q > 1:
        low = q - 1
        for i in range(d):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.int64), m
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(depth - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(ids: list[np.ndarray], directions: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given by token ids."""
    if not ids:
        return np.zeros(0, np.int64)
    mean = np.stack([directions[x].mean(0) if len(x) else np.zeros(directions.shape[1], np.float32) for x in ids])
    # means of many directions lie close to 0: the logistic keeps the middle wide
    return hilbert(np.minimum((1 << DEPTH) - 1, ((1 << DEPTH) / (1 + np.exp(-6.0 * mean))).astype(np.int64)))


def tie(doc_id: pd.Series) -> np.ndarray:
    return ((doc_id.fillna(-1).to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


def pieces_of(length: int, at: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of a document whose ids begin `at` ids into its range."""
    out, start = [], 0
    while start < length:
        seq, off = divmod(at + start, capacity)
        take = min(length - start, capacity - off)
        out.append((start, take, seq, off))
        start += take
    return out


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents; sequence_tokens is a sequence's padded size."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, directions = Tokens(path), projection(65536)
        for b in batches:
            for part in range(0, b.num_rows, 256):
                s = b.slice(part, 256)
                raw = [tokens(t) for t in s.column(1).to_pylist()]
                order = curve_keys([np.frombuffer(r, np.uint16) for r in raw], directions) << 24 | tie(s.column(0).to_pandas())
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(order), pa.array(raw, pa.binary())], names=["doc_id", "curve", "ids"])

    tokenized = through_parquet(docs.mapInArrow(points, "doc_id bigint, curve bigint, ids binary"), "tokens")
    dealt = tokenized.repartitionByRange("curve").sortWithinPartitions("curve", "doc_id", "ids")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, held = TaskContext.get().partitionId(), 0, []

        def close(last: int) -> pd.DataFrame:
            """The pieces held, with the size of each sequence; the last may be short."""
            f = pd.DataFrame(held, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "seq", "offset"])
            full, rest = divmod(last, capacity)
            f["sequence_tokens"] = np.where(f["seq"] < full, capacity, 1 << max(0, rest - 1).bit_length())
            f["sequence_id"] = (np.int64(now) << 32) + f["seq"]
            return f[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]]

        def out(f: pd.DataFrame) -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(f.astype({c: "int64" for c in f.columns if c != "doc_id"}).astype({"doc_id": "Int64"}), preserve_index=False)

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.append(np.frombuffer(raw, "<u2"), END).astype("<u4")
                for start, length, seq, off in pieces_of(len(ids), at, capacity):
                    held.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), seq, off))
                at += len(ids)
                if len(held) > 4000:  # all but the open sequence can go
                    open_ = at // capacity
                    f = close(at)
                    done = f[f["sequence_id"] - (np.int64(now) << 32) < open_]
                    yield out(done)
                    held = [h for h in held if h[5] >= open_]
        if held:
            yield out(close(at))

    return dealt.mapInArrow(packed, PIECES)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op9_curve_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), path or vocabulary())

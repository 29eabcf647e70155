"""Operator 11: vector code compression by product quantization in integers.

A vector's components become floor(256 x) and are cut into equal consecutive parts.  Each part position
has a codebook, fitted by rounds of assignment and averaging: an RDD of columnar NumPy blocks - one
(parts, dimensions, vectors) array each - is aggregated with treeAggregate.  Within a block distances
accumulate dimension by dimension, np.add.at adds components and members of each entry to int64
tensors, and the tensors merge through a reduction tree, so what reaches the driver is a few tensors
of one codebook's size, whatever the number of vectors.  Blocks are made anew from the table in
every pass; nothing is held that a lost executor could take along.

Vectors that are null or hold a null or non-finite component are dropped.  The codebooks start with the
vectors of the smallest ids (null ids last, equal ids by their components; repeated rows count
singly); with fewer vectors than entries, codebooks are as long as there are vectors, and without any
the result is empty.  A vector whose length differs from the first one's, or is no multiple
of the number of parts, raises ValueError.  Components of 65,536 and more in size are computed with
Python's integers instead of int64; errors beyond a bigint are cut to its largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, joined_back, read

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of a block; scaled ones below SAFE have sums of squares within int64 in up to 4,096 dimensions.
BLOCK, SAFE = 1 << 19, 1 << 24
LARGEST = 2**63 - 1


def usable():
    """Whether the column embedding is a vector without null or non-finite components."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 x), exactly: int64, or Python integers where one is large."""
    x = np.floor(values * SCALE)
    if not x.size or np.abs(x).max() < SAFE:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def columnar(flat: np.ndarray, size: int, parts: int) -> np.ndarray:
    """(parts, dimensions of a part, vectors) of vectors that follow each other."""
    return np.ascontiguousarray(scaled(flat.reshape(-1, size)).T).reshape(parts, size // parts, -1)


def pieces(vectors: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and components of consecutive stretches of about BLOCK components."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != size).any():
        raise ValueError(f"vectors of {size} components are expected, one has {lengths[lengths != size][0]}")
    flat, step = vectors.flatten().to_numpy(zero_copy_only=False), max(1, BLOCK // size)
    for i in range(0, len(lengths), step):
        yield i, flat[i * size : (i + step) * size]


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each vector's nearest entry, the lowest among equals, and its squared distance.
    part: (dimensions, vectors); entries: (entries, dimensions)."""
    distance = np.zeros((len(entries), part.shape[1]), np.result_type(part, entries))
    for d in range(len(part)):
        gap = part[d][None, :] - entries[:, d][:, None]
        gap *= gap
        distance += gap
    index = distance.argmin(0)
    return index, distance[index, np.arange(part.shape[1])]


def add_block(tensors: tuple[np.ndarray, np.ndarray], block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds a block to sums (parts, entries, dimensions) and counts (parts, entries)."""
    sums, counts = tensors
    if block.dtype == object and sums.dtype != object:
        sums = sums.astype(object)
    for p in range(len(block)):
        index, _ = nearest(block[p], books[p])
        np.add.at(counts[p], index, 1)
        for d in range(block.shape[1]):
            np.add.at(sums[p, :, d], index, block[p, d])
    return sums, counts


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, dimensions) over rows of vec_id and a usable embedding array<double>;
    None without rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    if not first:
        return None
    size = len(first[0].embedding)
    if not size or size % parts or any(len(r.embedding) != size for r in first):
        raise ValueError(f"vectors must have one length that is a multiple of {parts}")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for _, x in pieces(b.column(0), size)], pa.binary())], ["block"])

    blocks = rows.select("embedding").mapInArrow(packed, "block binary").rdd.map(lambda r: columnar(np.frombuffer(r[0], np.float64), size, parts))
    books = columnar(np.array([r.embedding for r in first], np.float64), size, parts).transpose(0, 2, 1)
    for _ in range(rounds):
        zero = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        sums, counts = blocks.treeAggregate(zero, lambda t, block, books=books: add_block(t, block, books), merge)
        used = counts > 0
        means = sums // np.maximum(counts, 1)[:, :, None]  # integers: division goes down
        if means.dtype == object and all(abs(int(x)) < SAFE for x in means.ravel()) and books.dtype != object:
            means = means.astype(np.int64)
        books = np.where(used[:, :, None], means, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    parts, _, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = [], []
            for _, flat in pieces(b.column(2), parts * dims):
                found = [nearest(part, entries) for part, entries in zip(columnar(flat, parts * dims, parts), books, strict=True)]
                codes += [c.tobytes().hex() for c in np.stack([i for i, _ in found], 1).astype(np.uint8)]
                errors += [min(int(e), LARGEST) for e in sum(e for _, e in found)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, code string, error bigint")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").where(usable())
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    books = fit(rows)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    coded = cut_lineage(encode(rows, books))
    # a sum beyond a bigint stays at its largest value
    totals = cut_lineage(coded.groupBy("label").agg(F.coalesce(F.try_sum("error"), F.lit(LARGEST)).alias("label_error"), F.count(F.lit(1)).alias("n")))
    return joined_back(coded, totals, "label", "n").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

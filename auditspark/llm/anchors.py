"""What the two exact substring operators share: routing repeated windows to one place.

A window is `length` consecutive units (words or bytes) of one document.  Its key is the smallest
hash of the `gram`-unit strings inside it, so equal windows have equal keys wherever they stand, and
consecutive windows mostly share one: a run of windows with one key is a segment.  A key that no
other segment has cannot hold a repeated window.  Keys are counted over all documents; segments
whose key recurs travel, with their text, to the shard of the key, where they are compared exactly.

Within a task identical segments are folded before the shuffle, so a passage in a third of all
documents sends one row per task to its shard.  A key with very many different segments is hot: its
windows travel one by one, each under the hash of the whole window, so no key gathers more than
about a quarter of a partition's fair share (see hot_limit) of different texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_partitions

#: Up to so many recurring keys (8 bytes each) are broadcast; more are joined by shuffle.
MOST_BROADCAST = 6_000_000
#: Different segments that a key may always have, and the most it may have before it is hot.
COOL, HOT = 2048, 250_000
#: Windows of one segment; longer runs of one key are cut.
MOST_WINDOWS = 256
#: Bytes of text that a task folds at a time.
FOLDED = 24_000_000
NO_ID = -(2**63)
PLACES = ["doc", "th", "start", "stop"]
MIX, MASK = np.uint64(0xBF58476D1CE4E5B9), np.uint64(2**63 - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return (h ^ (h >> np.uint64(29))) & MASK


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each `gram` consecutive units, mixed so that its order is arbitrary.

    A gram that is no power of two is two overlapping ones that are."""
    h, b, n = units.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while 2 * n <= gram:
            h = h[:-n] * b + h[n:] if len(h) > n else h[:0]
            b, n = b * b, 2 * n
        h = _mixed(h)
        if n < gram:
            h = _mixed(h[: -(gram - n)] * b + h[gram - n :]) if len(h) > gram - n else h[:0]
    return h


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a = np.minimum(a[:-n], a[n:])
        n *= 2
    return np.minimum(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def segments(units: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first windows, numbers of windows) of one document's segments."""
    return _segments(units, length, gram)[:3]


def _segments(units: np.ndarray, length: int, gram: int):
    if len(units) < length:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e.astype(np.uint64)
    h = gram_hashes(units, gram)
    k = sliding_min(h, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    n = np.diff(np.append(first, len(k)))
    if n.max() > MOST_WINDOWS:
        pieces = -(-n // MOST_WINDOWS)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + step * MOST_WINDOWS
        n = np.diff(np.append(first, len(k)))
    return k[first], first, n, h


def repeating(k: np.ndarray, first: np.ndarray, n: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Keys of the segments that hold their smallest gram more than once, and so perhaps a window."""
    if not len(k):
        return k
    grams, out = np.lib.stride_tricks.sliding_window_view(h, width), []
    for i in range(0, len(k), 4096):
        s = slice(i, i + 4096)
        left = first[s] + (grams[first[s]] == k[s, None]).argmax(1)
        last = first[s] + n[s] - 1
        right = last + width - 1 - (grams[last][:, ::-1] == k[s, None]).argmax(1)
        out.append(k[s][left != right])
    return np.concatenate(out)


def counted_keys(docs: DataFrame, units_of, length: int, gram: int) -> DataFrame:
    """key, n: the number of segments with the key (one within which a gram recurs counts twice);
    d: at least the number of different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, again, size = [], [], [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                k, first, n, h = _segments(units_of(t)[0], length, gram)
                held.append(k)
                with np.errstate(over="ignore"):
                    ids.append(k ^ _mixed(h[first] * MIX + h[first + n + length - gram - 1]))
                again.append(repeating(k, first, n, h, length - gram + 1))
                size += len(k)
                if size > 400_000:
                    yield folded(held, ids, again)
                    held, ids, again, size = [], [], [], 0
        if held:
            yield folded(held, ids, again)

    def folded(held, ids, again):
        own, different = np.concatenate(held), np.concatenate(ids)
        k, n = np.unique(np.concatenate([own, *again]), return_counts=True)
        one = own[np.unique(different, return_index=True)[1]]
        d = np.bincount(np.searchsorted(k, one), minlength=len(k))
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n), pa.array(d)], names=["key", "n", "d"])

    return docs.select("text").mapInArrow(run, "key bigint, n bigint, d bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def hot_limit(segments: int, partitions: int) -> int:
    """Different segments beyond which a key is hot: a quarter of a partition's fair share, within bounds."""
    return max(COOL, min(HOT, segments // (4 * partitions)))


def with_identity(docs: DataFrame, text: Column) -> DataFrame:
    """doc (the id, nulls first), th (60 bits of the text's MD5, which tell rows with one id apart and
    order them) and text as bytes."""
    th = F.conv(F.substring(F.md5(F.coalesce(text, F.lit(b""))), 1, 15), 16, 10).cast("bigint")
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), th.alias("th"), text.alias("text"))


def places(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=PLACES)


def marked_intervals(docs: DataFrame, units_of, cut, length: int, gram: int, all_copies: bool, new_shard: Callable, most_broadcast: int = MOST_BROADCAST, hot: int | None = None) -> DataFrame:
    """(doc, th, start, stop): unit intervals that repeated windows cover.

    units_of(text) -> (hashed units, handle); cut(handle, first, n) -> the bytes of n units.
    all_copies: every copy is marked, and a row repeated in the table is a copy; else all but the
    earliest are, and rows that agree in id and text are one document.
    new_shard() makes what compares the segments of some keys: add(text, doc, th, start, key) a segment
    that differs from the others of its key, repeated() says that the last one added has copies,
    `size` tells the bytes held, `most` how many it should hold, and run() yields arrays of PLACES.
    """
    keys = counted_keys(docs, units_of, length, gram).where("n > 1").select("key", "d")
    spark = docs.sparkSession
    keys = cut_lineage(keys)
    stats = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0))).first()
    n, limit = stats[0], hot_limit(stats[1], shuffle_partitions(spark)) if hot is None else hot
    row = "kind int, key bigint, seg binary, doc bigint, th bigint, start bigint, windows bigint, again boolean"
    types = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["kind", "key", "seg", "doc", "th", "start", "windows", "again"]

    def out(rows):
        c = list(zip(*rows, strict=True)) if rows else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=names)

    def fold(batches: Iterator[pa.RecordBatch], recurring) -> Iterator[pa.RecordBatch]:
        """recurring(keys, batch, row) -> masks of the keys that recur and of those that are hot.
        Folds equal segments of the task."""
        held: dict[bytes, list] = {}
        done: list[tuple] = []
        size = 0

        def found(key: int, seg: bytes, at: tuple, m: int) -> int:
            old = held.get(seg)
            if old is None:
                held[seg] = [key, at, m, False]
                return len(seg)
            if at != old[1] or all_copies:
                late = max(at, old[1])
                old[1], old[3] = min(at, old[1]), True
                done.append((1, hash(late) & (2**62 - 1), None, *late, m, True))
            return 0

        for b in batches:
            texts, docs_, ths = b.column("text").to_pylist(), b.column("doc").to_pylist(), b.column("th").to_pylist()
            for r in range(b.num_rows):
                units, handle = units_of(texts[r])
                k, first, many = segments(units, length, gram)
                if not len(k):
                    continue
                again, warm = recurring(k, b, r)
                doc, th = docs_[r], ths[r]
                for i in np.flatnonzero(again & ~warm).tolist():
                    s, m = int(first[i]), int(many[i])
                    size += found(int(k[i]), cut(handle, s, m + length - 1), (doc, th, s), m)
                if warm.any():
                    whole = gram_hashes(units, length)
                    for i in np.flatnonzero(warm).tolist():
                        for s in range(int(first[i]), int(first[i] + many[i])):
                            size += found(int(whole[s]), cut(handle, s, length), (doc, th, s), 1)
                            if size > FOLDED:
                                yield from parts(held)
                                held, size = {}, 0
            if size > FOLDED or len(done) > 50_000:
                yield out(done)
                done = []
            if size > FOLDED:
                yield from parts(held)
                held, size = {}, 0
        yield out(done)
        yield from parts(held)

    def parts(held):
        rows = []
        for seg, (k, at, m, again) in held.items():
            rows.append((0, k, seg, *at, m, again))
            if len(rows) >= 20_000:
                yield out(rows)
                rows = []
        yield out(rows)

    if n <= most_broadcast:
        table = np.sort(keys.select("key").toArrow()["key"].to_numpy()) if n else np.zeros(0, np.int64)
        warm = np.sort(keys.where(F.col("d") > limit).select("key").toArrow()["key"].to_numpy()) if n else table
        shared = spark.sparkContext.broadcast((table, warm))

        def within(t: np.ndarray, k: np.ndarray) -> np.ndarray:
            return t[np.minimum(np.searchsorted(t, k), len(t) - 1)] == k if len(t) else np.zeros(len(k), bool)

        def with_table(batches):
            table, warm = shared.value
            return fold(batches, lambda k, b, r: (within(table, k.view(np.int64)), within(warm, k.view(np.int64))))

        found = docs.mapInArrow(with_table, row)
    else:

        def pairs(batches):
            for b in batches:
                docs_, ths, ks = [], [], []
                for t, d, h in zip(b.column("text").to_pylist(), b.column("doc").to_pylist(), b.column("th").to_pylist(), strict=True):
                    k = np.unique(segments(units_of(t)[0], length, gram)[0])
                    ks.append(k)
                    docs_ += [d] * len(k)
                    ths += [h] * len(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(docs_, pa.int64()), pa.array(ths, pa.int64())], names=["key", "doc", "th"])

        own = docs.mapInArrow(pairs, "key bigint, doc bigint, th bigint").join(keys, "key").groupBy("doc", "th").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("d") > limit, F.col("key"))).alias("warm"))

        def with_own(batches):
            def of(k, b, r):
                return tuple(np.isin(k.view(np.int64), np.array(b.column(c)[r].as_py(), np.int64)) for c in ("keys", "warm"))

            return fold(batches, of)

        found = docs.join(own, ["doc", "th"]).mapInArrow(with_own, row)

    dealt = found.repartition("key").sortWithinPartitions("key", "seg", "doc", "th", "start")

    def compared(block) -> Iterator[pa.RecordBatch]:
        for arrays in block.run():
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in arrays], names=PLACES)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, at, rows = new_shard(), (None, None), None, []
        for b in batches:
            copy = pc.equal(b.column("kind"), 1)
            if (c := b.filter(copy)).num_rows:
                stop = pc.add(pc.add(c.column("start"), c.column("windows")), length - 1)
                yield pa.RecordBatch.from_arrays([c.column("doc"), c.column("th"), c.column("start"), stop], names=PLACES)
            b = b.filter(pc.invert(copy))
            for key, seg, doc, th, start, windows, again in zip(*(b.column(n).to_pylist() for n in names[1:]), strict=True):
                whole = (doc, th, start, start + windows + length - 1)
                if last == (key, seg):  # from another task, and not earlier
                    if all_copies or at != whole[:3]:
                        again = True
                        rows.append(whole)
                    if again:
                        block.repeated()
                else:
                    if key != last[0] and block.size > block.most:
                        yield from compared(block)
                        block = new_shard()
                    block.add(seg, doc, th, start, key)
                    if again:
                        block.repeated()
                    last, at = (key, seg), whole[:3]
            if len(rows) > 20_000:
                yield places(rows)
                rows = []
        yield from compared(block)
        yield places(rows)

    return dealt.mapInArrow(shard, "doc bigint, th bigint, start bigint, stop bigint")


def gathered(intervals: DataFrame) -> DataFrame:
    """doc, th, spans: each document's intervals (no more than its length allows)."""
    return intervals.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n units the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["stop"]] -= 1
    return np.cumsum(edge[:n]) > 0

"""Operator 8: repeated byte strings by external induced suffix sorting.

Every byte that a WINDOW-byte string covers which also starts earlier (in a smaller id, or earlier
in the same document) is removed; strings are judged on the input and never cross documents.
Segments that may hold a repeated string meet in the shard of their key (see anchors).  A shard
sorts the suffixes of its segments by induction: the left-most S-type suffixes are ordered first,
by recursive naming, then one ascending pass induces the L-type and one descending pass the S-type
suffixes.  The passes move tuples (position, common prefix with the one before) through a priority
queue that lies on disk beyond its memory share.  Common-prefix values (capped at CAP) are carried
by range minima between the suffixes that induce neighbours.

Only blocks of ROOM rows are worked on in memory.  What grows with the shard - its text, types,
seeds, names, queues and sorted suffixes - stays in memory up to ROOM rows each and lies in unnamed
files of the task beyond: written and read in sequence, or mapped where positions are looked up.

Suffixes that share WINDOW bytes are then neighbours; all but the earliest are marked.

Null and empty texts have no bytes; rows that agree in id and text count as one document, so a
repeated row alone removes nothing; of other rows with one id, that with the smaller MD5 of its text
comes first; null ids come before all others.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import MIX, NO_ID, _mixed, covered, gathered, gram_hashes, marked_intervals, runs_of, with_identity
from .common import read

WINDOW, GRAM = 100, 32
CAP = 255
#: Rows that an array or a queue may hold in memory; rows that a pass takes at a time.
ROOM, TAKE_ROWS = 1 << 21, 1 << 16
#: Bytes of segments that are judged at a time whether their keys' others can hold a window of theirs.
JUDGED = 1 << 18
TUPLE = np.dtype([("pos", np.int64), ("lcp", np.uint8)])
RANKED = np.dtype([("key", np.int64), ("at", np.int64)])


def room(n: int, dtype) -> np.ndarray:
    """n zeros: in memory up to ROOM rows, beyond that an unnamed file of the task, mapped."""
    if n <= ROOM:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,))


def chunks(n: int) -> Iterator[slice]:
    for i in range(0, n, TAKE_ROWS):
        yield slice(i, min(n, i + TAKE_ROWS))


class Queue:
    """Rows in order, written at the end; what exceeds `most` rows goes to an unnamed file."""

    def __init__(self, dtype=TUPLE, most: int | None = None):
        self.dtype, self.most = np.dtype(dtype), ROOM // 64 if most is None else most
        self.blocks: list[np.ndarray] = []
        self.rows = self.filed = 0
        self.file = None

    def put(self, rows: np.ndarray) -> None:
        self.blocks.append(rows if rows.base is None else rows.copy())  # a view would keep the whole block
        self.rows += len(rows)
        if self.rows > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for x in self.blocks:
                self.file.write(x.tobytes())
            self.filed += self.rows
            self.blocks, self.rows = [], 0

    def __len__(self) -> int:
        return self.rows + self.filed

    def read(self, start: int, stop: int) -> np.ndarray:
        """Filed rows start to stop."""
        self.file.seek(start * self.dtype.itemsize)
        return np.frombuffer(self.file.read((stop - start) * self.dtype.itemsize), self.dtype)

    def __iter__(self) -> Iterator[np.ndarray]:
        for c in chunks(self.filed):
            yield self.read(c.start, c.stop)
        for x in self.blocks:
            yield x

    def backwards(self) -> Iterator[np.ndarray]:
        for x in reversed(self.blocks):
            yield x[::-1]
        for stop in range(self.filed, 0, -TAKE_ROWS):
            yield self.read(max(0, stop - TAKE_ROWS), stop)[::-1]


class PriorityQueue:
    """Tuples by their first byte, first in first out among equals: induction pushes the suffixes of
    one byte in rank order, so the head of the least (or greatest) byte is the next in rank."""

    def __init__(self):
        self.of = [Queue() for _ in range(256)]

    def push(self, byte: int, rows: np.ndarray) -> None:
        self.of[byte].put(rows)

    def drain(self, byte: int) -> Iterator[np.ndarray]:
        """Blocks of that byte, those pushed meanwhile included."""
        while len(queue := self.of[byte]):
            self.of[byte] = Queue()
            small: list[np.ndarray] = []
            for x in queue:
                small.append(x)
                if sum(map(len, small)) >= TAKE_ROWS:
                    yield np.concatenate(small)
                    small = []
            if small:
                yield np.concatenate(small)


def merged(rows: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """External merge sort by key, then place: sorted runs of ROOM rows in a file, merged by blocks."""
    runs, held, size = Queue(RANKED, 0), [], 0
    bounds = [0]

    def flush():
        run = np.concatenate(held)
        runs.put(run[np.argsort(run["key"], kind="stable")])
        bounds.append(bounds[-1] + len(run))

    for r in rows:
        held.append(r)
        size += len(r)
        if size >= ROOM:
            flush()
            held, size = [], 0
    if len(bounds) == 1:
        if held:
            run = np.concatenate(held)
            run = run[np.argsort(run["key"], kind="stable")]
            yield from (run[c] for c in chunks(len(run)))
        return
    if held:
        flush()
        held = []
    take = max(1, ROOM // len(bounds))
    at, ends = bounds[:-1], bounds[1:]
    heads = [np.empty(0, RANKED)] * len(at)
    while True:
        for i, (a, e) in enumerate(zip(at, ends, strict=True)):
            if not len(heads[i]) and a < e:
                heads[i] = runs.read(a, min(e, a + take))
                at[i] += len(heads[i])
        live = [i for i, h in enumerate(heads) if len(h)]
        if not live:
            return
        open_ = [int(heads[i]["key"][-1]) for i in live if at[i] < ends[i]]
        limit = min(open_) if open_ else None
        parts = []
        for i in live:
            # keys below the least last one are complete in all heads; equal ones wait unless they fill a head
            n = len(heads[i]) if limit is None else int(np.searchsorted(heads[i]["key"], limit, "left"))
            parts.append(heads[i][:n])
            heads[i] = heads[i][n:]
        block = np.concatenate(parts)
        if len(block):
            yield block[np.argsort(block["key"], kind="stable")]
            continue
        for i in live:  # the heads begin with `limit`: its rows follow, run by run
            while len(heads[i]):
                n = int(np.searchsorted(heads[i]["key"], limit, "right"))
                if n:
                    yield heads[i][:n]
                heads[i] = heads[i][n:]
                if len(heads[i]) or at[i] == ends[i]:
                    break
                heads[i] = runs.read(at[i], min(ends[i], at[i] + take))
                at[i] += len(heads[i])


def keyed(keys: np.ndarray) -> Iterator[np.ndarray]:
    for c in chunks(len(keys)):
        rows = np.empty(c.stop - c.start, RANKED)
        rows["key"], rows["at"] = keys[c], np.arange(c.start, c.stop)
        yield rows


def dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of keys from 0, equal keys share one; and the number of different keys."""
    rank, last, n = room(len(keys), np.int64), None, 0
    if len(keys) <= ROOM:
        o = np.argsort(keys)
        rank[o] = np.cumsum(np.concatenate([[False], keys[o][1:] != keys[o][:-1]])) if len(keys) else 0
        return rank, int(rank[o[-1]]) + 1 if len(keys) else 0
    for block in merged(keyed(keys)):
        key = block["key"]
        step = np.concatenate([[last is not None and key[0] != last], key[1:] != key[:-1]])
        here = n + np.cumsum(step)
        rank[block["at"]] = here
        n, last = int(here[-1]), key[-1]
    return rank, n + 1


def range_minima(a: np.ndarray):
    """f(lo, hi): minima of a[lo..hi], by doubling."""
    levels = [a]
    while 2 * (1 << (len(levels) - 1)) <= len(a):
        w = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-w], levels[-1][w:]))

    def f(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), a.dtype)
        for level in np.unique(k):
            m = k == level
            out[m] = np.minimum(levels[level][lo[m]], levels[level][hi[m] - (1 << int(level)) + 1])
        return out

    return f


def common_prefix(words: np.ndarray, end: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, at most `most` rounded up to words.

    words[p]: the eight bytes from p on, big-endian; zeros stand behind the end."""
    n, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, most, 8):
        x, y = a[open_] + k, b[open_] + k
        inside = np.maximum(x, y) < end
        open_, x, y = open_[inside], x[inside], y[inside]
        diff = words[x].astype(np.uint64) ^ words[y].astype(np.uint64)
        same = diff == 0
        shared = (64 - np.frexp((diff[~same] >> np.uint64(11)).astype(np.float64) + 0.0)[1] - 11) // 8
        low = (diff[~same] >> np.uint64(11)) == 0
        n[open_[~same]] += np.where(low, 7 - ((diff[~same] >> np.uint64(8)) != 0), shared)
        open_ = open_[same]
        n[open_] += 8
    return np.minimum(n, end - np.maximum(a, b))


def types_of(t: np.ndarray, n: int) -> np.ndarray:
    """Which suffixes are S-type: smaller than the one behind; behind the last comes nothing, the smallest."""
    out, next_byte, next_type = room(n, np.bool_), -1, False
    for c in reversed(list(chunks(n))):
        x = t[c].astype(np.int16)
        behind = np.append(x[1:], next_byte)
        decided = np.flatnonzero(x != behind)
        # equal bytes have the type of the end of their run
        i = np.searchsorted(decided, np.arange(len(x)))
        out[c] = np.append((x < behind)[decided], next_type)[i]
        next_byte, next_type = int(x[0]), bool(out[c.start])
    return out


def sort_seeds(t: np.ndarray, n: int, s_type: np.ndarray, seeds: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Blocks of seeds in the order of their suffixes, exact for the first `most` bytes.

    The stretch from a seed to the next gets a name that ranks it by bytes and, between equal bytes,
    L-type first.  The string of names is then sorted recursively: each level names pairs of the
    names of the level before, until names are unique or span `most` bytes (a stretch has at least
    two)."""
    m, per = len(seeds), 6

    def part(which: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Six symbols of those stretches from k on, as a number; and which stretches go on."""
        here = seeds[which]
        # a stretch takes in the first byte of the next
        stop = np.where(which + 1 < m, seeds[np.minimum(which + 1, m - 1)] + 1, n)
        key = np.zeros(len(which), np.int64)
        for i in range(per):
            p = here + k + i
            q = np.minimum(p, n - 1)
            key = key << 10 | np.where(p < stop, (t[q].astype(np.int64) << 1 | s_type[q]) + 1, 0)
        return key, which[stop - here > k + per]

    keys, longer = room(m, np.int64), Queue(np.int64)
    for c in chunks(m):
        keys[c], more = part(np.arange(c.start, c.stop), 0)
        longer.put(more)
    name, names = dense(keys)
    for k in range(per, most + per, per):
        if not len(longer):
            break
        # the few stretches that are longer: ranks among those that tie
        sub, at, again = room(len(longer), np.int64), 0, Queue(np.int64)
        for which in longer:
            sub[at : at + len(which)], more = part(which, k)
            at += len(which)
            again.put(more)
        rank, at = dense(sub)[0], 0
        for c in chunks(m):
            keys[c] = name[c] * (m + 1)
        for which in longer:
            keys[which] += rank[at : at + len(which)] + 1
            at += len(which)
        (name, names), longer = dense(keys), again
    span = 1
    while names < m and 2 * span < most:
        for c in chunks(m):
            behind = name[c.start + span : c.stop + span] + 1
            keys[c] = name[c] * (m + 1)
            keys[c.start : c.start + len(behind)] += behind
        name, names = dense(keys)
        span *= 2
    if names == m <= ROOM:  # a permutation: no sort
        order = np.empty(m, np.int64)
        order[name] = np.arange(m)
        yield from (seeds[order[c]] for c in chunks(m))
        return
    for block in merged(keyed(name)):
        yield seeds[block["at"]]


def tuples(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    rows = np.empty(len(pos), TUPLE)
    rows["pos"], rows["lcp"] = pos, lcp
    return rows


def sorted_suffixes(t: np.ndarray, n: int, most: int) -> Iterator[np.ndarray]:
    """Blocks of (suffix, common prefix with the one before, capped) of the first n bytes of t.

    At least eight zero bytes stand behind them.  The order is exact for the first `most` bytes."""
    if n < 2:
        if n:
            yield tuples(np.zeros(1, np.int64), np.zeros(1, np.uint8))
        return
    words = np.ndarray((n,), ">u8", t, 0, (1,))
    s_type = types_of(t, n)

    def seeds_in(c: slice) -> np.ndarray:
        return s_type[c] & ~np.concatenate([[True], s_type[max(0, c.start - 1) : c.stop - 1]])[-(c.stop - c.start) :]

    seeds, m = room(sum(int(seeds_in(c).sum()) for c in chunks(n)), np.int64), 0
    for c in chunks(n):
        x = np.flatnonzero(seeds_in(c)) + c.start
        seeds[m : m + len(x)] = x
        m += len(x)

    def run_length(p: int) -> int:
        x = t[p : min(n, p + CAP + 1)]
        return int(np.append(np.flatnonzero(x != x[0]), len(x))[0])

    def touching(last: int | None, first: int) -> int:
        """Common prefix of the last L-type and the first S-type suffix of a byte."""
        return 0 if last is None else min(run_length(last), run_length(first), CAP)

    seed_of, before = [Queue() for _ in range(256)], None
    for block in sort_seeds(t, n, s_type, seeds, most) if m else ():
        lcp = np.zeros(len(block), np.int64)
        x, y = (block[:-1], block[1:]) if before is None else (np.append(before, block[:-1]), block)
        lcp[len(block) - len(y) :] = np.minimum(common_prefix(words, n, x, y, most), CAP)
        cut = np.searchsorted(t[block], np.arange(257))
        for c in np.unique(t[block]).tolist():
            seed_of[c].put(tuples(block[cut[c] : cut[c + 1]], lcp[cut[c] : cut[c + 1]]))
        before = block[-1]

    def scan(ascending: bool, queue: PriorityQueue, more, keep) -> None:
        """One pass.  more(c): what joins byte c behind its queue; keep(c, block): takes the sorted."""
        carry = np.full(256, CAP, np.uint8)  # the least common prefix since the last suffix induced to a byte
        started = np.zeros(256, bool)
        if ascending:  # the last suffix is queued already, and has one byte to share
            started[t[n - 1]], carry[t[n - 1]] = True, 0

        def induce(block: np.ndarray):
            pos, lcp = block["pos"], block["lcp"]
            src = np.flatnonzero(pos > 0)
            before = pos[src] - 1
            fits = s_type[before] != ascending
            src, before = src[fits], before[fits]
            c = t[before]
            low = range_minima(np.ascontiguousarray(lcp))
            if len(src):
                o = np.argsort(c, kind="stable")
                src, before, c = src[o], before[o], c[o]
                new = np.concatenate([[True], c[1:] != c[:-1]])
                lo = np.where(new, 0, np.concatenate([[0], src[:-1] + 1]))
                m = low(lo, src)
                m = np.where(new, np.minimum(m, carry[c]), m)
                m = np.minimum(m.astype(np.int64) + 1, CAP)
                m[new & ~started[c]] = 0
                first = np.flatnonzero(new)
                rows = tuples(before, m)
                for a, b, x in zip(first.tolist(), [*first[1:].tolist(), len(c)], c[first].tolist(), strict=True):
                    queue.push(x, rows[a:b])
                ends, chars = src[np.append(first[1:], len(c)) - 1], c[first]
                started[chars] = True
            carry[:] = np.minimum(carry, lcp.min())
            if len(src):
                rest = np.append(lcp, np.uint8(CAP))
                carry[chars] = np.where(ends + 1 < len(lcp), low(np.minimum(ends + 1, len(lcp) - 1), np.full(len(ends), len(lcp) - 1)), rest[-1])

        for c in range(256) if ascending else range(255, -1, -1):
            last = None
            for block in queue.drain(c):
                last = int(block["pos"][-1])
                keep(c, block)
                induce(block)
            for block in more(c, last):
                induce(block)

    l_sorted, s_sorted = ([Queue() for _ in range(256)] for _ in range(2))
    queue = PriorityQueue()
    # the last suffix is L-type and the first of its byte: what precedes it needs no induction
    queue.push(int(t[n - 1]), tuples(np.array([n - 1]), np.zeros(1, np.uint8)))

    def seeds_behind(c, last):
        first = True
        for block in seed_of[c]:
            if first:
                block = block.copy()
                block["lcp"][0], first = touching(last, int(block["pos"][0])), False
            yield block

    scan(True, queue, seeds_behind, lambda c, b: l_sorted[c].put(b))
    seed_of = None

    def reversed_(queue: Queue, first: int) -> Iterator[np.ndarray]:
        """Backwards, each with the common prefix with the one taken before; `first` for the first."""
        for block in queue.backwards():
            yield tuples(block["pos"], np.append(np.uint8(first), block["lcp"][:-1]))
            first = int(block["lcp"][-1])

    def l_behind(c, last):
        greatest = next(l_sorted[c].backwards(), None)
        if greatest is not None:
            yield from reversed_(l_sorted[c], touching(last, int(greatest["pos"][0])))

    scan(False, PriorityQueue(), l_behind, lambda c, b: s_sorted[c].put(b))
    for c in range(256):
        last = None
        for block in l_sorted[c]:
            last = int(block["pos"][-1])
            yield block
        least = next(s_sorted[c].backwards(), None)
        if least is not None:
            yield from reversed_(s_sorted[c], touching(last, int(least["pos"][0])))


def suffix_array(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, common prefix of each with the one before, capped), whole."""
    blocks = list(sorted_suffixes(np.append(text, np.zeros(8, np.uint8)), len(text), most))
    rows = np.concatenate(blocks) if blocks else np.empty(0, TUPLE)
    return rows["pos"].copy(), rows["lcp"].copy()


def recurs(ids: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(ids, return_inverse=True, return_counts=True)
    return n[at] > 1


def with_company(text: np.ndarray, begin: np.ndarray, stop: np.ndarray, keys: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Which of the segments, whose keys are all here in whole, may hold a window that recurs in them or in another.

    Windows of a segment hold the gram whose hash is the key.  If no segment of a key holds it twice, equal
    windows lie about it alike in two segments, and hold at least half of the rest of the window's bytes on one side of
    it; there the segments agree."""
    half = -(-(window - gram) // 2)
    h = gram_hashes(text, gram)
    at = np.flatnonzero(h == np.repeat(keys, np.diff(np.append(begin, len(text))))[: len(h)])
    seg = np.searchsorted(begin, at, "right") - 1
    inside = at + gram <= stop[seg]
    at, seg = at[inside], seg[inside]
    _, group = np.unique(keys, return_inverse=True)
    once = np.bincount(seg, minlength=len(keys)) == 1
    unsure = np.bincount(group, ~once) > 0  # the key of windows that travel one by one is no gram's hash
    maybe = unsure[group] & ((np.bincount(group)[group] > 1) | (stop - begin > window))
    sure = ~unsure[group[seg]]
    at, seg = at[sure], seg[sure]
    for there, fits in ((at - half, at - half >= begin[seg]), (at + half, at + half + gram <= stop[seg])):
        with np.errstate(over="ignore"):
            ids = _mixed(keys[seg[fits]] * MIX + h[there[fits]])
        maybe[seg[fits]] |= recurs(ids)
    return maybe


class StringShard:
    """Segments of some keys, sorted together; beyond ROOM bytes their text waits in a file.

    Segments with a key are sorted only if they have company: a segment whose copies alone recur has none.
    Of each segment four numbers stay in memory, where it has WINDOW bytes at least."""

    most = 2_000_000

    def __init__(self, window: int, gram: int = GRAM):
        self.window, self.gram, self.size, self.n = window, gram, 0, 0
        self.text = Queue(np.uint8, ROOM)
        self.begin, self.docs, self.ths, self.starts = array("q"), array("q"), array("q"), array("q")
        self.waiting: list[tuple] = []
        self.bytes, self.key, self.whole = 0, None, None

    def add(self, seg: bytes, doc: int, th: int, start: int, key: int | None = None) -> None:
        if key is None or key == self.whole:
            self._keep(seg + b"\x00", [0], [(seg, doc, th, start)])
            return
        if key != self.key and self.bytes > JUDGED:
            self._judge()
        self.key = key
        self.waiting.append((seg, doc, th, start, key))
        self.bytes += len(seg)
        if self.bytes > 4 * JUDGED:  # a key with so many different segments is not judged
            self.whole = key
            self._judge()

    def _keep(self, text, begin: list[int], rows: list[tuple]) -> None:
        text = np.frombuffer(text, np.uint8)
        self.text.put(text)  # a window that runs past its segment counts for nothing
        self.begin.extend(self.n + b for b in begin)
        self.docs.extend(r[1] for r in rows)
        self.ths.extend(r[2] for r in rows)
        self.starts.extend(r[3] for r in rows)
        self.n += len(text)
        self.size += len(text) - len(rows)

    def _judge(self) -> None:
        rows, self.waiting, self.bytes = self.waiting, [], 0
        if not rows:
            return
        text = np.frombuffer(b"".join(r[0] + b"\x00" for r in rows), np.uint8)
        stop = np.cumsum([len(r[0]) + 1 for r in rows]) - 1
        begin = np.append(0, stop[:-1] + 1)
        keys = np.array([r[4] for r in rows], np.int64)
        kept = with_company(text, begin, stop, keys.view(np.uint64), self.window, self.gram) | (keys == (-1 if self.whole is None else self.whole))
        if kept.any():
            n = (stop - begin + 1)[kept]
            self._keep(text[np.repeat(kept, stop - begin + 1)], (np.cumsum(n) - n).tolist(), [rows[i] for i in np.flatnonzero(kept)])

    def repeated(self) -> None:
        """The copies have been marked, and the earliest stays."""

    def run(self) -> Iterator[tuple[np.ndarray, ...]]:
        self._judge()
        begin, docs, ths, starts = (np.array(x, np.int64) for x in (self.begin, self.docs, self.ths, self.starts))
        if not len(begin) or len(begin) == 1 and self.n <= self.window + 1:
            return
        text, at = room(self.n + 8, np.uint8), 0
        for x in self.text:
            text[at : at + len(x)] = x
            at += len(x)
        stop = np.append(begin[1:], self.n) - 1
        order = np.lexsort((starts, ths, docs))
        same = (docs[order][1:] == docs[order][:-1]) & (ths[order][1:] == ths[order][:-1])
        rank = np.empty(len(begin), np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], ~same]))
        mark = room(self.n + 1, np.bool_)
        chain, open_ = 0, None  # the chain of suffixes that goes on, and its earliest place so far
        for block in sorted_suffixes(text, self.n, self.window):
            chains = chain + np.cumsum(block["lcp"] < self.window)
            chain = int(chains[-1])
            # alone in its chain a suffix marks nothing; the block's ends may have company in the next ones
            company = np.concatenate([[True], chains[1:] == chains[:-1]])
            company[:-1] |= company[1:]
            company[-1] = True
            pos, chains = block["pos"][company], chains[company]
            seg = np.searchsorted(begin, pos, "right") - 1
            whole = pos + self.window <= stop[seg]
            pos, seg, chains = pos[whole], seg[whole], chains[whole]
            if not len(pos):
                continue
            place, doc = starts[seg] + pos - begin[seg], rank[seg]
            if open_ and open_[0] == chains[0]:
                pos, place, doc, chains = (np.append(x, y) for x, y in zip((pos, place, doc, chains), (*open_[1:], open_[0]), strict=True))
            o = np.lexsort((place, doc, chains))
            late = np.concatenate([[False], chains[o][1:] == chains[o][:-1]])
            # a place can stand in two segments only as two different windows, so later rows are later places
            mark[pos[o][late]] = True
            least = o[np.flatnonzero(~late)[-1]]
            open_ = (chains[least], pos[least], place[least], doc[least])
        for c in chunks(self.n):
            s, e = runs_of(np.asarray(mark[c]))
            if len(s):
                # runs of marked windows that a chunk or a segment cuts give intervals that overlap or touch
                s, e = s + c.start, e + c.start
                seg = np.searchsorted(begin, s, "right") - 1
                shift = starts[seg] - begin[seg]
                yield docs[seg], ths[seg], s + shift, e + shift + self.window - 1


def byte_units(text: bytes | None) -> tuple[np.ndarray, bytes]:
    return np.frombuffer(text or b"", np.uint8), text or b""


def cut_bytes(text: bytes, first: int, n: int) -> bytes:
    return text[first : first + n]


def removed_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **more) -> DataFrame:
    """doc, th, text (bytes) and spans: the byte intervals of each document to remove."""
    own = with_identity(docs, F.col("text").cast("binary"))
    spans = gathered(marked_intervals(own, byte_units, cut_bytes, window, gram, False, lambda: StringShard(window, gram), **more))
    return own.join(spans, ["doc", "th"], "left")


def op8_induced_suffixes(spark, sf_dir: str, **more) -> DataFrame:
    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                text, n, k = text or b"", 0, 0
                kept = text
                if spans:
                    gone = covered(len(text), spans)
                    n, k = int(gone.sum()), len(runs_of(gone)[0])
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((None if doc == NO_ID else doc, len(text), n, k, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return removed_bytes(read(spark, sf_dir, "documents"), **more).mapInArrow(digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")

"""Operator 6: benchmark decontamination by rare seeds and Smith-Waterman alignment.

Every GRAM-word string of the test items is a seed, however often it occurs: a cut by document
frequency would depend on the other documents, and leave an edited copy without seeds where others
hold the item unchanged.  Strings of so many words are rare by themselves.  Where a document has a seed
of an item, the stretch around it is a candidate if it holds enough of the item's words to reach
THRESHOLD at all (an upper bound of the score, so this loses nothing), and the item is aligned with
it word by word.  The score is the best local alignment's share of a perfect one; pairs from THRESHOLD
on are returned, with the words of the document that the alignment spans.

Test items are read in blocks of bounded size, one pass over the documents each, so neither side
need fit in memory; documents are never shuffled.  Words are lower-cased runs of ASCII letters,
digits and non-ASCII bytes.  Null, empty and wordless texts and items give no rows; items shorter
than GRAM words are one seed as a whole.  Repeated documents or items each give their own rows;
an item without an id gives rows of a null item_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, 1
THRESHOLD = 0.5
#: Test items, and bytes of their texts, that one pass holds.
BLOCK_ITEMS, BLOCK_BYTES = 5000, 8_000_000

# ASCII letters to lower case, digits and bytes beyond ASCII unchanged, anything else to a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


@dataclass
class Items:
    """A block of test items; grams are sorted, entries lists (item, position) by gram."""

    ids: list[int | None]
    words: list[np.ndarray]
    number: dict[bytes, int]
    grams: np.ndarray
    first: np.ndarray
    entry_item: np.ndarray
    entry_at: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int | None, bytes]]) -> Items:
        number: dict[bytes, int] = {}
        ids, words, code, item, at = [], [], [], [], []
        for item_id, text in rows:
            w = np.array([number.setdefault(x, len(number) + 1) for x in words_of(text)], np.int64)
            if not len(w):
                continue
            own = codes(w).tolist() if len(w) >= GRAM else [short_code(w)]
            code += own
            item += [len(ids)] * len(own)
            at += range(len(own))
            ids.append(item_id)
            words.append(w)
        c = np.array(code, np.int64)
        o = np.argsort(c, kind="stable")
        grams, first = np.unique(c[o], return_index=True)
        return Items(ids, words, number, grams, np.append(first, len(c)), np.array(item, np.int64)[o], np.array(at, np.int64)[o])

    def hits(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers of the text, positions, grams) where a gram of some item begins."""
        w = words_of(text)
        get = self.number.get
        n = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
        found = [look(self.grams, codes(n), np.flatnonzero(n[:-2].astype(bool) & n[1:-1].astype(bool) & n[2:].astype(bool)))] if len(n) >= GRAM else []
        for m in range(1, GRAM):
            if self.shorts[m] and len(n) >= m:
                found.append(look(self.grams, np.array([short_code(n[i : i + m]) for i in range(len(n) - m + 1)]), np.flatnonzero([n[i : i + m].all() for i in range(len(n) - m + 1)])))
        if not found:
            return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
        return n, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    @property
    def shorts(self) -> list[bool]:
        if not hasattr(self, "_shorts"):
            self._shorts = [any(len(w) == m for w in self.words) for m in range(GRAM)]
        return self._shorts


def codes(n: np.ndarray) -> np.ndarray:
    """One number for each GRAM consecutive word numbers (below 2**20 in a block)."""
    return (n[:-2] << 40) | (n[1:-1] << 20) | n[2:]


def short_code(n: np.ndarray) -> int:
    return -int(sum(int(x) << 20 * i for i, x in enumerate(n)))


def look(grams: np.ndarray, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(at) or not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(grams, code[at]), len(grams) - 1)
    hit = grams[i] == code[at]
    return at[hit], i[hit]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(best local score, where it ends in b), row by row; gaps to the left by a running maximum."""
    j = np.arange(len(b) + 1) * GAP
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for x in a:
        up = np.maximum(0, row - GAP)
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH))
        row = np.maximum.accumulate(up + j) - j
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, seeds, start_word, end_word of every contaminated pair."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["b"] or 0) // BLOCK_BYTES))
    found = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        block = Items.of(sorted(((r[0], bytes(r[1])) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])))
        part = block_matches(docs, block, threshold)
        found = part if found is None else found.unionByName(part)
    return found


def block_matches(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_ITEMS items, BLOCK_BYTES bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        within = np.zeros(len(it.number) + 1, bool)  # which words stand in the text or stretch at hand
        memo: dict[tuple[int, bytes], tuple[float, int, int]] = {}
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, at, gram = it.hits(text)
                if not len(at):
                    continue
                # every (item, position in it, position in the text) of a gram
                many = it.first[gram + 1] - it.first[gram]
                e = np.repeat(it.first[gram], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                pos, item = np.repeat(at, many), it.entry_item[e]
                o = np.lexsort((pos, item))
                pos, item, e = pos[o], item[o], e[o]
                begin = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
                within[n] = True
                likely = [within[it.words[i]].sum() >= threshold * len(it.words[i]) for i in item[begin].tolist()]
                within[n] = False
                for s, z in zip(begin[likely].tolist(), np.append(begin[1:], len(item))[likely].tolist(), strict=True):
                    i = int(item[s])
                    m, p, where = len(it.words[i]), pos[s:z], it.entry_at[e[s:z]]
                    best = (0.0, 0, 0, 0)
                    cut = np.flatnonzero(np.diff(p) > 2 * m) + 1
                    for q, s in zip(np.split(p, cut), np.split(where, cut), strict=True):
                        lo, hi = max(0, int(q[0]) - 2 * m), min(len(n), int(q[-1]) + 2 * m)
                        # an alignment matches each of the item's words at most once: no score beyond this share
                        within[n[lo:hi]] = True
                        some = within[it.words[i]].sum()
                        within[n[lo:hi]] = False
                        if some < threshold * m:
                            continue
                        key = (i, n[lo:hi].tobytes())
                        if key not in memo:
                            if len(memo) > 20_000:
                                memo.clear()
                            score, end = align(it.words[i], n[lo:hi])
                            back = align(it.words[i][::-1], n[lo:hi][:end][::-1])[1] if score >= threshold * MATCH * m else 0
                            memo[key] = (score / (MATCH * m), end - back, end)
                        score, a, z = memo[key]
                        best = max(best, (score, len(set(s.tolist())), lo + a, lo + z))
                    if best[0] >= threshold:
                        out.append((doc, it.ids[i], *best))
            c = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=["doc_id", "item_id", "score", "seeds", "start_word", "end_word"])

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint, score double, seeds bigint, start_word bigint, end_word bigint")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

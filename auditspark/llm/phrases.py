"""Operator 3: repeated passages by sharded phrase automata.

A window is WINDOW consecutive words; every word that a window covers whose word sequence also
starts anywhere else is removed - all copies, the first too.  Documents are streamed in stretches: a
stretch goes to the shard of its key (see anchors) if a window in it could recur, and no other shard
holds a phrase that it could match.  A shard proposes passages by rolling hashes, compiles them into
an Aho-Corasick automaton and streams all its stretches through it, which confirms the passages and
locates every occurrence.

Words are the unchanged runs of characters other than ASCII white space.  Null and empty texts have
no words; texts shorter than a window are kept.  Every row counts, so a row that is repeated in the
table (same id, same text) stands elsewhere too and loses its windows like any other copy.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import NO_ID, covered, gathered, gram_hashes, marked_intervals, runs_of, with_identity
from .common import read

WINDOW, GRAM = 35, 8


def word_units(text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
    words = text.split() if text else []
    return np.fromiter(map(crc32, words), np.uint64, len(words)), words


def cut_words(words: list[bytes], first: int, n: int) -> bytes:
    return b" ".join(words[first : first + n])


class PhraseShard:
    """Segments of some keys, compared through one automaton.

    Words become numbers, windows rolling hashes.  Windows whose hash recurs are candidates; runs of
    them are passages, cut into phrases of a window each that cover all their words.  The phrases are
    compiled into an Aho-Corasick automaton over word numbers, and every segment is streamed through
    it: a phrase found twice is confirmed, exactly, and all its occurrences mark their words."""

    most = 1_500_000

    def __init__(self, window: int):
        self.window, self.size, self.length = window, 0, 0
        self.numbers: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.docs, self.ths, self.starts, self.copied = [], [], [], []

    def add(self, seg: bytes, doc: int, th: int, start: int, key: int | None = None) -> None:
        numbers, words = self.numbers, seg.split()
        self.words.append(np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int64, len(words)))
        self.docs.append(doc)
        self.ths.append(th)
        self.starts.append(start)
        self.copied.append(False)
        self.size += len(seg)

    def repeated(self) -> None:
        self.copied[-1] = True

    def run(self) -> Iterator[tuple[np.ndarray, ...]]:
        if not self.words:
            return
        sizes = np.array([len(w) for w in self.words])
        begin = np.cumsum(sizes + 1) - sizes - 1  # a zero stands behind every segment
        text = np.zeros(int(begin[-1] + sizes[-1]) + 1, np.int64)
        seg = np.repeat(np.arange(len(sizes)), sizes + 1)
        inside = np.arange(len(text)) - begin[seg]
        text[inside < sizes[seg]] = np.concatenate(self.words)
        copied = np.array(self.copied)
        at = np.flatnonzero(inside + self.window <= sizes[seg])
        _, which, n = np.unique(gram_hashes(text, self.window)[at], return_inverse=True, return_counts=True)
        candidate = np.zeros(len(text) + 1, bool)
        candidate[at[(n[which] > 1) & ~copied[seg[at]]]] = True
        edge = np.zeros(len(text) + 1, np.int64)
        for step in (self.window, 1):  # phrases overlap as little as covers; if one is not confirmed, every window is one
            starts, stops = runs_of(candidate)
            phrases = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.append(np.arange(s, e - 1, step), e - 1) for s, e in zip(starts.tolist(), stops.tolist(), strict=True))]))
            found, phrase = self.occurrences(text, begin, sizes, phrases)
            often = np.bincount(phrase, minlength=len(phrases)) + np.bincount(phrase[copied[seg[found]]], minlength=len(phrases)) if len(phrases) else np.zeros(0)
            found = found[often[phrase] > 1] if len(found) else found
            np.add.at(edge, found, 1)
            np.add.at(edge, found + self.window, -1)
            if len(phrases) == 0 or often[often > 0].min() > 1:
                break
        for s in np.flatnonzero(copied).tolist():  # equal texts stand elsewhere as a whole
            edge[begin[s]] += 1
            edge[begin[s] + sizes[s]] -= 1
        starts, stops = runs_of(np.cumsum(edge) > 0)
        if len(starts):
            s = seg[starts]
            shift = np.array(self.starts)[s] - begin[s]
            yield np.array(self.docs)[s], np.array(self.ths)[s], starts + shift, stops + shift

    def occurrences(self, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the phrase) of every occurrence; equal phrases share the lowest number."""
        if not len(phrases):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i in range(len(phrases) - 1, -1, -1):
            automaton.add_word(tuple(text[phrases[i] : phrases[i] + self.window].tolist()), i)
        automaton.make_automaton()
        ends = [pair for pair in automaton.iter(tuple(text.tolist()))]
        found, phrase = np.array(ends, np.int64).reshape(-1, 2).T
        return found - self.window + 1, phrase


def removed_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **more) -> DataFrame:
    """doc_id, text (bytes) and spans: the word intervals of each document to remove."""
    own = with_identity(docs, F.col("text").cast("binary"))
    spans = gathered(marked_intervals(own, word_units, cut_words, window, gram, True, lambda: PhraseShard(window), **more))
    return own.join(spans, ["doc", "th"], "left")


def op3_phrase_automata(spark, sf_dir: str, **more) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = text.split() if text else []
                if spans:
                    gone = covered(len(words), spans)
                    kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
                    n = int(gone.sum())
                else:
                    kept, n = b" ".join(words), 0
                rows.append((None if doc == NO_ID else doc, len(words), n, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"]) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removed_words(read(spark, sf_dir, "documents"), **more).mapInArrow(digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")

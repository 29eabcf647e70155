"""Operator 1: language identification by interpolated Kneser-Ney character models.

Each language has a model of its characters up to ORDER, kept as sorted arrays of n-gram hashes
with the discounted, interpolated log-probability of the n-gram's last character and, per context,
the weight that passes to the shorter context.  A text gets the language with the lowest
cross-entropy per character.  Every fifth training row is held back from the models and calibrates
them, whole and cut to stretches of LENGTHS: at each length it gives a language the cross-entropy that all but
FALSE_REJECTIONS of its texts stay below; beyond it a text fits no model and is `rejected`.  And it gives the
score its temperature, a power of the text's length, so that the score is the probability that the choice is right.

Null texts and texts without a letter are `und` with score 0.  Without any labelled training row
every text is `und`.  Ties go to the alphabetically first language.  Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_remainder, read

ORDER = 4
#: At most so many labelled rows of a language train its model, those whose id hashes lowest.
TRAINING_ROWS = 250
#: Rows with longer texts train nothing, so that what reaches the driver is bounded.
TRAINING_CHARACTERS = 100_000
#: The most frequent characters have a number of their own (16 bits a character); any others would share one.
ALPHABET = 60_000
#: The share of texts of a known language that may be rejected.
FALSE_REJECTIONS = 0.002
#: Characters of the stretches that calibrate, and stretches of each length a row.  The limit is taken up to LIMITED:
#: stretches of a longer text are so alike that the few held-back rows do not tell how far others may lie.
LENGTHS, STRETCHES, LIMITED = [20, 40, 80, 160, 320, 640], 4, 160
#: The score's temperature is chosen among these: a factor and a power of the length.
SHARPNESS, POWERS = np.geomspace(0.01, 4.0, 49), (0.0, 0.25, 0.5, 0.75, 1.0)
SLOTS = 1 << 19
UND = "und"


def char_classes() -> np.ndarray:
    """Per code point: its lower-case letter, or a space for anything else."""
    a = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            a[c] = ord(x.lower()[0])
    return a


def letters(text: str, classes: np.ndarray) -> np.ndarray:
    """The text as lower-case letters, each run of anything else as one space, with
    a space behind and ORDER - 1 before, so that the first letter is scored too."""
    c = classes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
    return np.concatenate([np.full(ORDER - 2, 32, np.uint32), c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]])


def mix(k: np.ndarray, n: int) -> np.ndarray:
    k = (k + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(29))


@dataclass
class Model:
    """grams[n], logp[n]: n-gram hashes, sorted, and log P of the last character; contexts[n], weight[n]:
    hashes of contexts of n characters and the log of what they leave to shorter contexts."""

    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]
    floor: float
    #: calibrated lengths, the usual cross-entropy of texts of such lengths, and how far beyond it they may lie
    usual: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def limit(self, n: np.ndarray) -> np.ndarray:
        """The cross-entropy beyond which a text of n characters is not of this language: by the logarithm of n between
        calibrated lengths.  Shorter texts may deviate more, by the square root of their length; longer ones as much as
        the longest calibrated, though they deviate less."""
        if self.usual is None:
            return np.full(len(n), np.inf)
        lengths, mean, more = self.usual
        at = np.log(n)
        return np.interp(at, np.log(lengths), mean) + np.interp(at, np.log(lengths), more) * np.sqrt(np.maximum(1.0, lengths[0] / n))

    def lookup(self, parts: np.ndarray) -> np.ndarray:
        """log P(last | the others) of rows of ORDER characters."""
        out = np.full(len(parts), self.floor)
        open_, back = np.arange(len(parts)), np.zeros(len(parts))
        for n in range(ORDER, 0, -1):
            k = gram_hash(parts[open_, ORDER - n :])
            i = np.minimum(np.searchsorted(self.grams[n], k), max(0, len(self.grams[n]) - 1))
            hit = self.grams[n][i] == k if len(self.grams[n]) else np.zeros(len(k), bool)
            out[open_[hit]] = back[open_[hit]] + self.logp[n][i[hit]]
            open_ = open_[~hit]
            if n > 1 and len(open_):
                c = gram_hash(parts[open_, ORDER - n : ORDER - 1])
                i = np.minimum(np.searchsorted(self.contexts[n - 1], c), max(0, len(self.contexts[n - 1]) - 1))
                hit = self.contexts[n - 1][i] == c
                back[open_] += np.where(hit, self.weight[n - 1][i], 0.0)
        out[open_] = back[open_] + self.floor
        return out


def gram_hash(parts: np.ndarray) -> np.ndarray:
    k = np.zeros(len(parts), np.uint64)
    for i in range(parts.shape[1]):
        k = (k << np.uint64(16)) | parts[:, i].astype(np.uint64)
    return mix(k, parts.shape[1])


def fit(codes: list[np.ndarray], alphabet: int) -> Model:
    """Interpolated Kneser-Ney: counts at the highest order, numbers of left neighbours below it."""
    rows = [np.lib.stride_tricks.sliding_window_view(c, ORDER) for c in codes if len(c) >= ORDER]
    top, count = np.unique(np.concatenate(rows) if rows else np.zeros((0, ORDER), np.uint16), axis=0, return_counts=True)
    grams, logp, contexts, weight = [[np.zeros(0, np.uint64)] * (ORDER + 1) for _ in range(4)]
    levels = {ORDER: (top, count.astype(float))}
    for n in range(ORDER - 1, 0, -1):
        u, c = np.unique(levels[n + 1][0][:, 1:], axis=0, return_counts=True)
        levels[n] = (u, c.astype(float))
    # from the shortest up: P_n = (c - D)+ / c(h) + D N1+(h.) / c(h) * P_{n-1}
    lower = None
    for n in range(1, ORDER + 1):
        u, c = levels[n]
        ones, twos = float((c == 1).sum()), float((c == 2).sum())
        d = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        if n == 1:
            total = c.sum() or 1.0
            p = np.maximum(c - d, 0) / total + d * len(c) / total / alphabet
            floor = float(np.log(d * max(1, len(c)) / total / alphabet))
        else:
            h, inv = np.unique(u[:, :-1], axis=0, return_inverse=True)
            inv = inv.ravel()
            total, kinds = np.bincount(inv, c), np.bincount(inv)
            back = d * kinds / total
            below = dict(zip(map(bytes, levels[n - 1][0]), lower, strict=True))
            p = np.maximum(c - d, 0) / total[inv] + back[inv] * np.array([below[bytes(x)] for x in np.ascontiguousarray(u[:, 1:])])
            k = gram_hash(h)
            o = np.argsort(k)
            contexts[n - 1], weight[n - 1] = k[o], np.log(back)[o]
        lower = p
        k = gram_hash(u)
        o = np.argsort(k)
        grams[n], logp[n] = k[o], np.log(p)[o]
    return Model(grams, logp, contexts, weight, floor)


class Identifier:
    """The models of all languages over one alphabet, with a direct-mapped cache of n-gram scores."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        classes = char_classes()
        texts = {l: [letters(t, classes) for t in samples[l]] for l in self.names}
        seen, n = np.unique(np.concatenate([x for v in texts.values() for x in v] or [np.zeros(0, np.uint32)]), return_counts=True)
        self.symbols = np.sort(seen[np.argsort(-n, kind="stable")][:ALPHABET])
        self._code()
        coded = {l: [self.code[x] for x in v] for l, v in texts.items()}
        held = {l: v[4::5] if len(v) > 4 else v for l, v in coded.items()}  # few texts calibrate on themselves
        self.models = [fit([c for i, c in enumerate(coded[l]) if i % 5 != 4 or len(coded[l]) < 5], len(self.symbols) + 1) for l in self.names]
        self._calibrate(held)

    def _calibrate(self, held: dict[str, list[np.ndarray]]) -> None:
        space = self.code[32]
        entropies: dict[tuple[int, int], list[np.ndarray]] = {}  # by (length, language)
        every: list[tuple[np.ndarray, int, int]] = []
        for i, l in enumerate(self.names):
            for c in held[l]:
                text = c[ORDER - 1 : -1]
                for length in [*(x for x in LENGTHS if x < len(text)), len(text)]:
                    whole = length == len(text)
                    for at in np.linspace(0, len(text) - length, 1 if whole else STRETCHES).astype(int) if length else ():
                        h = self._entropies(np.concatenate([np.full(ORDER - 1, space, c.dtype), text[at : at + length], [space]]))
                        every.append((h, length + 1, i))
                        if not whole:
                            entropies.setdefault((length, i), []).append(h[i])
        # how far texts of a length lie beyond their language's usual, in its standard deviations: one quantile for all languages
        least = 2 * STRETCHES
        for i in range(len(self.names)):
            lengths = [x for x in LENGTHS if x <= LIMITED and len(entropies.get((x, i), ())) >= least]
            mean = np.array([np.mean(entropies[x, i]) for x in lengths])
            more = []
            for x in lengths:
                groups = [np.array(v) for (y, _), v in entropies.items() if y == x and len(v) >= least]
                far = np.concatenate([(v - v.mean()) / max(1e-6, v.std()) for v in groups])
                more.append(float(np.quantile(far, 1 - FALSE_REJECTIONS)) * float(np.std(entropies[x, i])))
            if lengths:
                self.models[i].usual = (np.array(lengths, float), mean, np.array(more))
        # the temperature under which the held-back choices are likeliest
        self.sharpness, self.power = float(SHARPNESS[0]), 0.0
        if every:
            h, n, truth = np.array([x for x, _, _ in every]), np.array([x for _, x, _ in every], float), np.array([x for _, _, x in every])
            gaps, right = h.min(1)[:, None] - h, h.argmin(1) == truth
            best = np.inf
            for power in POWERS:
                for s in SHARPNESS:
                    p = np.clip(1 / np.exp(np.clip(gaps * (s * n**power)[:, None], -50, 0)).sum(1), 1e-9, 1 - 1e-4)
                    loss = -np.log(np.where(right, p, 1 - p)).mean()
                    if loss < best:
                        best, self.sharpness, self.power = loss, float(s), power

    def _code(self):
        self.code = np.full(0x110000, 0, np.uint16)
        self.code[self.symbols] = np.arange(1, len(self.symbols) + 1)
        self.whole = self.code[char_classes()]

    def __getstate__(self):
        return {"names": self.names, "symbols": self.symbols, "models": self.models, "sharpness": self.sharpness, "power": self.power}

    def __setstate__(self, s):
        self.__dict__ |= s
        self._code()

    def _scores(self, codes: np.ndarray) -> np.ndarray:
        if not hasattr(self, "slot_key"):
            self.slot_key = np.full(SLOTS, 2**64 - 1, np.uint64)  # no key: codes are smaller than 2**16 - 1
            self.slot = np.zeros((SLOTS, len(self.names)), np.float32)
        k = np.zeros(len(codes) - ORDER + 1, np.uint64)
        for i in range(ORDER):
            k = (k << np.uint64(16)) | codes[i : len(codes) - ORDER + 1 + i]
        at = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 19)).astype(np.int64)
        miss = np.flatnonzero(self.slot_key[at] != k)
        fresh = None
        if len(miss):
            u, inv = np.unique(k[miss], return_inverse=True)
            parts = np.stack([(u >> np.uint64(16 * (ORDER - 1 - i))) & np.uint64(0xFFFF) for i in range(ORDER)], 1)
            s = np.stack([m.lookup(parts) for m in self.models], 1).astype(np.float32)
            fresh = s[inv]
        out = self.slot[at]
        if fresh is not None:
            out[miss] = fresh
            self.slot_key[at[miss]], self.slot[at[miss]] = k[miss], fresh
        return out

    def _entropies(self, codes: np.ndarray) -> np.ndarray:
        return -self._scores(codes).mean(0) if len(codes) >= ORDER else np.zeros(len(self.names))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and whether the text fits none; cuts a batch into blocks of 1M characters."""
        names, score, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.names:
            return names, score, rejected
        space, block, ids, size = self.code[32], [], [], 0

        def flush():
            codes, ends = np.concatenate(block), np.cumsum([len(b) for b in block])
            starts = ends - [len(b) for b in block]
            total = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(self._scores(codes), 0, dtype=np.float64)])
            n = np.maximum(ends - starts - ORDER + 1, 1)
            h = -(total[starts + n] - total[starts]) / n[:, None]
            best = h.argmin(1)
            z = np.exp(np.clip((h.min(1)[:, None] - h) * (self.sharpness * n.astype(float) ** self.power)[:, None], -50, 0))
            limit = np.stack([m.limit(n) for m in self.models], 1)
            for i, b, p, low, most in zip(ids, best, 1 / z.sum(1), h.min(1), limit[np.arange(len(best)), best], strict=True):
                names[i], score[i], rejected[i] = self.names[b], p, low > most

        for i, t in enumerate(texts):
            if not t:
                continue
            raw = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
            c = self.whole[raw]
            if not (c != space).any():
                continue
            c = np.concatenate([[space], c, [space]])
            c = c[np.concatenate([[True], (c[1:] != space) | (c[:-1] != space)])]
            block.append(np.concatenate([np.full(ORDER - 2, space, np.uint16), c]))
            ids.append(i)
            size += len(c)
            if size > 1 << 20:
                flush()
                block, ids, size = [], [], 0
        if block:
            flush()
        return names, score, rejected


def train(docs: DataFrame, rows: int = TRAINING_ROWS) -> Identifier:
    """Fits on at most `rows` rows of each language with crc32(doc_id) mod 5 other than 0; the driver holds
    rows * TRAINING_CHARACTERS characters a language at most."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where((id_remainder("doc_id", 5) != 0) & (F.length("text") <= TRAINING_CHARACTERS))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [r[0] for r in known.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).select("doc_id").collect()]
    samples: dict[str, list[str]] = {}
    for lang, text in known.where(F.col("doc_id").isin(ids)).orderBy("doc_id").select("lang", "text").toLocalIterator() if ids else ():
        samples.setdefault(lang, []).append(text)
    return Identifier(samples)


def identify(docs: DataFrame, model: Identifier, key: str = "doc_id") -> DataFrame:
    """Adds lang_pred, score and rejected to the key and text of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAINING_ROWS texts a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            names, score, rejected = m.predict(list(b["text"]))
            yield pd.DataFrame({"key": b["key"], "lang_pred": names, "score": score, "rejected": rejected})

    return docs.select(F.col(key).alias("key"), "text").mapInPandas(run, "key bigint, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")

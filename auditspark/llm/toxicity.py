"""Operator 5: toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words and their beginnings, hashed, once more where they recur.  The machine scores
w0 + sum w_i + sum_{i<j} <v_i, v_j> over the terms present, so that a pair of terms can weigh more
(or less) than both do alone.  Terms without significant association in the training rows are
left out before training.

Nulls, empty texts and texts without letters have no terms and score the base rate.  Without training rows,
or with clean ones alone, every text scores (all but) 0; with toxic ones alone every text scores their smoothed
rate.  A machine fitted without both classes says so (`informed`).  Labels come
from training rows only; ids without a label, or with a null one, train nothing; of repeated
labels the highest counts.  Whole texts are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, id_remainder, read, through_parquet

WORD = re.compile(r"[^\W\d_]+")
BITS = 20
#: Beginnings of words that count as terms, by length.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A term counts again where it occurs so often.
LEVELS = (1, 2, 4)
#: At most so many labelled rows train the machine, those whose id hashes lowest.
TRAINING_ROWS = 8000
#: Terms kept: at least so many training rows have them, with at least this likelihood-ratio statistic.
LEAST_ROWS, LEAST_G, MOST_TERMS = 3, 20.0, 1024
FACTORS = 4


def word_terms(word: str) -> list[int]:
    """Hashes of the word and of its proper beginnings."""
    return [zlib.crc32(word.encode()), *(zlib.crc32(f"{word[:n]}*".encode()) for n in BEGINNINGS if len(word) > n)]


def at_level(term: int, level: int) -> int:
    """The bucket that says that a term occurs at least LEVELS[level] times."""
    return ((term + level * 0x5BD1E995) * 0x9E3779B1 >> 9) & ((1 << BITS) - 1)


def terms(text: str | None) -> list[int]:
    counts: Counter[int] = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items() if text else ():
        for t in word_terms(w):
            counts[t] += n
    return sorted({at_level(t, k) for t, n in counts.items() for k, least in enumerate(LEVELS) if n >= least})


@dataclass
class Machine:
    index: dict[int, int]
    w0: float
    w: np.ndarray
    v: np.ndarray
    #: Whether it has seen both classes.
    informed: bool = True

    def scores(self, present: list[set[int]]) -> np.ndarray:
        s = np.full(len(present), self.w0)
        for i, p in enumerate(present):
            if p:
                k = np.fromiter(p, np.int64, len(p))
                k.sort()
                v = self.v[k]
                s[i] += self.w[k].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-s))


def uninformed(pos: float) -> Machine:
    return Machine({}, float(np.log(pos + 1)) if pos else -40.0, np.zeros(0), np.zeros((0, FACTORS)), informed=False)


def significant(often: np.ndarray, in0: np.ndarray, in1: np.ndarray, n: int, pos: float) -> np.ndarray:
    """The terms kept, ascending, of those (ascending) that in0 clean and in1 toxic rows have."""
    in0, in1 = in0.astype(float), in1.astype(float)
    x = np.array([in1, in0, pos - in1, n - pos - in0])
    both, rest = in1 + in0, n - in1 - in0
    expect = np.array([both * pos / n, both * (n - pos) / n, rest * pos / n, rest * (n - pos) / n])
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * np.where(x > 0, x * np.log(x / expect), 0).sum(0)
    keep = np.flatnonzero(g >= LEAST_G)
    return often[np.sort(keep[np.argsort(-g[keep], kind="stable")][:MOST_TERMS])]


def places(terms: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Where in `keep` (ascending) those of the terms stand that it holds."""
    if not len(keep):
        return np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(keep, terms), len(keep) - 1)
    return i[keep[i] == terms]


def fit(rows: list[np.ndarray], y: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 2e-3) -> Machine:
    """The machine of rows given by all their terms."""
    n, pos = len(y), float(y.sum())
    if n == 0 or pos in (0, n):
        return uninformed(pos)
    counts = np.zeros((2, 1 << BITS), np.int32)
    for r, t in zip(rows, y, strict=True):  # a row's terms are distinct
        counts[int(t > 0), r] += 1
    often = np.flatnonzero(counts.sum(0) >= LEAST_ROWS)  # the statistics are of these alone
    keep = significant(often, *counts[:, often], n, pos)
    return descended(keep, [places(r, keep) for r in rows], y, steps, rate, decay)


def descended(keep: np.ndarray, present: list[np.ndarray], y: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 2e-3) -> Machine:
    """Adam on the log loss, over all rows at each step; present: each row's places in keep."""
    n, pos = len(y), float(y.sum())
    m = np.zeros((n, len(keep)), np.float32)
    for i, c in enumerate(present):
        m[i, c] = 1
    rng = np.random.default_rng(5)
    p = [np.array([np.log(pos / (n - pos))]), np.zeros(len(keep)), rng.normal(0, 0.02, (len(keep), FACTORS))]
    m1, m2 = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        w, v = p[1].astype(np.float32), p[2].astype(np.float32)  # of m's type, lest each product copy m
        mv = m @ v
        s = p[0] + m @ w + 0.5 * ((mv**2).sum(1) - m @ (v**2).sum(1))
        d = ((1 / (1 + np.exp(-s)) - y) / n).astype(np.float32)
        gw = m.T @ d
        grads = [np.array([d.sum()], float), gw + decay * p[1] / max(1, len(keep)), m.T @ (d[:, None] * mv) - p[2] * gw[:, None] + decay * p[2]]
        for a, b, c, gr in zip(p, m1, m2, grads, strict=True):
            b += 0.1 * (gr - b)
            c += 0.01 * (gr**2 - c)
            a -= rate * (b / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.99**t)) + 1e-8)
    return Machine({int(k): i for i, k in enumerate(keep)}, float(p[0][0]), p[1], p[2])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Machine:
    """Fits on the `most` labelled training rows (crc32(doc_id) mod 4 is not 2) whose ids hash lowest.

    Their terms are counted by Spark; of the terms, the driver gets the counts of those in LEAST_ROWS rows or more, and
    of the rows only the places of the terms kept."""
    marked = labels.where("doc_id is not null and toxic is not null").where(id_remainder("doc_id", 4) != 2).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = docs.where("doc_id is not null").select("doc_id").distinct()
    sample = cut_lineage(marked.join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "terms": [terms(t) for t in b["text"]]})

    rows = through_parquet(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").mapInPandas(run, "doc_id bigint, toxic int, terms array<int>"), "terms")
    n, pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n == 0 or pos in (0, n):
        return uninformed(float(pos))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for r, t in zip(b["terms"], b["toxic"], strict=True):  # a row's terms are distinct
                found[t, r] += 1
        some = np.flatnonzero(found.any(0))
        yield pd.DataFrame({"term": some, "in0": found[0, some], "in1": found[1, some]})

    counts = rows.mapInPandas(count, "term int, in0 int, in1 int").groupBy("term").agg(F.sum("in0").cast("int").alias("in0"), F.sum("in1").cast("int").alias("in1"))
    often = counts.where(F.col("in0") + F.col("in1") >= LEAST_ROWS).toPandas().sort_values("term")
    keep = significant(*(often[c].to_numpy() for c in ("term", "in0", "in1")), n, float(pos))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "present": [places(r, keep).tolist() for r in b["terms"]]})

    held = rows.mapInPandas(kept, "doc_id bigint, toxic int, present array<smallint>").toArrow().sort_by("doc_id")
    present = held["present"].combine_chunks()
    ends = present.offsets.to_numpy()
    return descended(keep, [present.values.to_numpy()[a:b] for a, b in zip(ends, ends[1:], strict=False)], held["toxic"].to_numpy().astype(float))


def scorer(machine: Machine):
    """A pandas UDF text -> score."""
    cache: dict[str, tuple[int, ...]] = {}

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        index, present = machine.index, []
        for t in batch:
            counts: dict[int, int] = {}
            for w in WORD.findall(t.lower()) if t else ():
                hit = cache.get(w)
                if hit is None:
                    if len(cache) > 300_000:
                        cache.clear()
                    hit = cache[w] = tuple(k for k in word_terms(w) if any(at_level(k, i) in index for i in range(len(LEVELS))))
                for k in hit:
                    counts[k] = counts.get(k, 0) + 1
            p = {index[b] for k, n in counts.items() for i, least in enumerate(LEVELS) if n >= least and (b := at_level(k, i)) in index}
            present.append(p)
        return pd.Series(machine.scores(present))

    return score


def op5_toxicity(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    score = scorer(train(docs, read(spark, sf_dir, "labels")))
    return docs.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

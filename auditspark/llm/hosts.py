"""Operator 13: quality rules judged by host.

Every document is measured; rules fail it or not.  Failures are summed by host (`source`), and each
rule's failure rate of a host is shrunk towards the rate of all documents: hosts' rates are taken for
draws of a beta distribution, whose mean and concentration are estimated from the hosts (method of
moments, sampling noise taken off), so a host of few documents keeps near the mean and one of many
keeps its own rate.  A host is bad if, for some rule, its shrunken rate is above LIMIT and exceeds the
mean by more than DEVIATIONS posterior standard deviations.  The verdict joins back to all its documents.

Documents without a source have no host: they count for the prior as one group, but no host's verdict
falls on them.  Null and empty texts have no words, hence fail the base rule of length.  With one host, or hosts that
differ no more than by chance, the concentration has no upper bound and all rates are the mean: no host is
bad.  Repeated rows count singly and have equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, joined_back, read

WORD, SYMBOL = re.compile("[^ \t-\r]+"), re.compile(r"[#*$%&|<>]")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: A host's shrunken failure rate above which it may be bad, and by how many deviations it must exceed the mean.
LIMIT, DEVIATIONS = 0.5, 3.0
#: Concentration where hosts differ no more than by chance.
ENDLESS = 1e12


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    once: set[tuple[int, int, int]] = set()
    again: set[tuple[int, int, int]] = set()
    windows = list(zip(ids, ids[1:], ids[2:], strict=False))
    for w in windows:
        (again if w in once else once).add(w)
    covered, end = 0, 0
    if again:
        for i, w in enumerate(windows):
            if w in again:
                covered += i + 3 - max(i, end)
                end = i + 3
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), covered


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measures(t.as_py()) for t in b.column(2)]  # one text at a time, for texts may be long
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "source", *MEASURES])

    schema = "doc_id bigint, source string, " + ", ".join(f"{m} bigint" for m in MEASURES)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, schema)


#: Rules that fail a document, over its measures.  The first two are the base, which fails it by itself.
RULES: dict[str, Column | str] = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "copied_lines": "n_dup_lines > 0 AND 10 * n_dup_lines > n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}
BASE = ["short", "repetitive"]


@dataclass(frozen=True)
class Prior:
    """A beta distribution of hosts' rates."""

    mean: float
    concentration: float


def counts(rows: DataFrame) -> DataFrame:
    """source, n and the failures of every rule, a row a host."""
    fails = [F.count(F.when(F.expr(test), True)).alias(f"f_{name}") for name, test in RULES.items()]
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *fails)


def priors(hosts: DataFrame) -> dict[str, Prior]:
    """Each rule's prior: its mean m is the rate of all documents; by the moments of rates weighted with the
    documents, the variance between hosts is v = m (1 - m) / (c + 1) for the concentration c."""
    sums = [F.sum(F.expr(f"CAST(f_{r} AS DOUBLE) * f_{r} / n")).alias(f"q_{r}") for r in RULES] + [F.sum(f"f_{r}").alias(f"s_{r}") for r in RULES]
    x = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.expr("CAST(n AS DOUBLE) * n")).alias("nn"), *sums).first()
    return {r: prior(x["k"], x["n"] or 0, x["nn"] or 0.0, x[f"s_{r}"] or 0, x[f"q_{r}"] or 0.0) for r in RULES}


def prior(k: int, n: int, nn: float, s: int, q: float) -> Prior:
    """k hosts with n documents (nn: sum of their squares), s failures (q: sum of failures squared by documents)."""
    if n == 0:
        return Prior(0.0, ENDLESS)
    m = s / n
    noise = m * (1 - m)
    between = q - n * m * m - (k - 1) * noise  # of sum n (rate - m)^2, what sampling does not explain
    spread = n - nn / n
    v = between / spread if spread > 0 else 0.0
    v = max(0.0, round(v, 12))  # sums come in any order
    return Prior(round(m, 12), min(ENDLESS, max(0.0, noise / v - 1)) if v > 0 else ENDLESS)


def judged(hosts: DataFrame, fitted: dict[str, Prior], limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """hosts with the shrunken rate of every rule (r_...) and whether the host is bad."""
    bad = F.lit(False)
    rates = {}
    for r, p in fitted.items():
        total = F.col("n") + F.lit(p.concentration)
        rate = (F.col(f"f_{r}") + F.lit(p.mean * p.concentration)) / total
        rates[f"r_{r}"] = F.round(rate, 9)
        bad = bad | ((rate > limit) & (rate - p.mean > deviations * F.sqrt(rate * (1 - rate) / (total + 1))))
    return hosts.withColumns(rates).withColumn("host_bad", bad & F.col("source").isNotNull())


def op13_host_rules(spark, sf_dir: str) -> DataFrame:
    rows = cut_lineage(measured(read(spark, sf_dir, "documents")))
    hosts = cut_lineage(counts(rows))
    verdicts = judged(hosts, priors(hosts)).select("source", "n", "host_bad", *[f"r_{r}" for r in RULES])
    base = F.expr(" OR ".join(f"({RULES[r]})" for r in BASE))
    out = joined_back(rows, verdicts, "source", "n").withColumn("base_failed", base)
    rate = {f"host_{r}_rate": F.col(f"r_{r}") for r in BASE}
    return out.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~F.col("host_bad")).alias("kept"), F.col("host_bad"), *[c.alias(n) for n, c in rate.items()])

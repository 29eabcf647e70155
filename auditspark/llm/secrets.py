"""Operator 4: secret scans.

Three fixed patterns find declared secrets.  Beside them, two character Markov models - one of
random strings, one of ordinary identifiers, both trained from labelled samples - are compared by
log-likelihood ratio over every unbroken run of identifier characters that no base span covers whole.
A run that the random model explains better by a margin is a span of kind `markov` if one of its pieces, between
slashes, underscores and hyphens, is random too: names and numbers that only look random together are none.  In
any other run each long piece that is random by itself is a span, and so is what base spans leave of the run.  The
margin is calibrated on samples held back from the models.

Ordinary identifiers are common words and the corpus's own, alone and joined as programs join them: snake, camel
and upper case, kebab names with dates and versions, paths, URLs, rulers and sequences of the alphabet or digits.

Null and empty texts have no spans.  Whole texts are scanned, whatever their length; repeated rows
are scanned alike.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORD = re.compile(r"[A-Za-z]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
#: What the Markov models read: unbroken runs of at least RUN identifier characters.  A random run has a random piece of
#: PIECE or more; a piece of LONE or more counts in any run.
RUN, PIECE, LONE = 14, 13, 20
RUNS = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % RUN)
PIECES = re.compile(r"[A-Za-z0-9+]{%d,}" % PIECE)
#: Words of so many letters or more may be secrets themselves and are not learned as ordinary.
WORD_LETTERS = 20
#: Nats by which the random model must win over the whole run: secrets are taken to be one run in 500,000.
MARGIN = 13.0
#: The margin per character lies midway between what these shares of the held-back runs stay below, and above this of the
#: ordinary ones in any case.
ORDINARY_BELOW, RANDOM_ABOVE = 0.999, 0.01
#: Documents and words that the ordinary sample is drawn from, and identifiers made of them.
SAMPLE_ROWS, SAMPLE_WORDS, SAMPLE_RUNS = 500, 20_000, 12_000

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}


#: Labelled samples of the words of ordinary identifiers, beside the corpus's own.
COMMON = """abstract access account action adapter address admin alias analysis angle api application archive argument array
article asset attribute audio author backup balance base batch binary block board book border boundary box branch bridge browser
buffer build bundle business button byte cache calendar callback candidate category center channel character chart check city class
client clone cloud cluster code collection column command comment common community compiler component compute config connection
constant container content context controller cookie core corporation count country cover create cursor customer dashboard data
database date default delete description design development device dictionary digest directory document domain download driver edit
editor element email engine entity entry error event example exception factory feature file filter format frame function gallery
game gateway global graph group handler hash header health history home host html image implementation import index info input
instance integer interface international invoice item job journal kernel key label language layer library license line link list
loader local location lock log machine main manager map market master media member memory menu message method metric mobile model
module monitor name network node notification number object option order output package page parser path payment platform player
plugin policy pool post price private process product profile project property protocol provider proxy public query queue random
record reference region register release remote render report request resource response result review role route rule sample
schedule schema script search section security select server service session setting shadow shared signal single site snapshot
source stack state status storage store stream string structure style subject summary support switch symbol system table target task
template test text thread time title token tool topic tracker transaction transform tree trigger type update upload user utility
value variable vector version video view virtual visitor web window worker workflow world wrapper writer""".split()


class Markov:
    """Second-order character model, smoothed towards the first-order one and that towards the characters'
    own frequencies; code 0 stands before a run."""

    def __init__(self, samples: list[str], weight: float = 4.0):
        k = len(ALPHABET) + 1
        n = np.zeros((k, k, k))
        for s in samples:
            a = np.array([0, 0, *(CODE[c] for c in s if c in CODE)])
            np.add.at(n, (a[:-2], a[1:-1], a[2:]), 1)
        n = n[:, :, 1:]
        alone = (n.sum((0, 1)) + 0.2) / (n.sum() + 0.2 * len(ALPHABET))
        one = (n.sum(0) + weight * alone) / (n.sum((0, 2))[:, None] + weight)
        self.log = np.log((n + weight * one) / (n.sum(2, keepdims=True) + weight))


def random_samples(per_kind: int = 600, seed: int = 7) -> list[str]:
    """Labelled samples of random strings: uniform draws over the usual alphabets of keys."""
    r = np.random.default_rng(seed)
    sets = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[:26] + "0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", ALPHABET[:62] + "_-"]
    return ["".join(r.choice(list(s), size=int(r.integers(RUN, 48)))) for s in sets for _ in range(per_kind)]


def ordinary_runs(words: list[str], n: int = SAMPLE_RUNS, seed: int = 5) -> list[str]:
    """Labelled samples of ordinary identifiers of RUN characters or more, made of the words given."""
    r = np.random.default_rng(seed)
    pools = [COMMON, [w.lower() for w in words] or COMMON]
    draw = lambda k: [p[r.integers(0, len(p))] for p in (pools[x] for x in r.integers(0, 2, k))]
    number = lambda most: str(r.integers(0, most))
    date = lambda: f"{r.integers(1990, 2040)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}"

    def camel(k: int) -> str:
        return "".join(w.capitalize() for w in draw(k))

    def one(kind: int, k: int) -> str:
        if kind == 0:
            return "_".join(draw(k))
        if kind == 1:
            return "_".join(draw(k)).upper()
        if kind == 2:
            return camel(k)
        if kind == 3:
            return draw(1)[0] + camel(k)
        if kind == 4:
            return "-".join(draw(k)) + (f"-v{number(30)}" if r.random() < 0.4 else "")
        if kind == 5:
            return f"{date()}-{'-'.join(draw(k))}"
        if kind == 6:
            return "/".join(draw(k)) + (f"/{number(10_000)}" if r.random() < 0.4 else "")
        if kind == 7:
            return f"/{draw(1)[0]}/{camel(2)}/{'_'.join(draw(k))}{number(100)}"
        if kind == 8:
            return f"//{draw(1)[0]}/{'-'.join(draw(k))}/{date().replace('-', '/')}"
        if kind == 10:  # a stretch of a sequence that everyone knows
            row = str(r.choice(["abcdefghijklmnopqrstuvwxyz", "0123456789", "qwertyuiopasdfghjklzxcvbnm"])) * 4
            a = int(r.integers(0, 26))
            return (row if r.random() < 0.5 else row.upper())[a : a + int(r.integers(RUN, 40))]
        if kind == 9:  # a ruler, or a run of one character
            return str(r.choice(list("---___///++x0aA1"))) * int(r.integers(RUN, 80))
        return f"{'_'.join(draw(k))}_{date().replace('-', '')}" + (f"_{number(1_000_000)}" if r.random() < 0.4 else "")

    out = []
    while len(out) < n:
        run, k = "", 2
        while len(run) < RUN:
            run, k = one(len(out) % 12, k), k + 1
        out.append(run[:120])
    return out


class Detector:
    """The log-likelihood ratios, and the margin per character that held-back samples calibrate."""

    def __init__(self, words: list[str]):
        words = [w for w in words if len(w) < WORD_LETTERS]
        ordinary, strings = ordinary_runs(words), random_samples()
        fit = lambda samples: [x for i, x in enumerate(samples) if i % 5]
        self.ratio = Markov(fit(strings)).log - Markov(words + COMMON + fit(ordinary)).log
        held = np.array([score(x, self.ratio) / len(x) for run in ordinary[::5] for x in (run, *PIECES.findall(run))])
        drawn = np.array([score(x, self.ratio) / len(x) for x in strings[::5]])
        below, above = float(np.quantile(held, ORDINARY_BELOW)), float(np.quantile(drawn, RANDOM_ABOVE))
        self.per_character = max(0.05, below, (below + above) / 2)
        self.recall = float(np.mean([self.random(x) for x in strings[::5]]))
        self.false_alarms = float(np.mean([self.random(x) for x in ordinary[::5]]))

    def likelier(self, run: str) -> bool:
        """Whether the random model explains these characters better by the margin."""
        s = score(run, self.ratio)
        return s >= MARGIN and s >= self.per_character * len(run)

    def random(self, run: str) -> bool:
        pieces = PIECES.findall(run)
        return bool(pieces) and self.likelier(run) and (pieces == [run] or any(map(self.likelier, pieces)))

    def parts(self, run: str) -> list[tuple[int, int]]:
        """What of a run is random: all of it, or its long pieces that are so by themselves."""
        if self.random(run):
            return [(0, len(run))]
        return [m.span() for m in PIECES.finditer(run) if LONE <= len(m[0]) < len(run) and self.likelier(m[0])]


def score(run: str, ratio: np.ndarray) -> float:
    a = np.array([0, 0, *(CODE[c] for c in run)])
    return float(ratio[a[:-2], a[1:-1], a[2:] - 1].sum())


def spans(text: str, detector: Detector) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, sorted."""
    found = []
    if ("=" in text or ":" in text) and any(k in (low := text.lower()) for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(found)
    starts = [s for s, _, _ in base]
    ends = list(itertools.accumulate((e for _, _, e in base), max))
    for m in RUNS.finditer(text):
        a, b = m.span()
        i = bisect.bisect_right(starts, a)
        if i and ends[i - 1] >= b:
            continue
        parts = [(a + x, a + y) for x, y in detector.parts(m[0])]
        if not parts:  # what base spans leave of the run, by itself
            at = a
            for k in range(bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)):
                start, _, end = base[k]
                parts += [(at, start)] if start - at >= PIECE and detector.random(text[at:start]) else []
                at = max(at, end)
            parts += [(at, b)] if a < at and b - at >= PIECE and detector.random(text[at:b]) else []
        found += [(x, 3, y) for x, y in parts if not ((i := bisect.bisect_right(starts, x)) and ends[i - 1] >= y)]
    return sorted(found)


def ordinary_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_WORDS) -> list[str]:
    """The words of the `rows` documents whose id hashes lowest, at most `most` by their own hash, without
    what the fixed patterns find.  Only the words reach the driver; a word that `rows` documents have
    thousands of times is one."""
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words: set[str] = set()
            for text in b["text"]:
                for p in (ASSIGN, ACCESS, HEX):
                    text = p.sub(" ", text)
                words |= {w for w in WORD.findall(text) if len(w) < WORD_LETTERS}
            yield pd.DataFrame({"word": sorted(words)})

    found = docs.where("text is not null").join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInPandas(run, "word string")
    return [r[0] for r in found.distinct().orderBy(F.md5("word"), "word").limit(most).collect()]


def scan(docs: DataFrame, detector: Detector, key: str = "doc_id") -> DataFrame:
    """One row per document: the key and its spans (start, kind, end)."""
    kinds = "array<struct<start:bigint,kind:int,end:bigint>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "spans": [[{"start": s, "kind": k, "end": e} for s, k, e in spans(t, detector)] if t else [] for t in b["text"]]})

    return docs.select(key, "text").mapInPandas(run, f"{key} bigint, spans {kinds}")


def redact(docs: DataFrame, detector: Detector, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by `mark` and n_chars counted again; all rows stay."""

    def clean(text: str) -> str:
        out, at = [], 0
        for s, _, e in spans(text, detector):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join(out) + text[at:] if out else text

    @F.pandas_udf("string")
    def cleaned(t: pd.Series) -> pd.Series:
        return t.map(lambda x: clean(x) if x else x)

    out = docs.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def op4_markov_secrets(spark, sf_dir: str) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents")
    found = scan(docs, Detector(ordinary_sample(docs)))
    name = F.array(*[F.lit(k) for k in KINDS])
    text = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text(lambda s: s["kind"] < 3).cast("binary"), 256).alias("base_sha256"), text(lambda s: s["kind"] >= 0).alias("spans"), count(3).alias("n_markov"),
    )

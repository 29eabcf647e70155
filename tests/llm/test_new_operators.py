"""Operators 11 to 13 against brute force: nulls, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditspark.llm import codes, hosts, prefixes

from .conftest import table

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error long, n long, __key string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "k") for r in rows], VECTORS).repartition(3)


def brute_codes(rows):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 16
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min(range(len(books[p])), key=lambda e: (gap(books[p][e], part(v, p)), e))
    for _ in range(2):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(16):
                members[p, near(p, v)].append(part(v, p))
        for (p, e), m in members.items():
            books[p][e] = [sum(x) // len(m) for x in zip(*m, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    found = [(i, label, [near(p, v) for p in range(16)], sum(gap(books[p][near(p, v)], part(v, p)) for p in range(16))) for i, v, label in kept]
    total = Counter()
    for _, label, _, e in found:
        total[label] += e
    return sorted(repr((i, "".join(f"{x:02x}" for x in c), e, total[label], sha)) for i, label, c, e in found)


@pytest.mark.parametrize("size", [1.0, 1e6])
def test_codes(spark, tmp_path, size):
    """Also with components beyond int64's squares, null ids and labels, a hot label and repeated rows."""
    r = random.Random(3)
    rows = [(i, [float(f"{r.gauss(0, 0.2):.4f}") * (size if i % 7 == 0 else 1) for _ in range(32)], None if i % 5 == 0 else 1 if i % 3 else i) for i in range(300)]
    rows += [(300, None, 1), (301, [float("nan")] * 32, 1), (302, [0.5] * 31 + [None], 1), (303, [float("inf")] * 32, 2), (None, [0.1] * 32, 4), (None, [0.2] * 32, None), rows[5], rows[5], (4, [0.3] * 32, 9)]
    rows = [(i, v and [None if x is None else float(__import__("numpy").float32(x)) for x in v], label) for i, v, label in rows]
    got = sorted(repr(tuple(x)) for x in codes.op11_vector_codes(spark, table(spark, tmp_path, embeddings=vectors(spark, rows))).collect())
    assert got == brute_codes(rows)


def test_codes_few_and_none(spark, tmp_path):
    few = vectors(spark, [(1, [0.0] * 16, 1), (2, [1.0] * 16, None)])
    got = {r.vec_id: (r.code, r.error) for r in codes.op11_vector_codes(spark, table(spark, tmp_path / "few", embeddings=few)).collect()}
    assert got == {1: ("00" * 16, 0), 2: ("01" * 16, 0)}
    none = codes.op11_vector_codes(spark, table(spark, tmp_path / "none", embeddings=few.limit(0)))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="one length"):
        codes.op11_vector_codes(spark, table(spark, tmp_path / "odd", embeddings=vectors(spark, [(1, [0.0] * 15, 1)])))


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    out = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
        out.append(repr((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), sum(not kids[x] for x in below), saved, sha)))
    return sorted(out)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, b"n", 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, parent string, depth int, node binary, n int").repartition(3)


def test_trie(spark, tmp_path):
    """Long chains, copies, ties, nulls, absent family heads, negative ids, repeated rows, conversations left without turns."""
    r = random.Random(4)
    say = lambda: (r.choice(["user", "assistant", None]), r.choice(["a", "bb", "ccc", None, "long text " * 50]))
    rows = [(c, t, *say()) for c in [*range(0, 40), *range(100, 130), *range(205, 220), -7, -100] for t in range(r.choice([1, 2, 5, 9]))]
    rows += [(150, t, "user", "same") for t in range(60)] + [(c, t, "user", f"copy {t}") for c in range(300, 340) for t in range(4)]
    rows += [(410, None, "user", "first"), (410, 3, "b", "tie"), (410, 3, "a", "tie"), (410, 3, "a", "tie"), (None, 0, "user", "nowhere"), (0, None, None, None)]
    got = prefixes.op12_prefix_trie(spark, table(spark, tmp_path, conversations=conversations(spark, rows)))
    assert sorted(repr(tuple(x)) for x in got.collect()) == brute_trie(rows)


def test_trie_long_and_none(spark, tmp_path):
    """A chain of 300 turns with branches at every tenth, whose subtree is peeled from the leaves; no rows."""
    rows = [(500 + k, t, "u", f"{t}" if t < 10 * k else f"own {k} {t}") for k in range(10) for t in range(300 if k == 9 else 10 * k + 2)]
    got = prefixes.op12_prefix_trie(spark, table(spark, tmp_path / "long", conversations=conversations(spark, rows)))
    assert sorted(repr(tuple(x)) for x in got.collect()) == brute_trie(rows)
    none = prefixes.op12_prefix_trie(spark, table(spark, tmp_path / "none", conversations=conversations(spark, rows).limit(0)))
    assert none.count() == 0


def test_member_hashes_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 7)
    rows = [(b"a" * 16, i) for i in random.Random(1).sample(range(-50, 1000), 500)] + [(bytes([b]) * 16, b) for b in range(20)]
    got = {bytes(r.node): r.ends_sha256 for r in prefixes.member_hashes(spark.createDataFrame(rows, "node binary, conv_id bigint").repartition(5)).collect()}
    want = defaultdict(list)
    for n, c in rows:
        want[n].append(c)
    assert got == {n: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest() for n, c in want.items()}


def brute_measures(text):
    import re

    words = re.findall("[^ \t-\r]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


def test_measures():
    r = random.Random(5)
    texts = [None, "", " \n ", "a b c a b c a", "x y z x y z x y z", "\n".join(["same line"] * 4 + [" ", " "]), "é ü 漢   #|<>"] + [" ".join(r.choice("ab\ncd#") for _ in range(r.randrange(1, 60))) for _ in range(300)]
    assert [hosts.measures(t) for t in texts] == [brute_measures(t) for t in texts]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, True) for i, t, s in rows], "doc_id bigint, text string, source string, n string, n_words int, host_bad boolean").repartition(3)


def test_hosts(spark, tmp_path):
    """A host whose documents mostly fail takes its good ones along; a small host with one bad document does not."""
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, f"good{i % 5}") for i in range(200)] + [(1000 + i, good if i % 4 == 0 else "too short", "bad") for i in range(100)]
    rows += [(2000, "short", "small"), (2001, None, None), (None, good, None), (2002, "", "good1"), (7, good, "good2"), (7, good, "good2")]
    got = hosts.op13_host_rules(spark, table(spark, tmp_path, documents=documents(spark, rows)))
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        bad = r.doc_id is not None and 1000 <= r.doc_id < 1100
        assert r.host_bad == bad and r.kept == (not bad and r.n_words >= 50) and r.base_failed == (r.n_words < 50)
    assert hosts.op13_host_rules(spark, table(spark, tmp_path / "none", documents=documents(spark, rows).limit(0))).count() == 0


def test_prior_finds_the_distribution():
    """Rates drawn from a beta distribution give its concentration back; equal rates give an endless one."""
    r = random.Random(6)
    draws = [(n, sum(r.random() < p for _ in range(n))) for n, p in ((r.randrange(20, 400), r.betavariate(2, 8)) for _ in range(3000))]
    of = lambda d: hosts.prior(len(d), sum(n for n, _ in d), float(sum(n * n for n, _ in d)), sum(f for _, f in d), sum(f * f / n for n, f in d))
    p = of(draws)
    assert abs(p.mean - 0.2) < 0.01 and 8 < p.concentration < 12.5
    assert of([(100, 20)] * 50).concentration == hosts.ENDLESS and of([(10, 9)]).concentration == hosts.ENDLESS and of([]).mean == 0


def test_joined_back_splits_hot_keys(spark):
    rows = spark.createDataFrame([(None if i % 3 else i, i) for i in range(300)], "k int, x int")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    from auditspark.llm.common import joined_back

    got = joined_back(rows, groups, "k", "n")
    null = sum(i for i in range(300) if i % 3)
    assert sorted((r.x, r.s) for r in got.collect()) == [(i, null if i % 3 else i) for i in range(300)]
    assert got.columns == ["k", "x", "s"]

"""Operators 3 and 8 against brute force."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.llm import anchors, phrases, suffixes

from .conftest import ROWS, table


def words_removed(rows):
    """Every row counts, so equal rows are copies of each other."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    n = Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 34):
            if n[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def bytes_removed(rows):
    """Rows with one id and text are one document; others with one id come by the MD5 of their text."""
    seen, found = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (i, t, p)) != (i, t, p):
                gone[p : p + 100] = True
        spans = len(anchors.runs_of(gone)[0])
        found[i, t] = (i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return sorted((found[r] for r in rows), key=repr)


SMALL = [(i, t if t is None or len(t) < 20_000 else t[:4000]) for i, t, _ in ROWS]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    small = spark.createDataFrame([(*r, "x") for r in SMALL], "doc_id bigint, text string, spans string")
    return table(spark, tmp_path_factory.mktemp("t"), documents=small)


@pytest.mark.parametrize(("most_broadcast", "hot"), [(anchors.MOST_BROADCAST, None), (-1, 1)])
def test_removed(spark, folder, most_broadcast, hot):
    """Keys broadcast or joined, few or all of them hot: the same rows."""
    for query, slow in ((phrases.op3_phrase_automata, words_removed), (suffixes.op8_induced_suffixes, bytes_removed)):
        got = query(spark, folder, most_broadcast=most_broadcast, hot=hot).collect()
        assert sorted(map(tuple, got), key=repr) == slow(SMALL)


def test_hot_key(spark, tmp_path, monkeypatch):
    """A phrase shorter than a window, in every text with other neighbours: its windows are dealt one by one."""
    r = np.random.default_rng(1)
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 1 << 30, n))
    hot, passage = word(20), word(70)
    rows = [(i, f"{word(30)} {hot} {word(40)} {passage if i % 9 == 0 else word(3)} {hot}") for i in range(120)] + [(500, f"{hot} " * 30), (501, "the " * 900)]
    d = table(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id bigint, text string"))
    monkeypatch.setattr(anchors, "COOL", 20)
    for query, slow in ((phrases.op3_phrase_automata, words_removed), (suffixes.op8_induced_suffixes, bytes_removed)):
        assert sorted(map(tuple, query(spark, d).collect()), key=repr) == slow(rows)
    for length, gram, units_of in ((35, 8, phrases.word_units), (100, 32, suffixes.byte_units)):
        keys = anchors.counted_keys(anchors.with_identity(spark.read.parquet(f"{d}/documents.parquet"), F.col("text").cast("binary")), units_of, length, gram)
        assert keys.agg(F.max("d")).first()[0] > 20


def test_empty_tables(spark, empty, tmp_path):
    d = table(spark, tmp_path, documents=empty)
    assert phrases.op3_phrase_automata(spark, d).count() == suffixes.op8_induced_suffixes(spark, d).count() == 0


def test_suffix_array():
    r = np.random.default_rng(3)
    for _ in range(150):
        n, k = int(r.integers(1, 120)), int(r.integers(1, 4))
        t = r.integers(0, k + 1, n).astype(np.uint8)
        if r.random() < 0.4:
            t = np.tile(t[: max(1, n // 4)], 5)[:n]
        b, n = t.tobytes(), len(t)
        order = sorted(range(n), key=lambda i: b[i:])
        sa, lcp = suffixes.suffix_array(t, 255)
        assert sa.tolist() == order

        def common(x, y):
            m = 0
            while max(x, y) + m < n and b[x + m] == b[y + m]:
                m += 1
            return m

        assert lcp.tolist() == [0, *(common(x, y) for x, y in zip(order, order[1:], strict=False))]


@pytest.mark.parametrize(("room", "take"), [(200, 16), (40, 7), (5, 3)])
def test_external_order(monkeypatch, room, take):
    """Blocks of a few rows: everything else lies in files."""
    monkeypatch.setattr(suffixes, "ROOM", room)
    monkeypatch.setattr(suffixes, "TAKE_ROWS", take)
    r = np.random.default_rng(5)
    for k in (2, 3, 200):
        t = r.integers(0, k, 500).astype(np.uint8)
        t[250:400] = t[:150]
        b = t.tobytes()
        assert suffixes.suffix_array(t, 255)[0].tolist() == sorted(range(500), key=lambda i: b[i:])


#: Samples the process's own memory without mapped files.
SAMPLED = """
import threading, time
peak = [0]
def anonymous():
    return int(open("/proc/self/smaps_rollup").read().split("Anonymous:")[1].split()[0])
def sample():
    while True:
        peak[0] = max(peak[0], anonymous())
        time.sleep(0.002)
"""
MEASURE = """
import sys
import numpy as np
from auditspark.llm import suffixes
suffixes.ROOM, suffixes.TAKE_ROWS = 1 << 15, 1 << 14
n = int(sys.argv[1])
s = suffixes.StringShard(100)
r = np.random.default_rng(0)
base = anonymous()
threading.Thread(target=sample, daemon=True).start()
again = r.integers(97, 123, 1000).astype(np.uint8).tobytes()
for i in range(n // 2000):
    s.add(r.integers(97, 123, 1000).astype(np.uint8).tobytes() + again, i, 0, 0)
marked = 0
for places in s.run():
    marked += int((places[3] - places[2]).sum())
print(marked, peak[0] - base, s.n)
"""


def test_memory_does_not_grow_with_the_shard():
    """Shards of 0.5 and 4 MB with room for 32,768 rows: the same memory beside mapped files, everything marked."""
    peak = {}
    for n in (500_000, 4_000_000):
        out = subprocess.run([sys.executable, "-c", SAMPLED + MEASURE, str(n)], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
        marked, kilobytes, size = map(int, out.stdout.split())
        assert marked >= (n // 2000 - 1) * 1000
        peak[n] = kilobytes
    assert peak[4_000_000] < 1.3 * peak[500_000] + 4000


def test_repeated_rows_in_two_partitions(spark, tmp_path):
    """Whichever task reads a repeated row: a copy of itself for words, one document for bytes."""
    alone, shared = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alone", "shared"))
    rows = [(1, alone), (2, shared), (3, f"{shared} and an end")]
    dealt = spark.sparkContext.parallelize([rows[0], rows[1], rows[0], rows[1], rows[2], rows[1]], 3)
    d = table(spark, tmp_path, documents=spark.createDataFrame(dealt, "doc_id bigint, text string"))
    own = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in own:
            spark.conf.set(k, "8192")
        assert spark.read.parquet(f"{d}/documents.parquet").rdd.getNumPartitions() == 3
        for query, slow in ((phrases.op3_phrase_automata, words_removed), (suffixes.op8_induced_suffixes, bytes_removed)):
            assert sorted(map(tuple, query(spark, d).collect()), key=repr) == slow([rows[0], rows[1], rows[0], rows[1], rows[2], rows[1]])
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def test_lone_suffixes_are_not_looked_up(monkeypatch):
    """Only suffixes that share a window with a neighbour are looked up in the segments."""
    import numpy as np

    from auditspark.llm import suffixes

    r, looked, search = np.random.default_rng(3), [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *side: looked.append(np.size(v) if len(a) == 2 and side == ("right",) else 0) or search(a, v, *side))
    shard, common = suffixes.StringShard(100), r.integers(0, 256, 150, np.uint8).tobytes()
    for doc in range(2):
        shard.add(r.integers(0, 256, 10_000, np.uint8).tobytes() + common, doc, doc, 0)
    assert [tuple(x.tolist() for x in y) for y in shard.run()] == [([1], [1], [10_000], [10_150])] and sum(looked) < 5000  # of 20,302


def test_only_segments_with_company_are_sorted(monkeypatch):
    """Of the segments of a key those whose neighbourhood of the key's gram no other shares are not sorted; texts with
    windows that recur in the same segment, at a gram's other side or with many different segments a key are."""
    r, sorted_, sort = np.random.default_rng(7), [], suffixes.sorted_suffixes
    monkeypatch.setattr(suffixes, "sorted_suffixes", lambda t, n, most: sorted_.append(n) or sort(t, n, most))
    word = lambda n: r.integers(97, 123, n).astype(np.uint8).tobytes()
    common, turn, passage = word(50), word(60), word(130)
    texts = [word(400) + (passage if i % 10 == 0 else common) + word(400) + (turn * 4 if i % 15 == 0 else b"") for i in range(60)]

    def marked(judged: int, keyed: bool) -> set[tuple[int, int]]:
        monkeypatch.setattr(suffixes, "JUDGED", judged)
        segs = []
        for i, t in enumerate(texts):
            k, first, n = anchors.segments(np.frombuffer(t, np.uint8), 100, 32)
            segs += [(int(k[j]), t[first[j] : first[j] + n[j] + 99], i, int(first[j])) for j in range(len(k))]
        kept = {}
        for key, seg, doc, start in segs:
            kept.setdefault((key, seg), (doc, start))
        shard = suffixes.StringShard(100)
        for (key, seg), (doc, start) in sorted(kept.items()):
            shard.add(seg, doc, doc, start, *([key] if keyed else []))
        return {(doc, p) for docs, _, starts, stops in shard.run() for doc, a, b in zip(docs.tolist(), starts.tolist(), stops.tolist(), strict=True) for p in range(a, b)}

    everything = marked(1 << 18, False)
    assert len(everything) > 1000
    for judged in (1 << 18, 2000, 20):
        assert marked(judged, True) == everything
    assert sorted_[1] < sorted_[0] / 3

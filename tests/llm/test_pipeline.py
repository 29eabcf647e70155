"""The pipeline's stages on a small table, each on what the one before kept."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from auditspark.llm import decontamination, near_copies, packing, simhash, toxicity

from .conftest import ROWS, table
from .test_operators import slow_align


def test_stages(spark, docs, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(0, "words stand here word0 of the passage word1 of the passage")], "item_id bigint, text string")
    documents = docs.selectExpr("doc_id", "text", "lang", "'s' as source", "length(text) as n_chars", "spans")
    folder = table(spark, tmp_path, documents=documents, labels=labels, benchmark=bench)
    kept = {}
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < 4:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/out/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/out/{name}")
        kept[name] = sorted((r.doc_id for r in now.select("doc_id").distinct().collect()), key=repr)
    ids = sorted((i for i, _, _ in ROWS), key=repr)
    assert kept["toxicity"] == ids  # one class only: nothing is toxic
    fp = {i: simhash.fingerprint((t or "").encode()) for i, t, _ in ROWS}
    first = lambda i: min(j for j in fp if j is not None and (fp[j] ^ fp[i]).bit_count() <= 4)
    assert kept["near_copies"] == [i for i in ids if i is None or first(i) == i]
    words = {i: decontamination.words_of((t or "").encode()) for i, t, _ in ROWS}
    item = decontamination.words_of(b"words stand here word0 of the passage word1 of the passage")
    # 3 and its copy share eight of the item's eleven words in a row
    clean = [i for i in kept["near_copies"] if slow_align(item, words[i]) < decontamination.THRESHOLD * decontamination.MATCH * len(item)]
    assert kept["decontamination"] == clean and not {3, 4} & set(clean)
    assert kept["secrets"] == clean
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/out/secrets").collect()}
    assert "f33e61083" not in text[9] and text[0] == ROWS[0][1]
    pieces = now.collect()
    tokens = packing.Tokens(packing.vocabulary())
    for i in clean:
        assert sum(p.length for p in pieces if p.doc_id == i) == len(tokens(text[i] or "")) // 2 + 1


def test_empty(spark, empty, tmp_path):
    documents = empty.selectExpr("doc_id", "text", "lang", "'s' as source", "length(text) as n_chars")
    folder = table(spark, tmp_path, documents=documents, labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id bigint, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_toxic_documents_go(spark, tmp_path):
    """Two classes of labels: what the machine scores TOXIC or more goes, clean documents stay with all their columns."""
    r = random.Random(8)
    calm, harsh = [f"calm{chr(97 + i)}" for i in range(26)], [f"harsh{chr(97 + i)}" for i in range(6)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        rows.append((i, " ".join(r.choices(calm, k=30) + (r.choices(harsh, k=5) if toxic else [])), 1.5))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, 1.5), (900, "", 1.5)], "doc_id bigint, text string, `__score` double")
    folder = table(spark, tmp_path, labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = {x.doc_id for x in kept.collect()}
    assert {i for i in range(600) if i % 3} <= ids and not {i for i in range(0, 600, 3)} & ids


def test_near_copies_against_brute_force(spark, tmp_path):
    """Texts are linked where their five-word shingles overlap by 0.8 or more, and nowhere else."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    texts = {}
    for k in range(30):
        base = r.choices(words, k=r.choice((40, 120, 400)))
        for edits in (0, 1, 2, 3, 5, 8, 12):
            t = list(base)
            for at in r.sample(range(len(t)), edits):
                t[at] = r.choice(words)
            texts[len(texts)] = " ".join(t)
    texts |= {1000: None, 1001: "", 1002: "one two", 1003: "One  two"}
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in texts}
    links = 0
    for i in texts:
        for j in texts:
            if j < i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                links += 1
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert links > 90
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    kept = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in texts if group[i] == i}
    for meeting in (4, 2):  # components cut into pieces that meet two by two
        found = near_copies.near_copies(docs, meeting=meeting).collect()
        assert {x.doc_id: x.component_id for x in found} == group


@pytest.mark.parametrize("labels", [[], [(0, 0)], [(0, 1)], [(0, 0), (1, 0)], [(0, 1), (1, 1)]], ids=["none", "one clean", "one toxic", "clean alone", "toxic alone"])
def test_toxicity_without_both_classes_drops_nothing(spark, tmp_path, labels):
    docs = spark.createDataFrame([(i, f"text {i} of some words", "en", "s", 9) for i in range(6)] + [(6, None, "en", "s", 0), (7, "", "en", "s", 0), (None, "x", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    marks = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id bigint, quality int, toxic int")
    sf = table(spark, tmp_path, documents=docs, labels=marks)
    assert corpus_pipeline.drop_toxic(spark, docs, sf).count() == 9
    scores = {r.predicted for r in toxicity.op5_toxicity(spark, sf).collect()}
    assert scores == ({1} if labels and all(t for _, t in labels) else {0})


def test_toxicity_keeps_null_ids_and_empty_texts(spark, tmp_path):
    bad, good = "you foul vermin are hated by all", "a calm and friendly note on gardens"
    rows = [(i, f"{bad} {i}" if i % 2 else f"{good} {i}", "en", "s", 9) for i in range(400)]
    more = [(None, bad, "en", "s", 1), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, " \n", "en", "s", 2), (903, bad, "en", "s", 1), (904, good, "en", "s", 1)]
    docs = spark.createDataFrame(rows + more, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id bigint, quality int, toxic int")
    kept = corpus_pipeline.drop_toxic(spark, docs, table(spark, tmp_path, documents=docs, labels=marks)).collect()
    assert {r.doc_id for r in kept if r.doc_id is None or r.doc_id >= 900} == {None, 900, 901, 902, 904}
    assert sum(r.doc_id is not None and r.doc_id < 400 for r in kept) == 200

"""Rows repeated in the table, in other partitions than their first copies: a defined result for each operator."""

from __future__ import annotations

from collections import Counter

import pytest

from auditspark.llm import decontamination, fingerprints, language, packing, secrets, sharding, simhash, toxicity

from .conftest import ROWS, table


@pytest.fixture(scope="module")
def twice(spark, docs, tmp_path_factory):
    labels = spark.createDataFrame([(0, 1, 1), (3, 1, 0), (4, 1, 0), (0, 1, 1)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(0, "jumps over the lazy dog and runs away from it all day"), (0, "jumps over the lazy dog and runs away from it all day")], "item_id bigint, text string")
    return table(spark, tmp_path_factory.mktemp("r"), documents=docs.unionByName(docs.repartition(2)), labels=labels, benchmark=bench)


@pytest.mark.parametrize("query", [language.op1_language_id, fingerprints.op2_scaled_sketch, secrets.op4_markov_secrets, toxicity.op5_toxicity, simhash.op10_simhash_bktree], ids=lambda q: q.__name__)
def test_equal_rows_have_equal_results(spark, twice, query):
    got = Counter(map(tuple, query(spark, twice).collect()))
    assert sum(got.values()) == 2 * len(ROWS) and set(got.values()) == {2}


def test_decontamination(spark, twice):
    got = {(r.doc_id, r.item_id) for r in decontamination.op6_decontamination(spark, twice).collect()}
    assert got == {(0, 0), (5, 0)}


def test_sharding(spark, twice):
    rows = sharding.op7_jump_sharding(spark, twice).collect()
    assert len(rows) == 2 * len(ROWS)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_packing(spark, twice):
    rows = packing.op9_curve_packing(spark, twice).collect()
    length = Counter()
    for r in rows:
        length[r.doc_id] += r.length
    assert length == {i: 2 * next(r.doc_tokens for r in rows if r.doc_id == i) for i, _, _ in ROWS}

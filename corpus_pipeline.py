"""The corpus pipeline: STAGES are applied in order, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.  Null
and empty texts pass the filters (an empty text may be the near copy of another empty text); rows
with a null doc_id are never dropped; rows that share a doc_id share its fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm import decontamination, near_copies, packing, secrets, toxicity
from auditspark.llm.common import read, through_parquet, without

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go.  Rows of a null id or a text without a word stay, and all rows do
    if the labels do not tell toxic from clean (none, or one class alone)."""
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"))
    if not machine.informed:
        return docs
    exempt = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    return docs.where(exempt | (toxicity.scorer(machine)("text") < TOXIC))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, 0.8 or more) the smallest id stays."""
    found = near_copies.near_copies(docs)
    return without(docs, found.where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, as it is or edited, go."""
    return without(docs, decontamination.matches(docs, read(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs, secrets.Detector(secrets.ordinary_sample(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, in the order of the space-filling curve."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Models and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = through_parquet(docs, name)
    return docs

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (tests, a laptop) a temporary folder is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="auditspark-checkpoint-"))
    return where or sc.getCheckpointDir()


def through_parquet(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Ids up to which without() broadcasts them (8 bytes each); more are joined by shuffle.
MOST_BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among `ids` (a column doc_id); null ids stay."""
    ids = cut_lineage(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST_IDS else ids, "doc_id", "left_anti")


def id_remainder(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo `modulus` (null id: crc32 of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than one row in so many is joined by broadcast, of which there are fewer than so many.
HOT_SHARE = 64


def joined_back(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the columns of their group; `groups` has one row a key (null is a key like any other) and
    in `count` the rows of each.  Groups that hold a large share of the rows are joined by broadcast - at
    most HOT_SHARE of them exist - and only the others by shuffle, so no task receives a hot key.  Both
    inputs are read twice: pass tables whose lineage is cut."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot, on = F.col(count) * HOT_SHARE > F.lit(total), F.col(key).eqNullSafe(F.col("__key"))
    right = groups.withColumnRenamed(key, "__key")
    hot_side, cold_side = right.where(hot).drop(count), right.where(~hot).drop(count)
    few = rows.join(F.broadcast(hot_side), on)
    # hot keys leave the rows before the shuffle
    many = rows.join(F.broadcast(hot_side.select("__key")), on, "left_anti").join(cold_side, on)
    return few.unionByName(many).drop("__key")

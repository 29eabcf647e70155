"""Materializing small intermediate results so that later steps neither recompute nor replan them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that which spark.checkpoint.dir names (on a local master a temporary one if
    unset; on a cluster that would lie on one machine, so it is an error)."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="auditspark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df sorted in ranges over all tasks and kept so, with __range, the range's number, and __at, a row's place in it, from 0."""
    keys = [F.col(k).asc_nulls_first() for k in order]
    rows = materialized(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    return rows.withColumns({"__range": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with its rows' numbers, from 1, within each group of `by` (none: of all rows), in the order of `order`; nulls first.

    Ranges of (by, order) are counted group by group, and a row's number is its place in its range behind the group's
    rows in the ranges before.  A group larger than a range lies in several, so no task sees more than a range of it."""
    place = ranged(df, [*by, *order])
    counts = place.groupBy("__range", *by).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__range").alias("__r"), *[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], (before - F.col("__first")).alias("__offset"))
    same = F.col("__range") == F.col("__r")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__by{i}"))
    return place.join(starts, same).withColumn(name, F.col("__offset") + F.col("__at") + 1).select(*df.columns, name)

"""Operator 7: jump consistent hashing (Lamping and Veach) with built-in functions only.

A stable key is hashed to 64 bits; a linear congruential step then decides at which shard
counts the row would jump.  The shard under n shards is the last jump target below n, so one
chain of jumps answers every shard count at once and appending a shard moves rows only into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
TWO_64 = 18446744073709551616
#: A chain longer than this has a probability below 1e-60 for any shard count up to 2**31; it raises.
LONGEST_CHAIN = 192


def key_hash(key: Column) -> Column:
    """The first 64 bits of md5 over the key's text, as an unsigned decimal; a null key counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def jump_shards(key: Column, counts: list[int]) -> list[Column]:
    """The shard of `key` under each of `counts` shards."""
    most = max(counts)
    if min(counts) < 1:
        raise ValueError("a shard count must be at least 1")
    whole = "decimal(38,0)"

    def step(state, _):
        # decimals hold the 126-bit product; bigint would overflow
        k = ((state["k"].cast("decimal(20,0)") * F.lit(MULTIPLIER).cast("decimal(19,0)")).cast(whole) + F.lit(1)).cast(whole) % F.lit(str(TWO_64)).cast("decimal(20,0)")
        k = k.cast("decimal(20,0)")
        top = F.floor(k / F.lit("8589934592").cast("decimal(10,0)")).cast("double")
        target = F.floor((state["j"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (top + F.lit(1.0)))).cast("bigint")
        on = state["j"] < most
        return F.struct(
            F.when(on, k).otherwise(state["k"]).alias("k"),
            F.when(on, target).otherwise(state["j"]).alias("j"),
            *[F.when(on & (target < n), target).otherwise(state[f"s{i}"]).alias(f"s{i}") for i, n in enumerate(counts)],
        )

    # every chain starts at shard 0
    start = F.struct(key_hash(key).alias("k"), F.lit(0).cast("bigint").alias("j"), *[F.lit(0).cast("bigint").alias(f"s{i}") for i in range(len(counts))])
    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(most, LONGEST_CHAIN))), start, step)
    done = lambda x: F.when(end["j"] >= most, x).otherwise(F.raise_error(F.lit("jump chain not finished")).cast("bigint")) if most > LONGEST_CHAIN else x
    return [done(end[f"s{i}"]).cast("int") for i in range(len(counts))]


def assign_shards(df: DataFrame, key: str, shards: int, digits: int = 3) -> DataFrame:
    """Adds shard, slot and grown_shard to rows with the (narrow) columns given.

    slot numbers the rows of a shard from 0 without gaps.  A shard is not sorted in one task:
    rows are numbered within (shard, bucket) - a bucket is `digits` further hexadecimal digits of the
    key's hash - and the counts of the at most shards x 16**digits groups give each its first slot.  Rows with equal keys keep one shard and share a
    bucket; ties are numbered by the remaining columns.  Null keys hash as ''.
    """
    now, grown = jump_shards(F.col(f"`{key}`"), [shards, shards + 1])
    others = [c for c in df.columns if c != key]
    rows = df.withColumns({"shard": now, "grown_shard": grown, "__bucket": F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), 17, digits)})
    sizes = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("shard", "__bucket").orderBy(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in others])
    numbered = rows.withColumn("__row", F.row_number().over(inside))
    # shards x 16**digits rows at most; Spark broadcasts them only below the session's threshold
    return numbered.join(firsts, ["shard", "__bucket"]).withColumn("slot", (F.col("__first") + F.col("__row") - 1).cast("bigint")).drop("__bucket", "__first", "__row", "__n")


def op7_jump_sharding(spark, sf_dir: str, shards: int = 8) -> DataFrame:
    from .common import read

    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return assign_shards(narrow, "doc_id", shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

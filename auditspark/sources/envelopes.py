"""Packages as JSON envelopes {textFiles, allPaths}, one per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ENVELOPE

# Fixed value: the largest body accepted.
MOST_BYTES = 104_857_600


def parse_envelopes(bodies: DataFrame, key: str = "package_id", body: str = "body") -> DataFrame:
    """package_id, e (the envelope) and problem (null for a good one) of every body."""
    parsed = bodies.select(F.col(key).cast("string").alias("package_id"), F.col(body).alias("body"), F.from_json(F.col(body), ENVELOPE).alias("e"))
    problem = (
        F.when(F.octet_length("body") > MOST_BYTES, "body too large")
        .when(F.col("body").isNull() | F.col("e").isNull() | F.col("e.textFiles").isNull() | F.col("e.allPaths").isNull(), "invalid request body")
    )
    return parsed.select("package_id", "e", problem.alias("problem"))


def read_envelopes(bodies: DataFrame, key: str = "package_id", body: str = "body") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, paths, packages, errors) of a table of envelopes.  Unknown keys are ignored; a body that
    is not JSON, lacks a part or is too large gives an error record instead."""
    parsed = parse_envelopes(bodies, key, body)
    good = parsed.where("problem is null")
    files = good.select("package_id", F.explode("e.textFiles").alias("path", "content"))
    paths = good.select("package_id", F.explode("e.allPaths").alias("path"))
    errors = parsed.where("problem is not null").select("package_id", F.lit(False).alias("ok"), F.col("problem").alias("error"))
    return files, paths, good.select("package_id"), errors

"""A stateless stream of envelopes: a package is a row, and its audit stays in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans import rows, wire
from ..registry import BEHAVIORAL, SENSITIVE, Behavioral, Sensitive
from ..sources.envelopes import parse_envelopes


def responses(bodies: DataFrame, sensitive: list[Sensitive] = SENSITIVE, behavioral: list[Behavioral] = BEHAVIORAL) -> DataFrame:
    """package_id, response, error of every envelope of a stream or a table (package_id, body): the response, or why
    there is none.  Nothing is shuffled and no state is kept."""
    audit = rows.audited(parse_envelopes(bodies), sensitive, behavioral)
    items = F.array_join(F.transform("findings", lambda f: wire.finding_json(f)), ",")
    return audit.select("package_id", F.when(F.col("problem").isNull(), wire.response(items, F.col)).alias("response"), F.col("problem").alias("error"))


def audit_stream(spark: SparkSession, source: str, sink: str, checkpoint: str) -> DataStreamWriter:
    """Reads JSON lines {package_id, body} that arrive in `source` and writes a line {package_id, response or error}
    for each to `sink`, exactly once."""
    bodies = spark.readStream.schema("package_id string, body string").json(source)
    return responses(bodies).writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")

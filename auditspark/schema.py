"""Schemas of the tables that go in and out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCANNER_SCHEMA_VERSION = 9
# Fixed value: the source of a finding that states none.
DEFAULT_SOURCE = "vettd"

PACKAGES = T.StructType([T.StructField("package_id", T.StringType(), False)])
FILES = T.StructType([T.StructField(c, T.StringType(), False) for c in ("package_id", "path", "content")])
PATHS = T.StructType([T.StructField(c, T.StringType(), False) for c in ("package_id", "path")])
ENVELOPE = T.StructType([T.StructField("textFiles", T.MapType(T.StringType(), T.StringType())), T.StructField("allPaths", T.ArrayType(T.StringType()))])

#: Fields of a finding, in their order on the wire.
FINDING = ["rule_id", "category", "severity", "label", "detail", "filepath", "owasp_llm_category", "chain_id", "intent", "source"]
SEVERITIES = ["info", "low", "medium", "high", "critical"]


def severity_rank(severity: Column) -> Column:
    """0 (info) to 4 (critical)."""
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1).cast("int")

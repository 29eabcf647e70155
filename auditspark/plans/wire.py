"""Findings as JSON, in and out: a response as one text, or in parts where a package may have any number of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DEFAULT_SOURCE, FINDING, SCANNER_SCHEMA_VERSION

#: Names on the wire; filepath and source are left out where they are null or the default.
WIRE = {"rule_id": "ruleId", "owasp_llm_category": "owaspLlmCategory", "chain_id": "chainId"}
KEEP_NULL = {"owasp_llm_category", "chain_id", "intent"}


def _json_value(c: Column) -> Column:
    """A JSON string literal, or null."""
    return F.coalesce(F.substring(F.to_json(F.struct(c.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6), F.lit("null"))


def finding_json(row: Column | None = None) -> Column:
    get = (lambda n: row[n]) if row is not None else F.col
    parts = []
    for n in FINDING:
        pair = F.concat(F.lit(f'"{WIRE.get(n, n)}":'), F.when(get(n).isNull(), F.lit("null")).otherwise(_json_value(get(n))))
        if n == "filepath":
            pair = F.when(get(n).isNotNull(), pair)
        if n == "source":
            pair = F.when(get(n) != DEFAULT_SOURCE, pair)
        parts.append(pair)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def to_wire(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """package_id and its response: findings in order, flags, file count and version."""
    lists = findings.select("package_id", "seq", finding_json().alias("j")).groupBy("package_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "j"))), lambda x: x["j"]), ",").alias("list"))
    return summary.join(lists, "package_id", "left").select("package_id", response(F.coalesce("list", F.lit("")), F.col).alias("response"))


#: What stands before the findings of a document.
HEAD = '{"findings":['


def document_parts(findings: DataFrame, packages: DataFrame, per_part: int = 1000) -> DataFrame:
    """package_id, part, text: the document {"findings":[...]} of every package, in parts that follow each other.
    Part 0 opens it, each of the next ones has per_part findings (the last one fewer), and the last closes it.
    seq must count a package's findings from 1.  No package is gathered: a part is all that one row ever holds."""
    return _parts(findings, packages.select("package_id", F.lit("]}").alias("tail")), per_part)


def response_parts(findings: DataFrame, summary: DataFrame, per_part: int = 1000) -> DataFrame:
    """The responses of to_wire() in parts, like document_parts()."""
    return _parts(findings, summary.select("package_id", tail(F.col).alias("tail")), per_part)


def _parts(findings: DataFrame, packages: DataFrame, per_part: int) -> DataFrame:
    """The findings are made once: their own partitions by package serve the parts, which of them is the last, and
    the join with the packages."""
    part = (F.floor((F.col("seq") - 1) / per_part) + 1).cast("bigint").alias("part")
    each = findings.select("package_id", part, "seq", finding_json().alias("j")).groupBy("package_id", "part")
    items = each.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "j"))), lambda x: x["j"]), ",").alias("text"))
    items = items.withColumns({"text": F.concat(F.when(F.col("part") > 1, ",").otherwise(""), F.col("text")), "next": F.lead("part").over(Window.partitionBy("package_id").orderBy("part"))})
    at = lambda p, text: F.struct(p.cast("bigint").alias("part"), text.alias("text"))
    known, held = F.col("known").isNotNull(), F.col("part").isNotNull()
    rows = items.join(packages.withColumn("known", F.lit(True)), "package_id", "full")
    ends = (F.when(known & (~held | (F.col("part") == 1)), at(F.lit(0), F.lit(HEAD))), F.when(known & F.col("next").isNull(), at(F.coalesce("part", F.lit(0)) + 1, F.col("tail"))))
    return rows.select("package_id", F.explode(F.array_compact(F.array(ends[0], F.when(held, at(F.col("part"), F.col("text"))), ends[1]))).alias("e")).select("package_id", "e.*")


def response(items: Column, flag) -> Column:
    """The body of a response: the findings' JSON, comma-joined, and the flags, which flag(name) gives."""
    return F.concat(F.lit(HEAD), items, tail(flag))


def tail(flag) -> Column:
    """What stands behind the findings of a response."""
    part = lambda name, c: F.concat(F.lit(f',"{name}":'), flag(c).cast("string"))
    return F.concat(
        F.lit("]"), part("hasSkillMd", "has_skill_md"), part("hasScripts", "has_scripts"), part("hasReferences", "has_references"), part("hasEvals", "has_evals"),
        part("fileCount", "file_count"), F.lit(f',"scannerVersion":{SCANNER_SCHEMA_VERSION}}}'),
    )


def from_wire(bodies: DataFrame, key: str = "package_id", body: str = "body") -> DataFrame:
    """Findings of JSON responses, in order; a missing rule id is empty, a missing source the default,
    a source of null stays null."""
    fields = T.StructType([T.StructField(WIRE.get(n, n), T.StringType()) for n in FINDING])
    items = F.from_json(F.col(body), T.StructType([T.StructField("findings", T.ArrayType(fields))]))["findings"]
    raw = F.from_json(F.get_json_object(F.col(body), "$.findings"), "array<map<string,string>>")
    rows = bodies.select(key, F.posexplode(F.arrays_zip(items.alias("f"), raw.alias("m"))).alias("pos", "z"))
    stated = F.map_contains_key(F.col("z.m"), F.lit("source"))
    return rows.select(
        key, (F.col("pos") + 1).cast("bigint").alias("seq"),
        *[(F.coalesce(F.col("z.f.ruleId"), F.lit("")) if n == "rule_id" else F.when(stated, F.col("z.f.source")).otherwise(DEFAULT_SOURCE) if n == "source" else F.col(f"z.f.{WIRE.get(n, n)}")).alias(n) for n in FINDING],
    )

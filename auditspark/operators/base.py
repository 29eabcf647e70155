"""What the checks share: the internal shape of a finding.

Every check gives rows with package_id, the emission key (phase, k1, k2), the fields of a finding and
three helpers: line_no, detail_path (the path as it can be read back from the detail) and bucket.
Paths of findings whose detail says "Detected in" end at their first colon, as they are read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sql
from ..schema import DEFAULT_SOURCE

COLUMNS = ["package_id", "phase", "k1", "k2", "rule_id", "category", "severity", "label", "detail", "filepath", "owasp_llm_category", "chain_id", "intent", "source", "line_no", "detail_path", "bucket"]


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def struct_of(
    phase: int | Column, rule: Column | str, category: Column | str, severity: Column | str, label: Column | str, detail: Column | str, *, filepath: Column | None = None,
    intent: Column | str | None = None, k1: Column | None = None, k2: Column | None = None, line_no: Column | None = None, chain_id: Column | None = None,
    detected_in: Column | None = None, bucket: Column | None = None,
) -> Column:
    """A finding as a struct of all but package_id."""
    return F.struct(
        _named("phase", phase, "int"), _named("k1", "" if k1 is None else k1), _named("k2", 0 if k2 is None else k2, "bigint"), _named("rule_id", rule), _named("category", category),
        _named("severity", severity), _named("label", label), _named("detail", detail), _named("filepath", filepath), _named("owasp_llm_category", None), _named("chain_id", chain_id),
        _named("intent", intent), _named("source", DEFAULT_SOURCE), _named("line_no", line_no, "bigint"),
        _named("detail_path", None if detected_in is None else F.split_part(detected_in, F.lit(":"), F.lit(1))), _named("bucket", bucket),
    )


def _named(name: str, value: Column | str | int | None, kind: str = "string") -> Column:
    """A field of a struct; constants are SQL text, which costs one call where lit(), cast() and alias() cost many."""
    if isinstance(value, Column):
        return (value if kind == "string" else value.cast(kind)).alias(name)
    return F.expr(f"CAST({value if isinstance(value, int) else sql(value)} AS {kind}) AS {name}")


def row(when: Column | None, k: int, rule: str, severity: str, label: Column | str, detail: Column | str) -> Column:
    """One of several findings that a check gives under one phase and category, as told() takes them."""
    s = F.struct(_named("k", k, "bigint"), _named("rule", rule), _named("severity", severity), _named("label", label), _named("detail", detail))
    return s if when is None else F.when(when, s)


def told(phase: int, category: str, rows: list[Column], path: Column | None = None) -> Column:
    """The array of findings of those rows that are not null."""
    return F.transform(F.array_compact(F.array(*rows)), lambda f: struct_of(phase, f["rule"], category, f["severity"], f["label"], f["detail"], filepath=path, k1=path, k2=f["k"])).cast(FINDINGS)


#: The type of an array of such structs.
FINDINGS = "array<struct<phase:int,k1:string,k2:bigint,rule_id:string,category:string,severity:string,label:string,detail:string,filepath:string,owasp_llm_category:string,chain_id:string,intent:string,source:string,line_no:bigint,detail_path:string,bucket:string>>"


def finding(df: DataFrame, *fields, **more) -> DataFrame:
    """A row of df as a finding; the arguments are struct_of()'s."""
    return df.select("package_id", struct_of(*fields, **more).alias("__f")).select("package_id", "__f.*")


def listed(*rows: Column) -> Column:
    """The array of those findings that are not null."""
    return F.array_compact(F.array(*rows)).cast(FINDINGS)


def exploded(df: DataFrame, found: Column) -> DataFrame:
    """A row a finding of an array.  (With explode() the optimizer would evaluate the array once more.)"""
    return df.select("package_id", F.explode_outer(found).alias("__f")).where("__f is not null").select("package_id", "__f.*")


def is_markdown(path: Column) -> Column:
    return F.lower(path).endswith(".md")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns behind a generator: the optimizer does not copy their expressions into
    each later use, so they are evaluated just once a row."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode_outer(F.array(row)).alias("__settled")).select("*", "__settled.*").drop("__settled")


def detected(path: Column, line_no: Column, snippet: Column, note: Column | None = None) -> Column:
    """Detected in path:line (note) — `snippet`"""
    return F.concat(F.lit("Detected in "), path, F.lit(":"), line_no.cast("string"), note if note is not None else F.lit(""), F.lit(" — `"), snippet, F.lit("`"))


def pick(values: list, index: Column) -> Column:
    """values[index] of a registry column (nulls allowed)."""
    return F.element_at(F.expr(f"cast(array({', '.join(map(sql, values))}) AS array<string>)"), index.cast("int") + 1)

"""Comparing two sets of findings: left and right, matched by category, rule and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_SOURCE
from .lineage import numbered

KEYS = ["package_id", "category", "rule_id", "label"]
#: Fields that must agree; details are compared without where they were detected.
FIELDS = ["severity", "intent", "chain_id", "source", "detail"]


def stripped_detail(detail: Column) -> Column:
    """Without a leading `Detected in path:line — `; details with a match count keep theirs."""
    return F.regexp_replace(detail, r"^Detected in [^:]+:\d+ — ", "")


def side(findings: DataFrame, order: str = "seq") -> DataFrame:
    """This engine's findings (or of no stated source), the last of each key, details stripped."""
    own = findings.where(F.col("source") == DEFAULT_SOURCE)
    last = own.groupBy(*KEYS).agg(F.max_by(F.struct("severity", "intent", "chain_id", "source", stripped_detail(F.col("detail")).alias("detail")), order).alias("f"))
    return last.select(*KEYS, "f.*")


def diff(left: DataFrame, right: DataFrame, order: str = "seq") -> DataFrame:
    """One row per key of either side: status matched, mismatched, left_only or right_only, the severity (the left
    side's where it has the key), and for mismatches the fields that differ with both values."""
    a, b = side(left, order).withColumn("__l", F.lit(True)), side(right, order).withColumn("__r", F.lit(True))
    both = a.alias("a").join(b.alias("b"), KEYS, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("left_value"), F.col(f"b.{f}").alias("right_value"))) for f in FIELDS]))
    status = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").when(F.size("differ") > 0, "mismatched").otherwise("matched")
    rows = both.withColumn("differ", differ).withColumn("status", status)
    return rows.select(*KEYS, "status", F.when(F.col("__l"), F.col("a.severity")).otherwise(F.col("b.severity")).alias("severity"), F.when(F.col("status") == "mismatched", F.col("differ")).otherwise(F.array().cast("array<struct<field:string,left_value:string,right_value:string>>")).alias("fields"))


def ordered(d: DataFrame) -> DataFrame:
    """A diff with diff_seq, from 1: its place in the order of all keys (package, category, rule, label; nulls first)."""
    return numbered(d, [], KEYS, "diff_seq")


def diff_summary(d: DataFrame) -> DataFrame:
    """Per package: the numbers by status and whether everything matched."""
    n = lambda s: F.count(F.when(F.col("status") == s, True)).alias(s)
    return d.groupBy("package_id").agg(n("matched"), n("mismatched"), n("left_only"), n("right_only")).withColumn("passed", F.col("mismatched") + F.col("left_only") + F.col("right_only") == 0)


def _quoted(c: Column) -> Column:
    """A text in quotes, its own escaped; null is None."""
    plain = c
    for was, now in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(was), F.lit(now))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    marked = F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.coalesce(marked, F.lit("None"))


#: What orders the lines of a report within a package.
LINE_ORDER = ["section", "item", "category", "rule_id", "label", "field_at"]


def report_lines(d: DataFrame, named: bool = False) -> DataFrame:
    """The entries of each package's report, a row each: PASS or FAIL (with the package's id if named), the keys of
    one side, the differing fields with both values (three lines), how many keys matched.  LINE_ORDER orders them."""
    category, label = F.coalesce("category", F.lit("?")), _quoted(F.col("label"))
    one = F.concat(F.lit("    - ["), F.coalesce("severity", F.lit("?")), F.lit("] "), category, F.lit(" / "), label)
    sided = d.where(F.col("status").isin("left_only", "right_only")).select("package_id", F.when(F.col("status") == "left_only", 1).otherwise(2).alias("section"), F.lit(1).alias("item"), "category", "rule_id", "label", F.lit(0).alias("field_at"), one.alias("text"))
    field = F.concat(
        F.lit("    ["), category, F.lit(" / "), _quoted(F.col("rule_id")), F.lit(" / "), label, F.lit("] ."), F.col("f.field"),
        F.lit(":\n      left : "), _quoted(F.col("f.left_value")), F.lit("\n      right: "), _quoted(F.col("f.right_value")),
    )
    fields = d.where("status = 'mismatched'").select("package_id", "category", "rule_id", "label", F.posexplode("fields").alias("field_at", "f"))
    fields = fields.select("package_id", F.lit(3).alias("section"), F.lit(1).alias("item"), "category", "rule_id", "label", "field_at", field.alias("text"))
    n = lambda s: F.count(F.when(F.col("status") == s, True)).alias(s)
    counts = d.groupBy("package_id").agg(n("matched"), n("left_only"), n("right_only"), F.sum(F.size("fields")).alias("differ"))
    failed = F.col("left_only") + F.col("right_only") + F.col("differ") > 0
    head = lambda section, when, *text: F.when(when, F.struct(F.lit(section).alias("section"), F.concat(*text).alias("text")))
    heads = F.array_compact(F.array(
        head(0, F.lit(True), F.when(failed, "FAIL").otherwise("PASS"), F.concat(F.lit("  "), F.col("package_id")) if named else F.lit("")),
        head(1, F.col("left_only") > 0, F.lit("  left only ("), F.col("left_only").cast("string"), F.lit(" finding(s)):")),
        head(2, F.col("right_only") > 0, F.lit("  right only ("), F.col("right_only").cast("string"), F.lit(" finding(s)):")),
        head(3, F.col("differ") > 0, F.lit("  Field mismatches ("), F.col("differ").cast("string"), F.lit("):")),
        head(4, ~failed | (F.col("matched") > 0), F.lit("  "), F.col("matched").cast("string"), F.lit(" finding(s) matched exactly.")),
    ))
    none = F.lit(None).cast("string")
    titles = counts.select("package_id", F.explode(heads).alias("h")).select("package_id", "h.section", F.lit(0).alias("item"), none.alias("category"), none.alias("rule_id"), none.alias("label"), F.lit(0).alias("field_at"), "h.text")
    return titles.unionByName(sided).unionByName(fields)


def report_parts(d: DataFrame, named: bool = False, per_part: int = 1000) -> DataFrame:
    """package_id, part (from 0), text: each package's report in parts of at most per_part entries, which a line feed
    joins to the whole.  However long a report is, a task holds some parts of it and never all."""
    lines = numbered(report_lines(d, named), ["package_id"], LINE_ORDER, "line")
    part = F.floor((F.col("line") - 1) / per_part).cast("bigint").alias("part")
    return lines.groupBy("package_id", part).agg(_joined("line", "\n").alias("text"))


def _joined(order: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), by)


def report(d: DataFrame, named: bool = False) -> DataFrame:
    """package_id and its whole report as one text, for packages whose findings fit into one; report_parts has no such limit."""
    return report_lines(d, named).groupBy("package_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "text"))), lambda x: x["text"]), "\n").alias("text"))

"""The whole audit as one plan: files, paths and packages in; findings and summaries out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chains, definition, encoding, evals, patterns, scripts, structure
from ..operators.base import FINDINGS, exploded, listed
from ..registry import BEHAVIORAL, SENSITIVE, Behavioral, Sensitive
from ..schema import FINDING, SCANNER_SCHEMA_VERSION, SEVERITIES, severity_rank
from .lineage import materialized


#: Files whose packages' findings a task concludes.
TASK_FILES = 4096


@dataclass
class Scan:
    """findings: one row each with package_id and seq, the order of emission; summary: one row a package."""

    findings: DataFrame
    summary: DataFrame


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def packages_about(packages: DataFrame, facts: DataFrame, paths: DataFrame) -> DataFrame:
    """A row a package: its flags and file count, and as structs, null where it has none, the facts of its definition,
    its suite and the file its links are judged by; n counts other evaluation files."""
    own = facts.where("definition is not null").groupBy("package_id").agg(F.min_by("definition", "path").alias("definition"))  # SKILL.md before skill.md
    suite = evals.suites(facts).select("package_id", F.struct("n_cases", "asserted").alias("suite"))
    links = scripts.url_targets(facts).select("package_id", F.struct("path").alias("link"))
    rows = structure.flags(packages, facts, paths)
    for part in (own, suite, links, evals.eval_files(paths, facts)):
        rows = rows.join(part, "package_id", "left")
    return rows


def package_findings(a) -> Column:
    """The findings of a package by itself; those that depend on others - both roll-ups and the mismatch - as
    though they held.  a(name) is a column of packages_about()."""

    def of_definition(d: Column) -> Column:
        folders = a("has_references") | a("has_scripts") | a("has_assets")
        mismatch = listed(F.when(F.size(d["harmless"]) > 0, definition.mismatch_struct(d["harmless"])))
        return F.concat(F.filter(d["found"], lambda f: folders | (f["rule_id"] != "VTD-0107")), mismatch)

    none = F.array().cast(FINDINGS)
    return F.concat(
        structure.layout_found(a), F.when(a("has_skill_md"), X.bound(F.coalesce(a("definition"), definition.definition_fact(None)), of_definition)).otherwise(none),
        listed(F.when(a("link").isNotNull(), scripts.url_struct(a("link")["path"]))),
        F.when(a("has_evals"), evals.eval_found(a("suite"), a("n"))).otherwise(none), listed(*chains.rollup_structs()),
    )


def scan(files: DataFrame, paths: DataFrame, packages: DataFrame | None = None, sensitive: list[Sensitive] = SENSITIVE, behavioral: list[Behavioral] = BEHAVIORAL) -> Scan:
    """Audits every package.  `packages` names them all, the empty ones too; by default those with a
    file or a path.  All stages keep package_id, so the per-package roll-ups and chains group on it."""
    if packages is None:
        packages = paths.select("package_id").union(files.select("package_id")).distinct()
    of = patterns.rules(sensitive, behavioral)
    facts = materialized(encoding.facts(files, of))  # the contents are read here alone
    flags, about = structure.flags(packages, facts, paths), packages_about(packages, facts, paths)
    c = F.col
    rows = _union(
        exploded(about, package_findings(c)), exploded(facts, F.concat(patterns.line_findings(of, c("path"), c), listed(chains.sends_struct(c("path"), c("sink"))))),
        scripts.script_checks(facts, flags), encoding.base64(facts, of.sensitive), encoding.hidden_unicode(facts, of.sensitive, of.behavioral),
    )
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-facts.count() // TASK_FILES))
    found = chains.concluded(rows, tasks)
    seq = F.row_number().over(Window.partitionBy("package_id").orderBy("phase", "k1", "k2")).cast("bigint")
    return Scan(found.withColumn("seq", seq).select("package_id", "seq", *FINDING), flags.withColumn("scanner_version", F.lit(SCANNER_SCHEMA_VERSION)))


def package_summary(result: Scan) -> DataFrame:
    """Flags of each package with the number of its findings, by severity too, and the worst of them."""
    counts = result.findings.groupBy("package_id").agg(
        F.count(F.lit(1)).alias("n_findings"), *[F.count(F.when(F.col("severity") == s, True)).alias(f"n_{s}") for s in SEVERITIES],
        F.max(severity_rank(F.col("severity"))).cast("bigint").alias("worst"), F.bool_or(F.coalesce(F.col("intent") == "malicious", F.lit(False))).alias("has_malicious"),
    )
    return result.summary.join(counts, "package_id", "left")


def health() -> dict[str, Column]:
    """The fields of the health record."""
    return {"ok": F.lit(True), "scannerVersion": F.lit(SCANNER_SCHEMA_VERSION)}


def engine_info(spark) -> DataFrame:
    """The health record."""
    return spark.range(1).select(*[v.alias(k) for k, v in health().items()])

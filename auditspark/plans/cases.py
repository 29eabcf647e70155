"""The case table: small named packages whose audits two engines should agree on, and the tally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFINITION = "---\nname: example-skill\ndescription: Use this skill when a table needs to be read\n---\n# Usage\n1. Read the table\n"
SCRIPT, GUIDE, SUITE = "#!/bin/sh\necho done\n", "# Guide\nHow a table is read.\n", '{"cases": []}'

# The cases' names, and which parts each has.
CASES = {
    "clean-skill-no-extras": {"SKILL.md": DEFINITION},
    "missing-skill-md": {},
    "skill-with-scripts": {"SKILL.md": DEFINITION, "scripts/run.sh": SCRIPT},
    "skill-with-evals": {"SKILL.md": DEFINITION, "evals/suite.json": SUITE},
    "skill-with-references": {"SKILL.md": DEFINITION, "references/guide.md": GUIDE},
    "skill-all-extras": {"SKILL.md": DEFINITION, "scripts/run.sh": SCRIPT, "evals/suite.json": SUITE, "references/guide.md": GUIDE},
    "empty-input": {},
}


# The flags that each case must have; the others must be false.
EXPECTED = {
    "clean-skill-no-extras": ["has_skill_md"],
    "missing-skill-md": [],
    "skill-with-scripts": ["has_skill_md", "has_scripts"],
    "skill-with-evals": ["has_skill_md", "has_evals"],
    "skill-with-references": ["has_skill_md", "has_references"],
    "skill-all-extras": ["has_skill_md", "has_scripts", "has_references", "has_evals"],
    "empty-input": [],
}


def chosen_cases(names: list[str] | None = None) -> dict[str, dict[str, str]]:
    """The cases named, or all; a ValueError if none has such a name."""
    chosen = {n: CASES[n] for n in CASES if names is None or n in names}
    if not chosen:
        raise ValueError(f"no case is named {', '.join(names or [])}")
    return chosen


def verdicts(results: DataFrame, names: list[str] | None = None) -> DataFrame:
    """results (package_id, case_name and the flags) with `agrees`: whether all flags are those that the case must
    have.  Packages of cases not chosen are left out.  The case table has seven rows and is broadcast."""
    flags = ["has_skill_md", "has_scripts", "has_references", "has_evals"]
    rows = [(n, [f in EXPECTED[n] for f in flags]) for n in chosen_cases(names)]
    expected = results.sparkSession.createDataFrame(rows, "case_name string, expected array<boolean>")
    return results.join(F.broadcast(expected), "case_name").withColumn("agrees", F.array(*flags) == F.col("expected")).drop("expected")


def table(spark: SparkSession, names: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, paths, packages) of the cases named, or of all; a ValueError if none has such a name."""
    chosen = chosen_cases(names)
    rows = [(n, p, c) for n, f in chosen.items() for p, c in f.items()]
    files = spark.createDataFrame(rows, "package_id string, path string, content string")
    return files, files.select("package_id", "path"), spark.createDataFrame([(n,) for n in chosen], "package_id string")


def tally(summary: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: how many packages passed, failed or gave an error record.  summary: compare.diff_summary;
    a package with an error counts as such alone."""
    bad = errors.select("package_id", F.lit(True).alias("bad")).distinct()
    both = summary.select("package_id", "passed").join(bad, "package_id", "full_outer")
    n = lambda when, name: F.count(F.when(when, True)).alias(name)
    fine = F.col("bad").isNull()
    return both.agg(n(fine & F.col("passed"), "passed"), n(fine & ~F.col("passed"), "failed"), n(~fine, "errors"))

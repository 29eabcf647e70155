"""Flags of a package's layout and the findings that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import exploded, listed, struct_of

FLAGS = ["has_skill_md", "has_scripts", "has_references", "has_evals", "has_assets"]


def flag_tests(p: Column) -> dict[str, Column]:
    """What a listed path says for each flag."""
    return {
        "has_skill_md": p.isin("SKILL.md", "skill.md"),
        "has_scripts": p.startswith("scripts/"),
        "has_references": p.startswith("references/"),
        "has_evals": p.startswith("evals/") | p.startswith("tests/") | p.startswith("test/") | p.isin("evals.json", "evals.yaml", "evals.yml"),
        "has_assets": p.startswith("assets/"),
    }


def flags(packages: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """package_id, five flags and file_count (listed paths, repeats included), for every package."""
    p = F.col("path")
    tests = flag_tests(p)
    listed = paths.groupBy("package_id").agg(*[F.bool_or(t).alias(k) for k, t in tests.items()], F.count("path").alias("file_count"))
    held = files.where(p.isin("SKILL.md", "skill.md")).select("package_id").distinct().withColumn("__held", F.lit(True))
    out = packages.join(listed, "package_id", "left").join(held, "package_id", "left")
    flag = lambda k: F.coalesce(F.col(k), F.lit(False))
    return out.select("package_id", (flag("has_skill_md") | flag("__held")).alias("has_skill_md"), *[flag(k).alias(k) for k in FLAGS[1:]], F.coalesce("file_count", F.lit(0)).cast("bigint").alias("file_count"))


# Phase, flag, rule, category, then severity, label and detail with and without it.
LAYOUT = [
    (10, "has_skill_md", "VTD-0095", "structure", ("info", "SKILL.md present", "Required skill definition file found"), ("critical", "SKILL.md missing", "Every skill must contain a SKILL.md file with YAML frontmatter and instructions")),
    (20, "has_scripts", "VTD-0096", "structure", ("info", "scripts/ directory present", "Bundled executable scripts found"), ("info", "No scripts/ directory", "Consider bundling reusable scripts for validation and automation")),
    (30, "has_references", "VTD-0097", "structure", ("info", "references/ directory present", "Additional documentation files available for progressive disclosure"), None),
    (40, "has_assets", "VTD-0098", "structure", ("info", "assets/ directory present", "Static resources (templates, schemas, etc.) found"), None),
    (50, "has_evals", "VTD-0118", "evals", ("info", "Evaluation test cases found", "evals/ directory or evals.json present for testing skill quality"), ("info", "No evaluation test cases", "Add an evals/ directory with test prompts and expected outputs to measure skill quality")),
]


def layout_found(flag) -> Column:
    """VTD-0095 to 0098 and 0118; flag(name) is the column of a flag."""
    rows = []
    for phase, name, rule, category, yes, no in LAYOUT:
        for when, text in ((flag(name), yes), (~flag(name), no)):
            if text:
                rows.append(F.when(when, struct_of(phase, rule, category, *text)))
    return listed(*rows)


def layout(flags_: DataFrame) -> DataFrame:
    return exploded(flags_, layout_found(F.col))

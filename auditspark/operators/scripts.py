"""Scripts that a package offers on the command line, and external links of its definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import DEPENDENCY, INTERACTIVE, STRUCTURED
from .base import exploded, listed, row, settled, struct_of, told

# Files that are no command, by name, extension or folder; folders and signs that need a hint.
NOT_COMMANDS = ["__init__.py", "utils.py", "helper.py", "helpers.py", "base.py", "constants.py"]
DATA_EXTENSIONS = ["json", "xml", "xsd", "yaml", "yml", "toml", "txt", "md", "csv", "tsv"]
DATA_FOLDERS = ["/schemas/", "/templates/", "/fixtures/", "/examples/", "/testdata/"]
HELPER_FOLDERS = ["/helpers/", "/lib/", "/validators/"]
SHELL_EXTENSIONS = ["sh", "bash", "zsh"]
HINTS = ["argparse", "argumentparser", ".option(", "yargs", "commander", "process.argv", "deno.args", "sys.argv", "click.command", "click.group", "typer."]
EXACT_HINTS = ["--help", "if __name__ == '__main__'", 'if __name__ == "__main__"']


def has_cli_hint(content: Column) -> Column:
    return X.bound(F.lower(content), lambda low: X.contains_any(low, HINTS)) | X.contains_any(content, EXACT_HINTS)


def is_cli_script(path: Column, content: Column) -> Column:
    low = F.lower(path)
    extension = F.substring_index(low, ".", -1)
    hint = has_cli_hint(content)
    out_of_question = ~path.startswith("scripts/") | F.substring_index(low, "/", -1).isin(NOT_COMMANDS) | extension.isin(DATA_EXTENSIONS) | X.contains_any(low, DATA_FOLDERS)
    return (
        F.when(out_of_question, F.lit(False))
        .when(X.contains_any(low, HELPER_FOLDERS), hint)
        .when(extension.isin(SHELL_EXTENSIONS), F.lit(True))
        .otherwise((F.size(F.split(path, "/")) <= 2) | hint)
    )


def script_facts(path: Column, content: Column) -> Column:
    """struct<cli, hint, prompts, structured, unpinned> of a script."""
    t = content
    return F.struct(
        is_cli_script(path, t).alias("cli"), has_cli_hint(t).alias("hint"), t.rlike(X.java(INTERACTIVE)).alias("prompts"), t.rlike(X.java(STRUCTURED)).alias("structured"),
        (t.rlike(X.java(DEPENDENCY)) & t.contains(">=") & ~t.contains("<")).alias("unpinned"),
    )


def cli_scripts(files: DataFrame) -> DataFrame:
    """package_id, path and script (script_facts) of the command-line scripts."""
    rows = files.where(F.col("path").startswith("scripts/"))
    if "script" not in files.columns:
        rows = settled(rows, script=script_facts(F.col("path"), F.col("content")))
    return rows.where("script.cli").select("package_id", "path", "script")


def script_found(path: Column, script: Column) -> Column:
    """Help, prompts, output format and version pins of a command-line script."""
    lit, hint = F.lit, script["hint"]
    say = lambda text: F.concat(path, lit(f": {text}"))
    return told(140, "scripts", [
        row(None, 0, "VTD-0114", "info", F.when(hint, lit("CLI help supported")).otherwise(lit("No --help support")), F.when(hint, say("Script documents its interface via --help or argument parsing")).otherwise(say("Add argument parsing with --help output so agents know the script's interface"))),
        row(script["prompts"], 1, "VTD-0115", "high", lit("Interactive prompts detected"), say("Agents run in non-interactive shells — replace prompts with CLI flags or stdin")),
        row(script["structured"], 2, "VTD-0116", "info", lit("Structured output format"), say("Uses JSON/CSV output which is easily parseable by agents")),
        row(script["unpinned"], 3, "VTD-0117", "low", lit("Unpinned dependency versions"), say("Pin dependency versions for reproducibility (e.g., >=4.12,<5 instead of >=4.12)")),
    ], path)


def script_checks(files: DataFrame, flags: DataFrame) -> DataFrame:
    """Findings of each command-line script, of packages that list scripts."""
    rows = cli_scripts(files).join(flags.where("has_scripts").select("package_id"), "package_id", "left_semi")
    return exploded(rows, script_found(F.col("path"), F.col("script")))


def has_link(content: Column) -> Column:
    return content.contains("http://") | content.contains("https://")


def link_group(p: Column) -> Column:
    """The rank of a file whose links count, or null."""
    return F.when(p == "SKILL.md", 0).when(p == "skill.md", 1).when(F.lower(p).startswith("references/"), 2)


def url_targets(files: DataFrame) -> DataFrame:
    """Per package that has any: the first definition or reference file with a link, or null."""
    grp = link_group(F.col("path"))
    link = F.col("link") if "link" in files.columns else has_link(F.col("content"))
    rows = files.withColumn("grp", grp).where("grp is not null").select("package_id", F.when(link, F.struct("grp", "path")).alias("hit"))
    return rows.groupBy("package_id").agg(F.min("hit").alias("hit")).select("package_id", F.col("hit.path").alias("path"))


def url_struct(path: Column) -> Column:
    """VTD-0088 for a file with a link, VTD-0093 for null."""
    none = path.isNull()
    return struct_of(
        230, F.when(none, F.lit("VTD-0093")).otherwise(F.lit("VTD-0088")), "security", F.when(none, F.lit("info")).otherwise(F.lit("medium")),
        F.when(none, F.lit("No external URLs in skill definition")).otherwise(F.lit("References external URL — review for indirect prompt injection risk")),
        F.when(none, F.lit("SKILL.md and references/ files do not reference external URLs")).otherwise(F.concat(F.lit("External URL(s) detected in "), path, F.lit(" — referenced content can change after audit"))),
        filepath=path,
    )


def external_urls(files: DataFrame) -> DataFrame:
    """VTD-0088 for the first file with a link, VTD-0093 where the files have none."""
    return exploded(url_targets(files), listed(url_struct(F.col("path"))))

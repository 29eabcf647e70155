"""Checks of a package's definition file: front matter, name, description, body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import BENIGN_WORDS, CHECKLIST, GENERIC_PHRASES, GOTCHAS, OVERCLAIM, POPULAR_NAMES, PROMPT_LEAK, READ_MD, WELL_KNOWN_NAMES
from .base import FINDINGS, exploded, listed, row, settled, struct_of, told
from .markdown import parsed_definition

# Limits.
NAME_BYTES, DESCRIPTION_CHARACTERS, BODY_LINES = 64, 1024, 500
# Substrings of a lower-cased body that mean examples, of which the first is a fence.
EXAMPLES = ["# example", "## example", "# sample", "## sample", "# demo", "## demo", "**input**", "**output**", "**before**", "**after**", "**example**", "**good**", "**bad**"]
WORKFLOW_HEADINGS = ["workflow", "steps", "instructions", "procedure", "process", "how to", "usage", "guidelines"]


def definitions(packages: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """package_id, content (null if the file is only listed), name, description, repository, body of
    the packages that have SKILL.md or skill.md, the former first."""
    names = ["SKILL.md", "skill.md"]
    content = files.where(F.col("path").isin(names)).groupBy("package_id").agg(*[F.max(F.when(F.col("path") == n, F.col("content"))).alias(n.split(".")[0]) for n in names])
    listed = paths.where(F.col("path").isin(names)).select("package_id").distinct()
    got = content.toDF("package_id", "upper", "lower").select("package_id", F.coalesce("upper", "lower").alias("content"))
    both = listed.join(got, "package_id", "full_outer")
    unknown = F.struct(F.lit("unknown").alias("name"), F.lit("").alias("description"), F.lit("").alias("repository"), F.lit("").alias("body"))
    return settled(both, d=F.when(F.col("content").isNotNull(), parsed_definition(F.col("content"))).otherwise(unknown)).select("package_id", "content", "d.*")


def name_error(name: Column) -> Column:
    """Why a name is not valid, or null; the first reason counts."""
    plain = lambda c: c.rlike(r"\A[A-Za-z0-9]\z")
    ends = F.array(F.substring(name, 1, 1), F.right(name, F.lit(1)))
    bad = F.lit("name contains invalid characters (only alphanumeric and hyphens allowed)")
    return (
        F.when(name == "", F.lit("name field is missing"))
        .when(F.octet_length(name) > NAME_BYTES, F.lit("name exceeds 64-character limit"))
        .when(~plain(ends[0]), F.when(ends[0] == "-", F.lit("name must not start or end with a hyphen")).otherwise(bad))
        .when(~plain(ends[1]), F.when(ends[1] == "-", F.lit("name must not start or end with a hyphen")).otherwise(bad))
        .when(~name.rlike(r"\A[A-Za-z0-9-]*\z"), bad)
        .when(name.contains("--"), F.lit("name must not contain consecutive hyphens"))
    )


def close_names(name: Column) -> Column:
    """Popular names within two edits, but not the name itself."""
    return F.filter(F.array(*[F.lit(p) for p in POPULAR_NAMES]), lambda p: (p != name) & F.levenshtein(name, p, 2).between(0, 2))


def first_three(names: Column) -> Column:
    return F.array_join(F.slice(names, 1, 3), ", ")


def typosquat_found(c) -> Column:
    """The finding about a name that is close to popular ones, or null."""

    def told(near: Column) -> Column:
        more = F.when(F.size(near) > 3, F.concat(F.lit(" and "), (F.size(near) - 3).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
        one = F.concat(F.lit('Skill name "'), c("name"), F.lit('" is within Levenshtein distance 2 of popular skill "'), F.get(near, F.lit(0)), F.lit('"'))
        many = F.concat(F.lit('Skill name "'), c("name"), F.lit('" is within Levenshtein distance 2 of '), F.size(near).cast("string"), F.lit(" popular skills: "), first_three(near), more)
        single = F.size(near) == 1
        return F.when(F.size(near) > 0, struct_of(60, "VTD-0082", "security", F.when(single, F.lit("medium")).otherwise(F.lit("critical")), "Possible typosquatting", F.when(single, one).otherwise(many), intent="negligent"))

    return F.when(~c("name").isin("unknown", ""), X.bound(close_names(c("name")), told))


def typosquats(defs: DataFrame) -> DataFrame:
    return exploded(defs, listed(typosquat_found(F.col)))


def has_examples(body: Column, low: Column | None = None) -> Column:
    return body.contains("```") | X.contains_any(F.lower(body) if low is None else low, EXAMPLES)


def has_gotchas(body: Column) -> Column:
    return body.rlike(X.java(GOTCHAS))


def has_checklist(body: Column) -> Column:
    return body.contains("- [ ]") | body.rlike(X.java(CHECKLIST))


def has_validation(body: Column, low: Column | None = None) -> Column:
    """A substring is enough, so "invalidation" counts; so does a heading of verification,
    which no white space precedes."""
    low = F.lower(body) if low is None else low
    return low.contains("validat") | low.rlike(r"(?dUm)^#+[^\S\n]*verification")


def has_workflow(body: Column, low: Column | None = None) -> Column:
    low = F.lower(body) if low is None else low
    first_step = F.instr(low, "step")
    return (
        X.contains_any(low, [f"# {w}" for w in WORKFLOW_HEADINGS])
        | ((first_step > 0) & F.substring(low, first_step + 4, F.length(low)).rlike(r"\A *[0-9]"))
        | body.rlike(r"(?dm)^[0-9]+\. ")
        | low.rlike(r"(?dUm)^[^\S\n]*[-*] .*\*\*step")
    )


def has_usage_context(description: Column) -> Column:
    low = F.lower(description)
    behind = F.substring(low, F.instr(low, "when "), F.length(low))
    return X.contains_any(low, ["use this ", "use when", "use for"]) | (low.contains("when ") & X.contains_any(behind, ["need", "want", "ask", "mention"]))


def description_found(c) -> Column:
    """Findings about a description; c(name) is a column of the definition."""
    d = c("description")
    n = F.length(d)
    some, context, lit = d != "", has_usage_context(d), F.lit
    return told(120, "description", [
        row(~some, 0, "VTD-0109", "info", lit("Missing description field"), lit("The description field is required and should describe what the skill does and when to use it")),
        row(some & (n > DESCRIPTION_CHARACTERS), 1, "VTD-0110", "info", lit("Description exceeds 1024-character limit"), F.concat(lit("Description is "), n.cast("string"), lit(" characters (max: 1024)"))),
        row(some & (n <= DESCRIPTION_CHARACTERS), 1, "VTD-0110", "info", lit("Description within character limit"), F.concat(n.cast("string"), lit("/1024 characters used"))),
        row(some & context, 2, "VTD-0111", "info", lit("Description includes usage context"), lit("Good: description explains when to activate the skill")),
        row(some & ~context, 2, "VTD-0111", "info", lit("Description lacks usage context"), lit('Add context like "Use this skill when..." to help agents know when to activate it')),
        row(some & (F.size(F.regexp_extract_all(d, lit(r"(?U)\S+"), lit(0))) < 5), 3, "VTD-0112", "info", lit("Description too brief"), lit("A few sentences covering scope and trigger conditions improves activation accuracy")),
        row(some & d.rlike(X.java(OVERCLAIM)), 4, "VTD-0113", "low", lit("Description overclaims scope"), lit("Broad trigger words (anything, everything, all files, etc.) widen attack surface — narrow to specific use cases")),
    ])


def description_checks(defs: DataFrame) -> DataFrame:
    """One row per finding about descriptions."""
    return exploded(defs, description_found(F.col))


def generic_phrases(defs: DataFrame) -> DataFrame:
    """package_id, position and text of each vague phrase in a body."""
    low = F.lower("body")
    found = F.filter(F.transform(F.array(*[F.lit(p) for p in GENERIC_PHRASES]), lambda p, i: F.struct(i.alias("k"), p.alias("phrase"))), lambda s: low.contains(s["phrase"]))
    return defs.where(X.trimmed(F.col("body")) != "").select("package_id", F.explode_outer(found).alias("p")).where("p is not null").select("package_id", "p.*")


def body_found(c, flag) -> Column:
    """Best-practice findings about a body; c and flag give columns of the definition and the flags.  What several
    of them ask of the body is evaluated once."""
    b = c("body")
    asked = lambda low: F.struct(low.alias("low"), has_examples(b, low).alias("examples"), has_workflow(b, low).alias("workflow"))
    found = X.bound(F.lower(b), lambda low: X.bound(asked(low), lambda t: _body_told(b, t, flag)))
    return F.when(X.trimmed(b) != "", found).otherwise(F.array().cast(FINDINGS))


def _body_told(b: Column, t: Column, flag) -> Column:
    lit = F.lit
    n = F.size(X.lines(b))
    two = lambda when, yes, no: F.when(when, lit(yes)).otherwise(lit(no))
    refers = (b.contains("references/") | b.contains("scripts/") | b.contains("assets/") | b.rlike(X.java(READ_MD))) & (flag("has_references") | flag("has_scripts") | flag("has_assets"))
    vague = [row(t["low"].contains(p), i + 7, "VTD-0108", "info", lit("Generic instruction detected"), lit(f'"{p}" is too vague — provide specific, actionable guidance instead')) for i, p in enumerate(GENERIC_PHRASES)]
    return told(130, "best-practices", [
        row(lit(True), 0, "VTD-0101", "info", two(n > BODY_LINES, "SKILL.md exceeds 500 lines", "SKILL.md body length is reasonable"), F.concat(n.cast("string"), two(n > BODY_LINES, " lines — consider moving detailed reference material to references/", " lines (recommended: under 500)"))),
        row(has_gotchas(b), 1, "VTD-0102", "info", lit("Gotchas section found"), lit("Documents environment-specific facts and common pitfalls")),
        row(lit(True), 2, "VTD-0103", "info", two(t["examples"], "Examples included", "No examples found"), two(t["examples"], "Found code blocks, input/output samples, or an examples section — concrete samples help agents pattern-match effectively", "Add code blocks, input/output samples, or before/after examples to improve agent accuracy")),
        row(has_checklist(b), 3, "VTD-0104", "info", lit("Checklist pattern found"), lit("Explicit checklists help agents track progress in multi-step workflows")),
        row(lit(True), 4, "VTD-0106", "info", two(t["workflow"], "Step-by-step workflow found", "No clear workflow structure"), two(t["workflow"], "Structured procedures improve reliability for complex tasks", "Consider adding numbered steps or a structured procedure for the agent to follow")),
        row(has_validation(b, t["low"]), 5, "VTD-0105", "info", lit("Validation loop referenced"), lit("Instructions for the agent to validate its own work before proceeding")),
        row(refers, 6, "VTD-0107", "info", lit("Progressive disclosure used"), lit("SKILL.md body references files in references/, scripts/, or assets/ — agents can load additional context on demand instead of consuming everything upfront")),
        *vague,
    ])


def body_checks(defs: DataFrame, flags: DataFrame) -> DataFrame:
    """Best-practice findings about bodies; flags: PRJ of structure.flags."""
    return exploded(defs.join(flags, "package_id"), body_found(F.col, F.col))


def definition_found(c) -> Column:
    """Name, collision, repository and prompt-leak findings."""
    lit, error = F.lit, name_error(c("name"))
    return listed(
        typosquat_found(c),
        struct_of(70, "VTD-0099", "structure", F.when(error.isNull(), lit("info")).otherwise(lit("critical")), F.when(error.isNull(), lit("Valid name field")).otherwise(lit("Invalid name field")), F.coalesce(error, F.concat(lit('Name "'), c("name"), lit('" follows spec (lowercase, hyphens, ≤64 chars)')))),
        F.when(c("name").isin(WELL_KNOWN_NAMES), struct_of(80, "VTD-0100", "best-practices", "medium", "Skill name collides with well-known skill", F.concat(lit('"'), c("name"), lit('" matches a well-known skill name — may cause unintended invocation')))),
        F.when(c("repository") == "", struct_of(90, "VTD-0083", "security", "info", "No repository link", lit("No repository field found in SKILL.md frontmatter. Skills without a verifiable source repository cannot be externally audited."), intent="negligent")),
        F.when(c("content").rlike(X.java(PROMPT_LEAK)), struct_of(110, "VTD-0085", "security", "medium", "System prompt leakage risk", lit("Skill instructs agent to output or reveal system prompt/instructions"))),
    )


def definition_checks(defs: DataFrame) -> DataFrame:
    return exploded(defs, definition_found(F.col))


def benign_words(description: Column) -> Column:
    """Words of a harmless purpose that a description contains."""
    low = F.lower(description)
    return F.filter(F.array(*[F.lit(w) for w in BENIGN_WORDS]), lambda w: low.contains(w))


def mismatch_struct(words: Column) -> Column:
    detail = F.concat(F.lit("Description uses benign-sounding terms ("), first_three(words), F.lit(") but the package contains malicious security findings. Review carefully."))
    return struct_of(270, "VTD-0087", "security", "medium", "Description suggests benign skill but code contains malicious security patterns", detail)


def definition_fact(content: Column | None) -> Column:
    """struct<found, harmless>: the findings that a definition file gives rise to - that about references
    (VTD-0107) as though the package had such folders - and the harmless words of its description.  Without
    content the file is only listed."""
    unknown = F.struct(F.lit("unknown").alias("name"), F.lit("").alias("description"), F.lit("").alias("repository"), F.lit("").alias("body"))

    def fact(d: Column) -> Column:
        text = F.lit(None).cast("string") if content is None else content
        c = lambda n: text if n == "content" else d[n]
        found = F.concat(definition_found(c), description_found(c), body_found(c, lambda _: F.lit(True)))
        return F.struct(found.alias("found"), benign_words(d["description"]).alias("harmless"))

    return X.bound(unknown if content is None else parsed_definition(content), fact)


def mismatches(defs: DataFrame, findings: DataFrame) -> DataFrame:
    """Harmless-sounding descriptions of packages with malicious security findings (after chains)."""
    bad = findings.where("category = 'security' and intent = 'malicious'").select("package_id").distinct()
    found = defs.withColumn("words", benign_words(F.col("description"))).where(F.size("words") > 0).join(bad, "package_id", "left_semi")
    return exploded(found, listed(mismatch_struct(F.col("words"))))

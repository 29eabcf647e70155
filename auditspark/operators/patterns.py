"""Line patterns over files: sensitive and behavioral rules, sinks, high-entropy values, env files.

What a match of a rule must hold is read off the rule's own pattern, and one automaton over the literals of all
rules names each text's candidates in a single pass (functions.literals).  Only the candidates' patterns
run, line by line, picked from the rule table by number, so plans do not grow with the table.  Everything
stays within the row of a file; nothing is exploded before it has matched, and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.literals import Alternatives, met, required
from ..registry import BEHAVIORAL, ENV_FILE, NEGATION, SECRET_KEY, SENSITIVE, SINKS, Behavioral, Sensitive
from .base import FINDINGS, detected, exploded, is_markdown, listed, pick, struct_of
from .markdown import masked_lines

#: A possessive filler keeps the first behavioral pattern from overflowing the stack on long repeats.
FILLER, POSSESSIVE = r"(?:all\s+|every\s+|the\s+|any\s+|your\s+|my\s+|these\s+|those\s+)*", r"(?:all\s+|every\s+|the\s+|any\s+|your\s+|my\s+|these\s+|those\s+)*+"
#: Matches of the assignment pattern start at the first letter of a run of key characters, so a match
#: is only tried there; this gives the same keys and values in linear time.
ASSIGNMENT_ANCHORED = r"""(?<![A-Za-z0-9_.:-])[0-9.:-]*+(?:["']?([A-Za-z_][A-Za-z0-9_.:-]*)["']?\s*[:=]\s*["']([^"'\r\n]{20,})["'])"""


@dataclass(frozen=True)
class Rules:
    """Rule tables and what they demand of a text.  Requirements are numbered: sensitive rules, behavioral
    rules, a key that names a secret, a sink."""

    sensitive: tuple[Sensitive, ...] = tuple(SENSITIVE)
    behavioral: tuple[Behavioral, ...] = tuple(BEHAVIORAL)

    @cached_property
    def demands(self) -> list[Alternatives]:
        lines = [required(p.regex, spaces=False) for p in self.behavioral]  # of lines with white space collapsed
        return [*(required(p.regex) for p in self.sensitive), *lines, required(SECRET_KEY), frozenset().union(*map(required, SINKS))]

    @property
    def ends(self) -> tuple[int, int]:
        """The first numbers behind the sensitive and the behavioral rules."""
        return len(self.sensitive), len(self.sensitive) + len(self.behavioral)


def rules(sensitive: list[Sensitive] | None = None, behavioral: list[Behavioral] | None = None) -> Rules:
    return Rules(tuple(SENSITIVE if sensitive is None else sensitive), tuple(BEHAVIORAL if behavioral is None else behavioral))


def demanded(text: Column, of: Rules) -> Column:
    """array<int>: numbers of the requirements that the text meets."""
    return met(text, of.demands)


def _table(values: list, kind: str) -> Column:
    """A column of a rule table as a constant array, to be picked from by number."""
    return F.expr(f"CAST(array({', '.join(X.sql(v) if isinstance(v, str) else str(v).lower() for v in values)}) AS array<{kind}>)")


def _regexes(table: tuple[Sensitive, ...] | tuple[Behavioral, ...]) -> Column:
    return _table([X.java(p.regex.replace(FILLER, POSSESSIVE)) for p in table], "string")


def _matches(text: Column, regex: Column) -> Column:
    # unlike RLIKE, this keeps the last pattern compiled where it is not constant
    return F.regexp_instr(text, regex) > 0


def _first_true(flags: Column) -> Column:
    return F.array_position(flags, F.lit(True)).cast("bigint")


SENSITIVE_HITS = "array<struct<idx: int, line_no: bigint, snippet: string>>"
BEHAVIORAL_HITS = "array<struct<idx: int, n: bigint, line_no: bigint, snippet: string>>"


def _codes(of: Rules, m: Column, markdown: Column | None) -> Column:
    """The candidates among the sensitive rules: indices into their table."""
    if markdown is None or not any(p.code_only for p in of.sensitive):
        return F.filter(m, lambda i: i < of.ends[0])
    code_only = _table([p.code_only for p in of.sensitive], "boolean")
    return X.bound(markdown, lambda k: F.filter(m, lambda i: (i < of.ends[0]) & ~(k & F.coalesce(F.get(code_only, i), F.lit(False)))))


def sensitive_found(of: Rules, path: Column, content: Column, m: Column) -> Column:
    """array<struct<idx, line_no, snippet>>: the first matching line of each rule in a file that meets m.
    The lines are split once, where there is a candidate."""
    none = F.array().cast(SENSITIVE_HITS)
    if not of.sensitive:
        return none
    regexes = _regexes(of.sensitive)

    def hits(codes: Column) -> Column:
        def found(lines: Column) -> Column:
            first = F.transform(codes, lambda i: F.struct(i.alias("idx"), _first_true(F.transform(lines, lambda x: _matches(x, F.get(regexes, i)))).alias("line_no")))
            return F.transform(F.filter(first, lambda h: h["line_no"] > 0), lambda h: F.struct(h["idx"].alias("idx"), h["line_no"].alias("line_no"), X.snippet(F.element_at(lines, h["line_no"].cast("int"))).alias("snippet")))

        return F.when(F.size(codes) > 0, X.bound(X.lines(content), found)).otherwise(none)

    return X.bound(_codes(of, m, is_markdown(path)), hits)


def first_sensitive(of: Rules, value: Column, m: Column, markdown: Column | None = None) -> Column:
    """The index of the first rule that `value`, which meets m, matches as a whole, or null."""
    if not of.sensitive:
        return F.lit(None).cast("int")
    regexes = _regexes(of.sensitive)
    return F.get(F.filter(_codes(of, m, markdown), lambda i: _matches(value, F.get(regexes, i))), F.lit(0))


def _exploded(files: DataFrame, name: str, found: Column) -> DataFrame:
    """package_id, path, m: a row per match.  (explode() would have the optimizer evaluate the
    patterns once more, as a filter.)"""
    column = F.col(name) if name in files.columns else found
    return files.select("package_id", "path", F.explode_outer(column).alias("m")).where("m is not null")


def sensitive_matches(files: DataFrame, registry: list[Sensitive] = SENSITIVE) -> DataFrame:
    """First match per file and pattern: package_id, path, pat_idx, line_no, snippet and the rule's columns."""
    markdown, of = is_markdown(F.col("path")), rules(registry, [])
    if "sensitive" not in files.columns:
        files = files.select("package_id", "path", "content", demanded(F.col("content"), of).alias("__met"))
    hits = _exploded(files, "sensitive", sensitive_found(of, F.col("path"), F.col("content"), F.col("__met")))
    i = F.col("m.idx")
    return hits.select(
        "package_id", "path", i.alias("pat_idx"), F.col("m.line_no").alias("line_no"), F.col("m.snippet").alias("snippet"),
        pick([p.rule for p in registry], i).alias("rule_id"), pick([p.label for p in registry], i).alias("label"), pick([p.intent for p in registry], i).alias("intent"),
        F.coalesce(F.when(markdown, pick([p.doc_severity for p in registry], i)), pick([p.severity for p in registry], i)).alias("severity"), pick([p.bucket for p in registry], i).alias("bucket"),
    )


def sensitive_struct(of: Rules, path: Column, m: Column) -> Column:
    t, i = of.sensitive, m["idx"]
    severity = F.coalesce(F.when(is_markdown(path), pick([p.doc_severity for p in t], i)), pick([p.severity for p in t], i))
    return struct_of(
        150, pick([p.rule for p in t], i), "security", severity, pick([p.label for p in t], i), detected(path, m["line_no"], m["snippet"]), filepath=path, intent=pick([p.intent for p in t], i),
        k1=path, k2=i, line_no=m["line_no"], detected_in=path, bucket=pick([p.bucket for p in t], i),
    )


def entropy_struct(path: Column, m: Column) -> Column:
    return struct_of(160, "VTD-0003", "security", "critical", "High-entropy value — potential hardcoded secret", detected(path, m["line_no"], m["snippet"]), filepath=path, k1=path, k2=m["line_no"], line_no=m["line_no"], detected_in=path)


def env_struct(path: Column) -> Column:
    detail = F.concat(F.lit("Found "), path, F.lit(" — should be excluded from distribution"))
    return F.when(path.rlike(X.java(ENV_FILE)), struct_of(170, "VTD-0004", "security", "critical", "Environment file included in skill package", detail, filepath=path, k1=path))


def behavioral_struct(of: Rules, path: Column, m: Column) -> Column:
    t, i = of.behavioral, m["idx"]
    note = F.when(m["n"] > 1, F.concat(F.lit(" ("), m["n"].cast("string"), F.lit(" matches)"))).otherwise(F.lit(""))
    return struct_of(200, pick([p.rule for p in t], i), "security", pick([p.severity for p in t], i), pick([p.label for p in t], i), detected(path, m["line_no"], m["snippet"], note), filepath=path, k1=path, k2=i, line_no=m["line_no"], detected_in=path)


def line_findings(of: Rules, path: Column, fact) -> Column:
    """The findings of a file that its own facts give; fact(name) is a column."""
    parts = [F.transform(fact("entropy"), lambda m: entropy_struct(path, m)).cast(FINDINGS), listed(env_struct(path))]
    if of.sensitive:
        parts.append(F.transform(fact("sensitive"), lambda m: sensitive_struct(of, path, m)).cast(FINDINGS))
    if of.behavioral:
        parts.append(F.transform(fact("behavioral"), lambda m: behavioral_struct(of, path, m)).cast(FINDINGS))
    return F.concat(*parts)


def sensitive(files: DataFrame, registry: list[Sensitive] = SENSITIVE) -> DataFrame:
    of = rules(registry, [])
    if "sensitive" not in files.columns:
        files = files.select("package_id", "path", "content", demanded(F.col("content"), of).alias("__met"))
    hits = _exploded(files, "sensitive", sensitive_found(of, F.col("path"), F.col("content"), F.col("__met")))
    return hits.select("package_id", sensitive_struct(of, F.col("path"), F.col("m")).alias("f")).select("package_id", "f.*")


def entropy_found(path: Column, content: Column, least: float = 3.5, some: Column | None = None) -> Column:
    """array<struct<line_no, snippet, entropy>>: the lines of a file other than markdown that assign a
    quoted value of high entropy to a key that names a secret; the first such value of a line counts.
    Where `some` (whether the file may hold such a key) is false, no line is looked at."""
    pattern = F.lit(X.java(ASSIGNMENT_ANCHORED))

    def first(line: Column) -> Column:
        keys, values = F.regexp_extract_all(line, pattern, F.lit(1)), F.regexp_extract_all(line, pattern, F.lit(2))
        of_secrets = F.zip_with(keys, values, lambda k, v: F.when(k.rlike(X.java(SECRET_KEY)), X.entropy(v)))
        return F.get(F.filter(of_secrets, lambda h: h >= least), F.lit(0))

    assigns = lambda x: x.rlike(r"[:=]\s*[\"']") & x.rlike(X.java(ASSIGNMENT_ANCHORED))
    numbered = F.transform(X.lines(content), lambda x, i: F.when(assigns(x), F.struct((i + 1).cast("bigint").alias("line_no"), X.snippet(x).alias("snippet"), first(x).alias("entropy"))))
    out = is_markdown(path) if some is None else is_markdown(path) | ~some
    return F.filter(F.when(out, F.array()).otherwise(numbered), lambda s: s["entropy"].isNotNull())


def entropy_matches(files: DataFrame) -> DataFrame:
    """package_id, path, line_no, snippet, entropy of every such line."""
    return _exploded(files, "entropy", entropy_found(F.col("path"), F.col("content"))).select("package_id", "path", "m.*")


def entropy(files: DataFrame) -> DataFrame:
    hits = _exploded(files, "entropy", entropy_found(F.col("path"), F.col("content")))
    return hits.select("package_id", entropy_struct(F.col("path"), F.col("m")).alias("f")).select("package_id", "f.*")


def env_files(files: DataFrame) -> DataFrame:
    return exploded(files.where(F.col("path").rlike(X.java(ENV_FILE))), listed(env_struct(F.col("path"))))


def has_sink(content: Column) -> Column:
    """Whether the text sends something over the network; white space may cross lines."""
    words = ["fetch", "axios", "requests", "xmlhttprequest", "curl", "wget", "sock", "smtplib", "nodemailer", "sendgrid", "http"]
    return X.contains_any(X.folded(content), words) & sends(content)


def sends(content: Column) -> Column:
    out = F.lit(False)
    for p in SINKS:
        out = out | content.rlike(X.java(p))
    return out


def _signals(of: Rules, m: Column) -> Column:
    """The candidates among the behavioral rules: indices into their table."""
    return F.transform(F.filter(m, lambda i: (i >= of.ends[0]) & (i < of.ends[1])), lambda i: i - of.ends[0])


def first_behavioral(of: Rules, line: Column, m: Column) -> Column:
    """The index of the first rule that `line`, normalized, matches, denials and masks aside, or null."""
    if not of.behavioral:
        return F.lit(None).cast("int")
    regexes = _regexes(of.behavioral)
    return F.get(F.filter(_signals(of, m), lambda i: _matches(line, F.get(regexes, i))), F.lit(0))


def normal_lines(of: Rules, path: Column, content: Column, m: Column) -> Column:
    """The masked and normalized lines of a file, or null if it meets no behavioral rule's demand."""
    some = F.exists(m, lambda i: (i >= of.ends[0]) & (i < of.ends[1]))
    return F.when(some, F.transform(F.when(is_markdown(path), masked_lines(content)).otherwise(X.lines(content)), lambda x: X.normalized(x)))


def _undenied(line: Column, regex: Column) -> Column:
    """How many matches on a line no denial before them silences."""

    def count(t: Column) -> Column:
        # before match k stand the parts between matches up to it and the matches in between; the last forty
        # of either hold the forty characters that count
        def before(k: Column) -> Column:
            near = F.transform(F.sequence(F.greatest(k - 40, F.lit(0)), k), lambda j: F.when(j < k, F.array(F.get(t["parts"], j), F.get(t["found"], j))).otherwise(F.array(F.get(t["parts"], j))))
            return F.right(F.array_join(F.flatten(near), ""), F.lit(40))

        return F.size(F.filter(F.transform(t["found"], lambda f, k: before(k)), lambda b: ~b.rlike(X.java(NEGATION))))

    return X.bound(F.struct(F.regexp_extract_all(line, regex, F.lit(0)).alias("found"), F.split(line, regex, -1).alias("parts")), count)


def behavioral_found(of: Rules, rows: Column, m: Column) -> Column:
    """array<struct<idx, n, line_no, snippet>>: matches per rule that no denial before them silences, with the
    first one's line, in the normal lines of a file that meets m."""
    none = F.array().cast(BEHAVIORAL_HITS)
    if not of.behavioral:
        return none
    regexes, look_back = _regexes(of.behavioral), _table([p.look_back for p in of.behavioral], "boolean")

    def count(x: Column, i: Column) -> Column:
        regex = F.get(regexes, i)
        return F.when(F.get(look_back, i) & _matches(x, regex), _undenied(x, regex)).otherwise(F.size(F.regexp_extract_all(x, regex, F.lit(0))))

    def one(lines: Column, i: Column) -> Column:
        total = lambda c: F.aggregate(c, F.lit(0), lambda a, b: a + b).cast("bigint")
        return X.bound(F.transform(lines, lambda x: count(x, i)), lambda c: F.struct(i.alias("idx"), total(c).alias("n"), _first_true(F.transform(c, lambda v: v > 0)).alias("line_no")))

    def found(t: Column) -> Column:
        hits = F.filter(F.transform(t["codes"], lambda i: one(t["lines"], i)), lambda h: h["n"] > 0)
        told = F.transform(hits, lambda h: F.struct(h["idx"].alias("idx"), h["n"].alias("n"), h["line_no"].alias("line_no"), F.substring(F.element_at(t["lines"], h["line_no"].cast("int")), 1, 120).alias("snippet")))
        return F.when(F.size(t["codes"]) > 0, told).otherwise(none)

    return X.bound(F.struct(_signals(of, m).alias("codes"), rows.alias("lines")), found)


def behavioral_matches(files: DataFrame, registry: list[Behavioral] = BEHAVIORAL) -> DataFrame:
    """Matches per file and pattern: package_id, path, pat_idx, n, line_no and snippet of the first."""
    of = rules([], registry)
    if "behavioral" not in files.columns:
        files = files.select("package_id", "path", "content", demanded(F.col("content"), of).alias("__met"))
        files = files.select("package_id", "path", "__met", normal_lines(of, F.col("path"), F.col("content"), F.col("__met")).alias("__rows"))
    hits = _exploded(files, "behavioral", behavioral_found(of, F.col("__rows"), F.col("__met")))
    i = F.col("m.idx")
    return hits.select(
        "package_id", "path", i.alias("pat_idx"), F.col("m.n").alias("n"), F.col("m.line_no").alias("line_no"), F.col("m.snippet").alias("snippet"),
        pick([p.rule for p in registry], i).alias("rule_id"), pick([p.label for p in registry], i).alias("label"), pick([p.severity for p in registry], i).alias("severity"),
    )


def behavioral(files: DataFrame, registry: list[Behavioral] = BEHAVIORAL) -> DataFrame:
    of = rules([], registry)
    hits = behavioral_matches(files, registry).select("package_id", "path", F.struct(F.col("pat_idx").alias("idx"), "n", "line_no", "snippet").alias("m"))
    return hits.select("package_id", behavioral_struct(of, F.col("path"), F.col("m")).alias("f")).select("package_id", "f.*")

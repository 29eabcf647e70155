"""What base64 and invisible characters hide."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.literals import met_all
from ..registry import B64_CHUNK, BEHAVIORAL, EVAL_FILES, SENSITIVE, URL_HIDDEN, URL_IN_B64, Behavioral, Sensitive
from . import definition, evals, scripts
from .base import is_markdown, pick, settled, struct_of
from .patterns import Rules, behavioral_found, entropy_found, first_behavioral, first_sensitive, normal_lines, rules, sends, sensitive_found

# Shortest literal, widest gap and shortest group of joined literals; printable share.
LITERAL, GAP, GROUP, PRINTABLE = 4, 10, 40, 0.75
#: The characters of either alphabet, one by one, for a class.
WORD_64 = string.ascii_letters + string.digits + "+/_" + r"\-"
#: Pieces of a text: what stands outside quotes, closed literals, and an unclosed rest.
PIECES = r"""[^'"]+|'[^']*'|"[^"]*"|'[^']*\z|"[^"]*\z"""
#: The assignment of a long quoted value, tried only at the start of a run of name characters.
SHELL_VARIABLE_ANCHORED = r"""(?<![A-Z0-9_])[0-9]*+[A-Z_][A-Z0-9_]*=["']([^"'\r\n]{32,})["']"""


def joined_literals(content: Column) -> Column:
    """Groups of two or more adjacent quoted base64 literals, joined."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("group"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("gap"), none.alias("out"))

    def emit(s: Column) -> Column:
        return F.when((s["n"] > 1) & (F.octet_length(s["group"]) >= GROUP), F.concat(s["out"], F.array(s["group"]))).otherwise(s["out"])

    def step(s: Column, piece: Column) -> Column:
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        counts = piece.rlike(r"""(?s)\A(['"])[A-Za-z0-9+/=_-]{4,}\1\z""")
        joins = counts & (s["n"] > 0) & (F.octet_length(s["gap"]) <= GAP) & s["gap"].rlike(r"(?U)\A[+\s]*\z")
        return (
            F.when(joins, F.struct(F.concat(s["group"], inner).alias("group"), (s["n"] + 1).alias("n"), F.lit("").alias("gap"), s["out"].alias("out")))
            .when(counts, F.struct(inner.alias("group"), F.lit(1).alias("n"), F.lit("").alias("gap"), emit(s).alias("out")))
            .otherwise(F.struct(s["group"].alias("group"), s["n"].alias("n"), F.when(F.length(s["gap"]) > 64, s["gap"]).otherwise(F.concat(s["gap"], piece)).alias("gap"), s["out"].alias("out")))
        )

    return F.aggregate(F.regexp_extract_all(content, F.lit(PIECES), F.lit(0)), start, step, emit)


def candidates(content: Column) -> Column:
    """array<struct<kind, line_no, b64>> in the order they are tried: runs, joined literals, variables."""
    struct = lambda kind, line, b: F.struct(F.lit(kind).alias("kind"), line.cast("bigint").alias("line_no"), b.alias("b64"))
    runs = F.flatten(F.transform(X.lines(content), lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(X.java(B64_CHUNK)), F.lit(0)), lambda b: struct(0, i + 1, b))))
    joined = F.transform(joined_literals(content), lambda b: struct(1, F.lit(0), b))
    values = F.transform(F.regexp_extract_all(content, F.lit(SHELL_VARIABLE_ANCHORED), F.lit(1)), lambda v: F.regexp_replace(v, r"(?U)\s+", ""))
    values = F.transform(F.filter(values, lambda v: (F.octet_length(v) >= 32) & v.rlike(r"\A[A-Za-z0-9+/=_-]+\z")), lambda b: struct(2, F.lit(0), b))
    return F.concat(runs, joined, values)


def decoded(content: Column) -> Column:
    """array<struct<kind, line_no, text>>: the candidates that decode, as text."""
    told = F.transform(candidates(content), lambda c: F.struct(c["kind"].alias("kind"), c["line_no"].alias("line_no"), X.lenient_base64(c["b64"]).alias("text")))
    # few texts have one; a class of single characters is one look into a table, where ranges are one test each
    quoted = content.contains('"') | content.contains("'")
    some = content.rlike(f"[{WORD_64}]{{32}}") | (quoted & content.rlike(rf"""["'][{WORD_64}=]{{4}}|=["'][^"'\r\n]{{32}}"""))
    return F.filter(F.when(some, told), lambda c: c["text"].isNotNull())


def may_be_coded(path: Column) -> Column:
    return ~path.startswith("evals/") & ~path.startswith("references/")


CODED = "array<struct<kind: int, line_no: bigint, text: string>>"
VEILED = "array<struct<line_no: bigint, line: string>>"


def coded_verdict(of: Rules, path: Column, texts: Column, mets: Column) -> Column:
    """struct<d: struct<verdict, matched>, a: bigint>: of the decoded texts and what each meets, the first that is
    dangerous (verdict code, net or url), and the line of the first advisory before it; null if neither is there."""
    markdown = is_markdown(path)

    def judged(t: Column) -> Column:
        danger = F.when(t["matched"].isNotNull(), F.lit("code")).when(sends(t["text"]), F.lit("net")).when(t["text"].rlike(X.java(URL_IN_B64)), F.lit("url"))
        # the printable share is of the decoded bytes; replaced bytes are not printable either way
        plain = markdown & (t["kind"] == 0) & (X.printable_ratio(t["text"]) >= PRINTABLE)
        return F.struct(t["line_no"].alias("line_no"), t["matched"].alias("matched"), danger.alias("danger"), plain.alias("plain"))

    told = F.zip_with(texts, mets, lambda x, y: F.struct(x["kind"].alias("kind"), x["line_no"].alias("line_no"), x["text"].alias("text"), first_sensitive(of, x["text"], y, markdown).alias("matched")))

    def firsts(j: Column) -> Column:
        at = lambda flags: F.array_position(flags, F.lit(True)).cast("int")
        where = F.struct(at(F.transform(j, lambda t: t["danger"].isNotNull())).alias("d"), at(F.transform(j, lambda t: t["danger"].isNull() & t["plain"])).alias("a"))

        def verdict(p: Column) -> Column:
            d, a = F.get(j, p["d"] - 1), F.get(j, p["a"] - 1)
            danger = F.when(p["d"] > 0, F.struct(d["danger"].alias("verdict"), d["matched"].alias("matched")))
            return F.when((p["d"] > 0) | (p["a"] > 0), F.struct(danger.alias("d"), F.when((p["a"] > 0) & ((p["d"] == 0) | (p["a"] < p["d"])), a["line_no"]).alias("a")))

        return X.bound(where, verdict)

    return F.when(F.size(texts) > 0, X.bound(F.transform(told, judged), firsts))


def base64_verdicts(files: DataFrame) -> DataFrame:
    """Per file at most one danger (verdict code, net or url) and, before it, one advisory.

    package_id, path, verdict, rule_id, matched (index of the pattern), line_no."""
    if "coded" not in files.columns:
        files = facts(files, parts=["coded"])
    verdicts = F.array_compact(
        F.array(
            F.when(F.col("coded.a").isNotNull(), F.struct(F.lit(0).alias("k"), F.lit("advisory").alias("verdict"), F.lit(None).cast("int").alias("matched"), F.col("coded.a").alias("line_no"))),
            F.when(F.col("coded.d").isNotNull(), F.struct(F.lit(1).alias("k"), F.col("coded.d.verdict").alias("verdict"), F.col("coded.d.matched").alias("matched"), F.lit(None).cast("bigint").alias("line_no"))),
        )
    )
    rule = F.when(F.col("verdict") == "code", "VTD-0077").when(F.col("verdict") == "net", "VTD-0078").when(F.col("verdict") == "url", "VTD-0079").otherwise("VTD-0080")
    return files.where("coded is not null").select("package_id", "path", F.explode_outer(verdicts).alias("v")).where("v is not null").select("package_id", "path", "v.*").withColumn("rule_id", rule)


def coded_struct(c, n: Column, registry: list[Sensitive] | tuple[Sensitive, ...]) -> Column:
    """The finding of a verdict (c gives its fields and the path); n numbers the package's dangerous files."""
    lit, danger = F.lit, c("verdict") != "advisory"
    at = F.concat(lit("Decoded base64 in "), c("path"))
    labels = pick([p.label for p in registry], c("matched")) if registry else F.lit(None).cast("string")
    detail = (
        F.when(c("verdict") == "code", F.concat(at, lit(" matched: "), labels))
        .when(c("verdict") == "net", F.concat(at, lit(" contained a network transmission call")))
        .when(c("verdict") == "url", F.concat(at, lit(" contained an external URL. Possible dead-drop or remote instruction source.")))
        .otherwise(F.concat(lit("Detected in "), c("path"), lit(":"), c("line_no").cast("string"), lit(" — base64 content is rarely expected in skill documentation")))
    )
    rule = F.when(c("verdict") == "code", "VTD-0077").when(c("verdict") == "net", "VTD-0078").when(c("verdict") == "url", "VTD-0079").otherwise("VTD-0080")
    label = F.when(c("verdict") == "code", "Obfuscated dangerous code").when(c("verdict") == "net", "Obfuscated network call").when(c("verdict") == "url", "Obfuscated external URL (dead-drop)").otherwise("Base64-encoded content in markdown file")
    return struct_of(
        180, rule, "security", F.when(danger, lit("critical")).otherwise(lit("medium")), label, detail, filepath=c("path"), intent=F.when(danger, lit("malicious")), k1=c("path"), k2=danger.cast("int"), line_no=c("line_no"),
        chain_id=F.when(danger, F.concat(lit("obfusc-"), c("verdict"), lit("-"), n.cast("string"))), detected_in=F.when(~danger, c("path")),
    )


def base64(files: DataFrame, registry: list[Sensitive] = SENSITIVE) -> DataFrame:
    v = base64_verdicts(files)
    danger = F.col("verdict") != "advisory"
    v = v.withColumn("n", F.row_number().over(Window.partitionBy("package_id", danger).orderBy("path")) - 1)
    return v.select("package_id", coded_struct(F.col, F.col("n"), registry).alias("f")).select("package_id", "f.*")


def veiled_lines(content: Column) -> Column:
    """array<struct<line_no, line>>: the lines that have invisible characters, without them."""
    lines = F.transform(X.lines(content), lambda x, i: F.when(x.rlike(X.INVISIBLE), F.struct((i + 1).cast("bigint").alias("line_no"), X.strip_invisible(x).alias("line"))))
    # none of them is ASCII, and few texts are more than ASCII
    return F.filter(F.when((F.octet_length(content) > F.length(content)) & content.rlike(X.INVISIBLE), lines), lambda s: s["line_no"].isNotNull())


def veiled_verdict(of: Rules, lines: Column, mets: Column) -> Column:
    """struct<line_no, verdict, matched>: of such lines and what each meets, the first on which something
    dangerous is hidden (verdict pattern, signal or url), or else the first (plain); null without lines."""

    def judged(t: Column) -> Column:
        verdict = F.when(t["s"].isNotNull(), F.lit("pattern")).when(t["b"].isNotNull(), F.lit("signal")).when(t["line"].rlike(X.java(URL_HIDDEN)), F.lit("url")).otherwise(F.lit("plain"))
        return F.struct(t["line_no"].alias("line_no"), verdict.alias("verdict"), F.coalesce(t["s"], t["b"]).alias("matched"))

    rows = F.zip_with(lines, mets, lambda x, y: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), first_sensitive(of, x["line"], y).alias("s"), first_behavioral(of, X.normalized(x["line"]), y).alias("b")))
    first = lambda j: F.coalesce(F.get(F.filter(j, lambda t: t["verdict"] != "plain"), F.lit(0)), F.get(j, F.lit(0)))
    return F.when(F.size(lines) > 0, X.bound(F.transform(rows, judged), first))


def hidden_unicode_matches(files: DataFrame) -> DataFrame:
    """Per file with invisible characters: the first line on which they hide something dangerous, or
    else the first line that has any.  package_id, path, line_no, verdict, matched."""
    if "veiled" not in files.columns:
        files = facts(files, parts=["veiled"])
    return files.where("veiled is not null").select("package_id", "path", "veiled.*")


#: What facts() can say of a file.
PARTS = ["sensitive", "entropy", "behavioral", "coded", "veiled", "sink", "link", "script", "definition", "suite"]


def staged(path: Column, content: Column, parts: set[str]) -> dict[str, Column]:
    """What of a file is decoded or unveiled before the automaton reads it."""
    coded, veiled = F.array().cast(CODED), F.array().cast(VEILED)
    return {
        "coded": F.coalesce(F.when(may_be_coded(path), decoded(content)).cast(CODED), coded) if "coded" in parts else coded,
        "veiled": F.coalesce(veiled_lines(content).cast(VEILED), veiled) if "veiled" in parts else veiled,
    }


def staged_texts(content: Column, coded: Column, veiled: Column) -> Column:
    """All that the automaton reads of a file: its content, what was decoded, the unveiled lines."""
    return F.concat(F.array(content), F.transform(coded, lambda t: t["text"]), F.transform(veiled, lambda t: t["line"]))


def fact_columns(of: Rules, path: Column, content: Column, coded: Column, veiled: Column, mets: Column, rows: Column, parts: set[str]) -> list[Column]:
    """The facts of one file; mets: what each of its staged texts meets, rows: its normal lines."""
    m = F.get(mets, F.lit(0))
    has = lambda k: F.array_contains(m, F.lit(k).cast("int"))
    made = {
        "sensitive": lambda: sensitive_found(of, path, content, m), "entropy": lambda: entropy_found(path, content, some=has(of.ends[1])), "behavioral": lambda: behavioral_found(of, rows, m),
        "coded": lambda: coded_verdict(of, path, coded, F.slice(mets, F.lit(2), F.size(coded))), "veiled": lambda: veiled_verdict(of, veiled, F.slice(mets, F.size(coded) + 2, F.size(veiled))),
        "sink": lambda: F.when(has(of.ends[1] + 1), sends(content)).otherwise(F.lit(False)), "link": lambda: scripts.has_link(content), "script": lambda: F.when(path.startswith("scripts/"), scripts.script_facts(path, content)),
        "definition": lambda: F.when(path.isin("SKILL.md", "skill.md"), definition.definition_fact(content)), "suite": lambda: F.when(path.isin(EVAL_FILES), evals.suite_fact(content)),
    }
    return [make().alias(name) for name, make in made.items() if name in parts]


def facts(files: DataFrame, of: Rules | None = None, parts: list[str] | None = None) -> DataFrame:
    """package_id, path and, in one pass over the contents, what the checks ask of a file: the matches of the line
    rules, what base64 and invisible characters hide, whether it sends (`sink`) or links, what a
    script offers, what a definition gives rise to and a suite holds.  The checks of files take such a table
    in place of files.  Nothing is shuffled."""
    of, on = of or rules(), set(parts or PARTS)
    p, c = F.col("path"), F.col("content")
    rows = settled(files.select("package_id", "path", "content"), **{f"__{k}": v for k, v in staged(p, c, on).items()})
    coded, veiled = F.col("__coded"), F.col("__veiled")
    rows = rows.withColumn("__mets", met_all(staged_texts(c, coded, veiled), of.demands))
    lines = normal_lines(of, p, c, F.get("__mets", F.lit(0))) if "behavioral" in on else F.array().cast("array<string>")
    rows = settled(rows, __rows=lines)
    # behind a generator later filters do not have the patterns evaluated once more
    found = F.struct(*fact_columns(of, p, c, coded, veiled, F.col("__mets"), F.col("__rows"), on))
    return rows.select("package_id", "path", F.explode_outer(F.array(found)).alias("f")).select("package_id", "path", "f.*")


def veiled_struct(c, n: Column, of: Rules) -> Column:
    """The finding about invisible characters (c gives the verdict's fields and the path); n numbers the
    package's files that hide a link."""
    lit = F.lit
    at = F.concat(c("path"), lit(":"), c("line_no").cast("string"))
    by = lambda plain, pattern, signal, link: F.when(c("verdict") == "plain", plain).when(c("verdict") == "pattern", pattern).when(c("verdict") == "signal", signal).otherwise(link)
    label = lambda table: pick([p.label for p in table], c("matched")) if table else lit(None).cast("string")
    detail = by(
        F.concat(lit("Invisible formatting/control character in "), at, lit(". May conceal prompt injection content.")),
        F.concat(lit("Hidden Unicode in "), at, lit(" concealed a dangerous pattern: "), label(of.sensitive)),
        F.concat(lit("Hidden Unicode in "), at, lit(" concealed a behavioral signal: "), label(of.behavioral)),
        F.concat(lit("Hidden Unicode in "), at, lit(" concealed an external URL")),
    )
    return struct_of(
        220, by(lit("VTD-0081"), lit("VTD-0077"), lit("VTD-0077"), lit("VTD-0079")), "security", F.when(c("verdict") == "plain", lit("medium")).otherwise(lit("critical")),
        by(lit("Hidden Unicode character detected"), lit("Obfuscated dangerous code"), lit("Obfuscated dangerous code"), lit("Obfuscated external URL (dead-drop)")), detail, filepath=c("path"),
        intent=F.when(c("verdict") != "plain", lit("malicious")), k1=c("path"), line_no=c("line_no"), chain_id=F.when(c("verdict") == "url", F.concat(lit("obfusc-uni-"), n.cast("string"))),
    )


def hidden_unicode(files: DataFrame, sensitive: list[Sensitive] = SENSITIVE, behavioral: list[Behavioral] = BEHAVIORAL) -> DataFrame:
    m = hidden_unicode_matches(files)
    m = m.withColumn("n", F.row_number().over(Window.partitionBy("package_id", F.col("verdict") == "url").orderBy("path")) - 1)
    return m.select("package_id", veiled_struct(F.col, F.col("n"), rules(sensitive, behavioral)).alias("f")).select("package_id", "f.*")

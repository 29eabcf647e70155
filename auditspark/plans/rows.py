"""The whole audit of a package within its row: for streams and request tables, where a package is one envelope.

The same checks as in engine, but files, findings and chains of a package are arrays of its row, so nothing is
shuffled, kept as state or checkpointed.  An envelope's size is bounded (envelopes.MOST_BYTES), and so are its arrays;
packages without a bound go through engine.scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.literals import met_deep
from ..operators import chains, encoding, evals, patterns, scripts, structure
from ..operators.base import FINDINGS, listed, settled
from ..registry import BEHAVIORAL, EVAL_FILES, SENSITIVE, Behavioral, Sensitive
from .engine import package_findings


def _first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def about(facts: Column, paths: Column) -> Column:
    """struct: what engine.packages_about() says of a package, from its files' facts and its listed paths."""
    held = F.transform(facts, lambda f: f["path"])
    of = lambda name: _first(F.filter(facts, lambda f: f["path"] == name))
    says = lambda n: lambda p: structure.flag_tests(p)[n]
    fields = {n: F.exists(paths, says(n)) for n in structure.FLAGS}
    fields["has_skill_md"] = fields["has_skill_md"] | F.exists(held, lambda p: p.isin("SKILL.md", "skill.md"))
    fields["file_count"] = F.size(paths).cast("bigint")
    fields["definition"] = F.coalesce(*[of(n)["definition"] for n in ("SKILL.md", "skill.md")])
    suites = [F.when(of(n).isNotNull(), of(n)["suite"]) for n in EVAL_FILES]
    fields["suite"] = F.coalesce(*suites)

    def other(p: Column) -> Column:
        inside, plain, data = evals.eval_kinds(p)
        return inside & (plain | (data & F.array_contains(held, p)))

    fields["n"] = F.size(F.filter(paths, other)).cast("bigint")
    ranked = F.filter(F.transform(facts, lambda f: F.struct(scripts.link_group(f["path"]).alias("grp"), f["path"].alias("path"), f["link"].alias("link"))), lambda r: r["grp"].isNotNull())
    fields["link"] = F.when(F.size(ranked) > 0, F.struct(F.array_min(F.filter(ranked, lambda r: r["link"]))["path"].alias("path")))
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def file_findings(of: patterns.Rules, facts: Column, has_scripts: Column) -> Column:
    """The findings of all files."""
    none = F.array().cast(FINDINGS)
    sorted_paths = lambda keep: F.array_sort(F.transform(F.filter(facts, keep), lambda f: f["path"]))
    place = lambda xs, p: (F.array_position(xs, p) - 1).cast("int")

    def of_file(f: Column, numbered: Column) -> Column:
        path, coded, veiled = f["path"], f["coded"], f["veiled"]
        fields = lambda v, m, line: (lambda n: {"path": path, "verdict": v, "matched": m, "line_no": line}[n])
        nothing, nowhere = F.lit(None).cast("int"), F.lit(None).cast("bigint")
        advice = F.when(coded["a"].isNotNull(), encoding.coded_struct(fields(F.lit("advisory"), nothing, coded["a"]), nothing, of.sensitive))
        danger = F.when(coded["d"].isNotNull(), encoding.coded_struct(fields(coded["d"]["verdict"], coded["d"]["matched"], nowhere), place(numbered["coded"], path), of.sensitive))
        hidden = F.when(veiled.isNotNull(), encoding.veiled_struct(fields(veiled["verdict"], veiled["matched"], veiled["line_no"]), place(numbered["veiled"], path), of))
        offered = F.when(has_scripts & F.coalesce(f["script"]["cli"], F.lit(False)), scripts.script_found(path, f["script"])).otherwise(none)
        return F.concat(patterns.line_findings(of, path, lambda n: f[n]), listed(advice, danger, hidden), offered)

    numbers = F.struct(sorted_paths(lambda f: f["coded"]["d"].isNotNull()).alias("coded"), sorted_paths(lambda f: f["veiled"]["verdict"] == "url").alias("veiled"))
    return X.bound(numbers, lambda numbered: F.flatten(F.transform(facts, lambda f: of_file(f, numbered))))


def concluded(found: Column, sinks: Column) -> Column:
    """chains.concluded() within a row: found are the findings, the conditional ones as though they held; sinks
    the paths of files that send."""
    get = lambda f: lambda n: f[n]
    ever = lambda xs, test: F.exists(xs, lambda f: F.coalesce(test(get(f)), F.lit(False)))

    def tagged(xs: Column, links: Column, prefix: str, joins) -> Column:
        def one(f: Column) -> Column:
            at = F.coalesce(F.array_position(links, f["detail_path"]), F.lit(0))
            chain = F.concat(F.lit(prefix), (at - 1).cast("string"))
            return F.when((at > 0) & F.coalesce(joins(get(f)), F.lit(False)), f.withField("chain_id", chain).withField("intent", F.lit("malicious")).withField("severity", F.lit("critical"))).otherwise(f)

        return F.transform(xs, one).cast(FINDINGS)

    def with_exfil(xs: Column, exfil: Column) -> Column:
        def told(t: Column) -> Column:
            on = F.filter(t, lambda f: (f["category"] == "security") & f["detail_path"].isNotNull())

            def of_path(p: Column) -> Column:
                own = F.filter(on, lambda f: f["detail_path"] == p)
                buckets = F.array_sort(F.transform(F.filter(own, lambda f: f["bucket"].isNotNull()), lambda f: F.struct(f["phase"].alias("a"), f["k1"].alias("b"), f["k2"].alias("c"), f["bucket"].alias("bucket"))))
                return F.struct(p.alias("path"), F.array_distinct(F.transform(buckets, lambda b: b["bucket"])).alias("names"), ever(own, chains.is_strong).alias("strong"))

            bucketed = F.array_distinct(F.transform(F.filter(on, lambda f: f["bucket"].isNotNull()), lambda f: f["detail_path"]))
            active = F.array_sort(F.filter(F.transform(bucketed, of_path), lambda a: (F.size(a["names"]) >= 2) | a["strong"]))
            return X.bound(active, lambda a: whole(xs, exfil, t, a))

        return X.bound(tagged(xs, exfil, "cred-exfil-", chains.joins_exfiltration), told)

    def whole(xs: Column, exfil: Column, t: Column, active: Column) -> Column:
        done = tagged(t, F.transform(active, lambda a: a["path"]), "mal-activity-", chains.joins_activity)
        own = F.transform(exfil, lambda p, i: chains.exfiltration_struct(p, F.concat(F.lit("cred-exfil-"), i.cast("string")))).cast(FINDINGS)
        more = F.transform(active, lambda a, i: chains.activity_struct(a["path"], F.concat(F.lit("mal-activity-"), i.cast("string")), F.array_join(a["names"], " + "))).cast(FINDINGS)
        bad = (F.size(exfil) > 0) | (F.size(active) > 0) | ever(done, lambda f: (f("category") == "security") & (f("intent") == "malicious"))
        state = F.struct(ever(xs, chains.fails_secrets).alias("s"), ever(xs, chains.fails_behavior).alias("b"), bad.alias("bad"))
        holds = lambda f, k: F.when(f["phase"] == 190, ~k["s"]).when(f["phase"] == 210, ~k["b"]).when(f["phase"] == 270, k["bad"]).otherwise(F.lit(True))
        # the fields of a finding begin with its place in the order of emission
        return F.array_sort(F.concat(X.bound(state, lambda k: F.filter(done, lambda f: holds(f, k))), own, more))

    sources = F.array_distinct(F.transform(F.filter(found, lambda f: chains.is_source(get(f))), lambda f: f["detail_path"]))
    # paths end at their first colon, as they are read back from details
    sent = F.transform(sinks, lambda p: F.split_part(p, F.lit(":"), F.lit(1)))
    return X.bound(found, lambda xs: X.bound(F.array_sort(F.array_intersect(sources, sent)), lambda exfil: with_exfil(xs, exfil)))


def audited(parsed: DataFrame, sensitive: list[Sensitive] = SENSITIVE, behavioral: list[Behavioral] = BEHAVIORAL) -> DataFrame:
    """Of envelopes.parse_envelopes(): package_id, problem, findings (an array in order) and the flags and file
    count, null where there is a problem."""
    of, on = patterns.rules(sensitive, behavioral), set(encoding.PARTS)
    good = F.col("problem").isNull()
    entries = F.when(good, F.map_entries("e.textFiles"))
    stage = lambda e: F.struct(e["key"].alias("path"), F.coalesce(e["value"], F.lit("")).alias("content"), *[c.alias(n) for n, c in encoding.staged(e["key"], F.coalesce(e["value"], F.lit("")), on).items()])
    rows = settled(parsed, __files=F.transform(entries, stage), __paths=F.when(good, F.col("e.allPaths"))).drop("e")
    rows = rows.withColumn("__mets", met_deep(F.coalesce(F.transform("__files", lambda f: encoding.staged_texts(f["content"], f["coded"], f["veiled"])), F.array().cast("array<array<string>>")), of.demands))

    def fact(f: Column, m: Column) -> Column:
        lines = patterns.normal_lines(of, f["path"], f["content"], _first(m))
        return F.struct(f["path"].alias("path"), *encoding.fact_columns(of, f["path"], f["content"], f["coded"], f["veiled"], m, lines, on))

    rows = settled(rows.select("package_id", "problem", "__paths", F.zip_with("__files", "__mets", fact).alias("__f0")), __facts=F.col("__f0")).drop("__f0")
    rows = settled(rows, __about=F.when(good, about(F.col("__facts"), F.col("__paths"))))
    a = lambda n: F.col("__about")[n]
    found = F.concat(package_findings(a), file_findings(of, F.col("__facts"), a("has_scripts")))
    sinks = F.transform(F.filter("__facts", lambda f: f["sink"]), lambda f: f["path"])
    rows = settled(rows, __found=F.when(good, found), __sinks=sinks)
    rows = settled(rows, findings=F.when(good, concluded(F.col("__found"), F.col("__sinks"))))
    return rows.select("package_id", "problem", "findings", *[a(n).alias(n) for n in [*structure.FLAGS, "file_count"]])

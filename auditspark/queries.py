"""The engine's registered queries over the synthetic corpus, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import corpus
from .functions import text as X
from .operators import chains, definition, encoding, evals, patterns, scripts, structure
from .plans import cases, compare, engine, lineage, wire
from .registry import BEHAVIORAL, BENIGN_WORDS, CHECKLIST, CREDENTIAL_LABELS, ENV_FILE, EXAMPLE_HEADING, GENERIC_PHRASES, GOTCHAS, NEGATION, OVERCLAIM, POPULAR_NAMES, PROMPT_LEAK, READ_MD, SENSITIVE, SINKS, URL_HIDDEN, WELL_KNOWN_NAMES
from .schema import DEFAULT_SOURCE, SCANNER_SCHEMA_VERSION, SEVERITIES
from .sources import directories, envelopes
from .streaming import audit

Q = Callable[[SparkSession, str], DataFrame]


def _files(spark, sf):
    return corpus.files(spark, sf)


def _defs(spark, sf):
    f, p, k = corpus.tables(spark, sf)
    return definition.definitions(k, f, p)


def _flags(spark, sf):
    f, p, k = corpus.tables(spark, sf)
    return structure.flags(k, f, p)


def q01_structure_flags(spark, sf):
    return _flags(spark, sf)


def q02_sensitive_first_match(spark, sf):
    return patterns.sensitive_matches(_files(spark, sf)).select("package_id", "path", F.col("pat_idx").cast("bigint").alias("pat_idx"), "rule_id", "severity", "line_no", "snippet")


def q03_sensitive_by_severity(spark, sf):
    return patterns.sensitive(_files(spark, sf)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("package_id").alias("packages"))


def q04_entropy_secrets(spark, sf):
    return patterns.entropy_matches(_files(spark, sf)).select("package_id", "path", "line_no", "snippet", F.round("entropy", 6).alias("entropy"))


def q05_env_files(spark, sf):
    return patterns.env_files(_files(spark, sf)).select("package_id", "filepath", "detail")


def q06_hidden_unicode(spark, sf):
    return encoding.hidden_unicode_matches(_files(spark, sf)).select("package_id", "path", "line_no", "verdict")


def q07_external_url(spark, sf):
    return scripts.external_urls(_files(spark, sf)).select("package_id", "rule_id", "filepath", "detail")


def q08_cli_scripts(spark, sf):
    return scripts.cli_scripts(_files(spark, sf)).select("package_id", "path", "script.hint")


def q09_script_checks(spark, sf):
    return scripts.script_checks(_files(spark, sf), _flags(spark, sf)).select("package_id", "filepath", "rule_id", "severity", "label")


def q10_frontmatter(spark, sf):
    return _defs(spark, sf).select("package_id", "name", "description", "repository", F.length("body").cast("bigint").alias("body_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def q11_name_validity(spark, sf):
    return _defs(spark, sf).select("package_id", "name", definition.name_error(F.col("name")).alias("error"))


def q12_typosquat(spark, sf):
    return definition.typosquats(_defs(spark, sf)).select("package_id", "severity", "detail")


def q13_name_collision(spark, sf):
    return _defs(spark, sf).where(F.col("name").isin(WELL_KNOWN_NAMES)).select("package_id", "name")


def q14_description_checks(spark, sf):
    return definition.description_checks(_defs(spark, sf)).select("package_id", "rule_id", "severity", "label")


def q15_body_checks(spark, sf):
    b = F.col("body")
    return _defs(spark, sf).where(X.trimmed(b) != "").select(
        "package_id", F.size(X.lines(b)).cast("bigint").alias("n_lines"), definition.has_examples(b).alias("examples"), definition.has_gotchas(b).alias("gotchas"), definition.has_checklist(b).alias("checklist"),
        definition.has_validation(b).alias("validation"), definition.has_workflow(b).alias("workflow"),
    )


def q16_generic_phrases(spark, sf):
    return definition.generic_phrases(_defs(spark, sf)).select("package_id", "phrase")


def q17_evals_cases(spark, sf):
    return evals.suites(_files(spark, sf))


def q18_eval_files(spark, sf):
    f, p, _ = corpus.tables(spark, sf)
    return evals.eval_files(p, f)


def q19_behavioral_counts(spark, sf):
    return patterns.behavioral_matches(_files(spark, sf)).where("pat_idx <> 11").select("package_id", "path", F.col("pat_idx").cast("bigint").alias("pat_idx"), "rule_id", "n", "line_no", "snippet")


def q20_negated_solicitation(spark, sf):
    return patterns.behavioral_matches(_files(spark, sf)).where("pat_idx = 11").select("package_id", "path", "n", "line_no")


def q21_base64_verdict(spark, sf):
    return encoding.base64_verdicts(_files(spark, sf)).select("package_id", "path", "verdict", "rule_id", "line_no")


def q22_rollups(spark, sf):
    f, p, k = corpus.tables(spark, sf)
    found = patterns.sensitive(f).unionByName(patterns.entropy(f)).unionByName(patterns.env_files(f)).unionByName(patterns.behavioral(f))
    return chains.rollups(k, found).select("package_id", "rule_id")


def _file_facts(spark, sf, *parts):
    """Facts of all files, from one pass over the contents."""
    return lineage.materialized(encoding.facts(_files(spark, sf), parts=list(parts)))


def q23_exfil_chain(spark, sf):
    f = _file_facts(spark, sf, "sensitive", "entropy", "sink")
    return chains.exfiltration(patterns.sensitive(f).unionByName(patterns.entropy(f)), f)[1].select("package_id", "filepath", "chain_id")


def q24_activity_chain(spark, sf):
    return chains.activity(patterns.sensitive(_files(spark, sf)))[1].select("package_id", "filepath", "chain_id", "detail")


def q25_mismatch(spark, sf):
    return definition.mismatches(_defs(spark, sf), patterns.sensitive(_files(spark, sf))).select("package_id", "detail")


def q26_full_findings(spark, sf):
    return engine.scan(*corpus.tables(spark, sf)).findings


def q27_package_summary(spark, sf):
    return engine.package_summary(engine.scan(*corpus.tables(spark, sf)))


def _two_sides(spark, sf):
    """Sensitive findings, and the same without every seventh pattern and with other severities."""
    left = lineage.materialized(patterns.sensitive(_files(spark, sf)).withColumn("seq", F.struct("k1", "k2")))
    changed = left.where("k2 % 7 <> 0").withColumn("severity", F.when(F.col("k2") % 5 == 0, F.lit("info")).otherwise(F.col("severity")))
    return compare.diff(left, changed)


def q28_diff(spark, sf):
    return _two_sides(spark, sf).select("package_id", "rule_id", "label", "status", F.array_join(F.transform("fields", lambda f: f["field"]), ",").alias("fields"))


def q29_diff_summary(spark, sf):
    return compare.diff_summary(_two_sides(spark, sf))


def q30_documents_entropy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("package_id"), F.lit("d.txt").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return patterns.entropy_matches(docs).select(F.col("package_id").cast("bigint").alias("doc_id"), "line_no", "snippet", F.round("entropy", 6).alias("entropy"))


def q31_exfil_tags(spark, sf):
    f = _file_facts(spark, sf, "sensitive", "entropy", "sink")
    tagged = chains.exfiltration(patterns.sensitive(f).unionByName(patterns.entropy(f)), f)[0]
    return tagged.where("chain_id is not null").select("package_id", "rule_id", "filepath", "label", "severity", "intent", "chain_id")


def q32_activity_tags(spark, sf):
    tagged = chains.activity(patterns.sensitive(_files(spark, sf)))[0]
    return tagged.where("chain_id is not null").select("package_id", "rule_id", "filepath", "label", "severity", "intent", "chain_id")


def q33_prompt_leak(spark, sf):
    return definition.definition_checks(_defs(spark, sf)).where("rule_id = 'VTD-0085'").select("package_id", "severity", "label")


def q34_body_references(spark, sf):
    return definition.body_checks(_defs(spark, sf), _flags(spark, sf)).where("rule_id = 'VTD-0107'").select("package_id", "severity", "label")


def q35_wire_round_trip(spark, sf):
    """Findings written as responses and read back."""
    order = Window.partitionBy("package_id").orderBy("k1", "k2")
    found = patterns.sensitive(_files(spark, sf)).withColumn("seq", F.row_number().over(order).cast("bigint"))
    bodies = wire.to_wire(found, _flags(spark, sf)).withColumnRenamed("response", "body")
    return wire.from_wire(bodies).select("package_id", "seq", "rule_id", "category", "severity", "label", "filepath", "intent", "source")


def _envelopes(spark, sf):
    entries = F.map_from_entries(F.collect_list(F.struct("path", "content")))
    return _files(spark, sf).groupBy("package_id").agg(F.to_json(F.struct(entries.alias("textFiles"), F.collect_list("path").alias("allPaths"))).alias("body"))


def q36_envelopes(spark, sf):
    """Packages written as request bodies and read back: their flags."""
    f, p, k, _ = envelopes.read_envelopes(_envelopes(spark, sf))
    return structure.flags(k, f, p)


def q37_envelope_errors(spark, sf):
    """Of three packages one body is no JSON and one lacks a part."""
    third = F.substring("package_id", 2, 20).cast("bigint") % 3
    bodies = _envelopes(spark, sf).withColumn("body", F.when(third == 0, F.lit("no json")).when(third == 1, F.lit('{"textFiles": {}}')).otherwise(F.col("body")))
    return envelopes.read_envelopes(bodies)[3]


def q38_engine_info(spark, sf):
    """The health record of every package's audit: the record, and how many files it covered."""
    return _flags(spark, sf).select("package_id", "file_count").withColumns(engine.health())


def q39_source_filter(spark, sf):
    """Of findings from this engine, from another and of null source, the first are compared."""
    found = patterns.sensitive(_files(spark, sf)).withColumn("seq", F.struct("k1", "k2"))
    mixed = found.withColumn("source", F.when(F.col("k2") % 3 == 0, F.lit("other")).when(F.col("k2") % 3 == 2, F.col("source")))
    return compare.side(mixed).select("package_id", "rule_id", "label")


def q40_case_tally(spark, sf):
    """Packages that passed, failed or gave an error record, where every fifth gives one."""
    errors = _files(spark, sf).select("package_id").distinct().where(F.substring("package_id", 2, 20).cast("bigint") % 5 == 0)
    return cases.tally(compare.diff_summary(_two_sides(spark, sf)), errors)


def q41_obfuscation_chains(spark, sf):
    """Findings of base64 and hidden Unicode that are in chains of their own."""
    f = _files(spark, sf)
    found = encoding.base64(f).unionByName(encoding.hidden_unicode(f))
    return found.where("chain_id is not null").select("package_id", "rule_id", "severity", "label", "filepath", "detail", "intent", "chain_id")


def q42_directories(spark, sf):
    """Packages written as files to a shared folder, listed and read back by the tasks."""
    base = f"{lineage.shared_folder(spark)}/packages-{uuid.uuid4().hex}"
    directories.write_packages(_files(spark, sf), base)
    files, paths, _ = directories.read_packages(spark, base)
    content = F.col("content")
    return paths.join(files, ["package_id", "path"], "left").select("package_id", "path", F.length(content).cast("bigint").alias("chars"), F.md5(content.cast("binary")).alias("md5"))


def q43_diff_order(spark, sf):
    """Two audits compared, in the order of their keys."""
    return compare.ordered(_two_sides(spark, sf)).select("diff_seq", "package_id", "category", "rule_id", "label", "status")


def q44_repeated_keys(spark, sf):
    """Suites in which each text stands behind a key that is repeated, with the fewer cases first: the last counts."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    quoted = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("v")))
    text, i = F.substring(quoted, F.lit(6), F.length(quoted) - 6), F.col("doc_id")
    first, last = F.concat(F.lit('[{"input": '), text, F.lit("}]")), F.concat(F.lit('[{"expected": 1, "expected": "x"}, {"input": '), text, F.lit("}]"))
    content = F.concat(F.lit('{"cases": '), F.when(i % 3 == 0, last).otherwise(first), F.lit(', "note": {"cases": 1}, "c\\u0061ses" : '), F.when(i % 3 == 0, first).otherwise(last), F.lit("}"))
    rows = d.select(i.cast("string").alias("package_id"), F.lit("evals.json").alias("path"), content.alias("content"))
    return evals.suites(rows).select(F.col("package_id").cast("bigint").alias("doc_id"), "n_cases", "asserted")


def q45_stream_audit(spark, sf):
    """Packages as envelopes that a stream reads, audits row by row and writes; the findings of its responses."""
    base = f"{lineage.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _envelopes(spark, sf).write.json(f"{base}/in")
    audit.audit_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema("package_id string, response string, error string").json(f"{base}/out")
    return wire.from_wire(told.withColumnRenamed("response", "body"))


def q46_case_verdicts(spark, sf):
    """Every package made into one of the named cases, its documents as the case's files, and held against the
    flags that the case must have; only cases with a definition are chosen."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    number = F.floor(F.col("doc_id") / 8).cast("bigint")
    names = F.array(*[F.lit(n) for n in cases.CASES])
    parts = F.array(*[F.array(*[F.lit(p) for p in files]).cast("array<string>") for files in cases.CASES.values()])
    rows = d.select(F.concat(F.lit("p"), number.cast("string")).alias("package_id"), F.get(names, (number % 7).cast("int")).alias("case_name"), F.get(F.get(parts, (number % 7).cast("int")), (F.col("doc_id") % 8).cast("int")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    held = rows.where("path is not null").select("package_id", "path", "content")
    flags = structure.flags(rows.select("package_id").distinct(), held, held.select("package_id", "path"))
    results = flags.join(rows.select("package_id", "case_name").distinct(), "package_id")
    return cases.verdicts(results, [n for n, files in cases.CASES.items() if "SKILL.md" in files]).select("package_id", "case_name", "agrees", "file_count")


def q47_findings_documents(spark, sf):
    """The whole audit as documents of findings, in parts of 16."""
    f, p, k = corpus.tables(spark, sf)
    return wire.document_parts(engine.scan(f, p, k).findings, k, 16)


def q48_diff_reports(spark, sf):
    """Two audits compared, as reports in parts of four entries."""
    return compare.report_parts(_two_sides(spark, sf), named=True, per_part=4)


def _listing(spark, sf):
    """The pages' addresses as a table of paths: every tenth page is the definition of its host, another of its
    host's section, another lies in a hidden directory."""
    address = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""), "/+$", "")
    host, section, last = F.substring_index(address, "/", 1), F.substring_index(address, "/", 2), F.col("page_id") % 10
    path = F.when(last == 0, F.concat(host, F.lit("/SKILL.md"))).when(last == 3, F.concat(section, F.lit("/skill.md"))).when(last == 7, F.concat(section, F.lit("/.old/SKILL.md"))).otherwise(F.concat(address, F.lit("/index.html")))
    return spark.read.parquet(f"{sf}/pages.parquet").select(path.alias("path"))


def q49_package_roots(spark, sf):
    """Packages of a listing, in order, with the number of their files."""
    paths = _listing(spark, sf)
    inner = directories.package_listing(paths).groupBy("package_id").agg(F.count(F.lit(1)).alias("n_files"))
    return directories.package_roots(paths).withColumnRenamed("root", "package_id").join(inner, "package_id")


def q50_package_listing(spark, sf):
    """Every file of every package of a listing, nested packages included."""
    return directories.package_listing(_listing(spark, sf))


QUERIES: dict[str, Q] = {k: v for k, v in sorted(globals().items()) if k[:1] == "q" and k[1:3].isdigit()}

# ---- the same rows in SQL -------------------------------------------------------------------------

_L = corpus.literal
_SNIP = "substr(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 120)"
_MD = "ends_with(lower(path), '.md')"


def _any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_L(w)})" for w in words) + ")"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_L, words)) + "]"


def _sensitive_hits() -> str:
    parts = []
    for i, p in enumerate(SENSITIVE):
        severity = f"CASE WHEN {_MD} THEN {_L(p.doc_severity or p.severity)} ELSE {_L(p.severity)} END"
        gate = f" AND NOT {_MD}" if p.code_only else ""
        parts.append(f"SELECT package_id, path, {i} AS pat_idx, {_L(p.rule)} AS rule_id, {_L(p.label)} AS label, {_L(p.intent)} AS intent, {_L(p.bucket) if p.bucket else 'NULL'} AS bucket, {p.source} AS source, {severity} AS severity, min(line_no) AS line_no, min_by({_SNIP}, line_no) AS snippet FROM lines WHERE regexp_matches(line, {_L(p.regex)}){gate} GROUP BY ALL")
    return "sens AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


def _with(*more: str) -> str:
    return ",\n".join([corpus.sql(), *more])


_ENTROPY = r"""pairs AS (SELECT package_id, path, line_no, line, unnest(regexp_extract_all(line, {a}, 1)) AS k, unnest(regexp_extract_all(line, {a}, 2)) AS v FROM {t} WHERE NOT ends_with(lower(path), '.md')),
  keyed AS (SELECT row_number() OVER () AS id, * FROM pairs WHERE regexp_matches(k, {s})),
  hist AS (SELECT id, b, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(hex(v), '..')) AS b FROM keyed) GROUP BY 1, 2),
  ent AS (SELECT id, -sum(p * log2(p)) AS h FROM (SELECT id, n / sum(n) OVER (PARTITION BY id) AS p FROM hist) GROUP BY 1)"""


def _entropy(table: str) -> str:
    from .registry import ASSIGNMENT, SECRET_KEY

    return _ENTROPY.format(a=_L(ASSIGNMENT), s=_L(SECRET_KEY), t=table)


_DEFS = f"""defs AS MATERIALIZED (SELECT package_id, content, split_part(h, chr(10), 1)[7:] AS name, split_part(h, chr(10), 2)[14:] AS description,
   CASE WHEN contains(h, 'repository: ') THEN 'https://r.example/x' ELSE '' END AS repository, ltrim(substr(content, length(h) + 10), chr(10)) AS body
 FROM (SELECT package_id, content, substr(content, 5, instr(substr(content, 5), chr(10) || '---') - 1) AS h FROM files WHERE path = 'SKILL.md'))"""


#: Candidates of base64 in order: runs of a line, adjacent quoted literals, shell variables.  Decoded
#: text keeps its ASCII; bytes that are no UTF-8 are marks of three bytes.
_CODED = r"""scanned AS (SELECT package_id, path, content FROM files WHERE NOT starts_with(path, 'evals/') AND NOT starts_with(path, 'references/')),
  runs AS (SELECT package_id, path, line_no, generate_subscripts(l, 1) AS i, unnest(l) AS b FROM (SELECT package_id, path, line_no, regexp_extract_all(line, {chunk}) AS l FROM lines SEMI JOIN scanned USING (package_id, path))),
  pieces AS (SELECT package_id, path, generate_subscripts(l, 1) AS i, unnest(l) AS p FROM (SELECT package_id, path, regexp_extract_all(content, {pieces}) AS l FROM scanned)),
  told AS (SELECT *, regexp_full_match(p, {quoted}) AS q FROM pieces),
  told2 AS (SELECT *, sum(CAST(q AS INTEGER)) OVER (PARTITION BY package_id, path ORDER BY i) AS c FROM told),
  literals AS (SELECT package_id, path, c, any_value(p[2:-2]) FILTER (WHERE q) AS inner_, coalesce(string_agg(p, '' ORDER BY i) FILTER (WHERE NOT q), '') AS behind FROM told2 WHERE c > 0 GROUP BY ALL),
  apart AS (SELECT *, lag(behind) OVER w AS gap FROM literals WINDOW w AS (PARTITION BY package_id, path ORDER BY c)),
  dealt AS (SELECT *, sum(CASE WHEN strlen(gap) <= 10 AND regexp_full_match(gap, '[+\s]*') THEN 0 ELSE 1 END) OVER (PARTITION BY package_id, path ORDER BY c) AS g FROM apart),
  joined AS (SELECT package_id, path, g, string_agg(inner_, '' ORDER BY c) AS b FROM dealt GROUP BY ALL HAVING count(*) > 1),
  variables AS (SELECT package_id, path, generate_subscripts(l, 1) AS i, regexp_replace(unnest(l), '\s+', '', 'g') AS b FROM (SELECT package_id, path, regexp_extract_all(content, {variable}, 1) AS l FROM scanned)),
  tried AS (SELECT package_id, path, 0 AS kind, line_no, i, b FROM runs UNION ALL SELECT package_id, path, 1, 0, g, b FROM joined WHERE strlen(b) >= 40
    UNION ALL SELECT package_id, path, 2, 0, i, b FROM variables WHERE strlen(b) >= 32 AND regexp_full_match(b, '[A-Za-z0-9+/=_-]+')),
  ways AS (SELECT *, b || (['', '', '==', '='])[strlen(b) % 4 + 1] AS padded FROM tried),
  bytes AS (SELECT * EXCLUDE (b, padded), coalesce({b}, {padded}, {url}) AS v FROM ways),
  decoded AS (SELECT package_id, path, kind, line_no, i, coalesce(TRY(decode(v)), array_to_string(list_transform(regexp_extract_all(hex(v), '..'), lambda x: CASE WHEN x < '80' THEN chr(CAST('0x' || x AS INTEGER)) ELSE chr(65533) END), '')) AS t FROM bytes WHERE v IS NOT NULL),
  matched AS (SELECT *, {first} AS m FROM decoded),
  judged AS (SELECT *, (kind, line_no, i) AS ord, CASE WHEN m IS NOT NULL THEN 'code' WHEN {sink} THEN 'net' WHEN regexp_matches(t, {link}) THEN 'url' END AS danger FROM matched),
  marked AS (SELECT *, ends_with(lower(path), '.md') AND kind = 0 AND danger IS NULL AND t <> '' AND length(regexp_replace(t, '[^\x20-\x7E\t\n\r]', '', 'g')) / strlen(t) >= 0.75 AS plain FROM judged),
  firsts AS (SELECT package_id, path, min(ord) FILTER (WHERE danger IS NOT NULL) AS d, min(ord) FILTER (WHERE plain) AS a FROM marked GROUP BY ALL),
  verdicts AS (SELECT package_id, path, 'advisory' AS verdict, CAST(NULL AS INTEGER) AS m, line_no FROM marked JOIN firsts USING (package_id, path) WHERE plain AND ord = a AND (d IS NULL OR a < d)
    UNION ALL SELECT package_id, path, danger, m, CAST(NULL AS BIGINT) FROM marked JOIN firsts USING (package_id, path) WHERE danger IS NOT NULL AND ord = d)"""


def _coded() -> str:
    from .registry import B64_CHUNK, SHELL_VARIABLE, URL_IN_B64

    way = lambda x: f"CASE WHEN strlen({x}) % 4 = 0 AND regexp_full_match({x}, '[A-Za-z0-9+/]*={{0,2}}') AND to_base64(TRY(from_base64({x}))) = {x} THEN TRY(from_base64({x})) END"
    tries = " ".join(f"WHEN regexp_matches(t, {_L(p.regex)}){' AND NOT ' + _MD if p.code_only else ''} THEN {i}" for i, p in enumerate(SENSITIVE))
    quoted = _L("""'[A-Za-z0-9+/=_-]{4,}'|"[A-Za-z0-9+/=_-]{4,}\"""")
    pieces = _L("""[^'"]+|'[^']*'|"[^"]*"|'[^']*\\z|"[^"]*\\z""")
    sink = "(" + " OR ".join(f"regexp_matches(t, {_L(p)})" for p in SINKS) + ")"
    return _CODED.format(
        chunk=_L(B64_CHUNK), pieces=pieces, quoted=quoted, variable=_L(SHELL_VARIABLE), first=f"CASE {tries} END", sink=sink, link=_L(URL_IN_B64), b=way("b"), padded=way("padded"), url=way("translate(padded, '-_', '+/')"),
    )


def _full(o: dict[str, str], masked: str, asked: str, sink: str) -> str:
    """The whole audit as the common table expression `found`, from the SQL of its checks (o)."""
    invisible = "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FEFF}\\x{E0000}-\\x{E007F}]"
    low_line = "regexp_replace(regexp_replace(lower(line), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
    first = lambda rules, x: "CASE " + " ".join(f"WHEN regexp_matches({x}, {_L(r.regex)}) THEN {i}" for i, r in enumerate(rules)) + " END"
    rest = lambda name: o[name].replace("WITH RECURSIVE files", "WITH files", 1)[len(_with()):]
    checks = ["q01_structure_flags", "q04_entropy_secrets", "q05_env_files", "q07_external_url", "q09_script_checks", "q11_name_validity", "q12_typosquat", "q13_name_collision", "q14_description_checks", "q15_body_checks", "q16_generic_phrases", "q17_evals_cases", "q18_eval_files", "q19_behavioral_counts", "q33_prompt_leak", "q34_body_references"]
    made = [f"{n[:3]} AS MATERIALIZED (WITH RECURSIVE z AS (SELECT 1){rest(n)})" for n in checks]
    labels = lambda rules: f"({_list([r.label for r in rules])})"
    says = lambda column, texts: f"CASE {column} " + " ".join(f"WHEN {_L(k)} THEN {v}" for k, v in texts.items()) + " END"

    def part(table, phase, rule, category, severity, label, detail, filepath="NULL", intent="NULL", k1="''", k2="0", chain="NULL", seen="NULL", bucket="NULL"):
        return f"SELECT package_id, {phase} AS phase, {k1} AS k1, {k2} AS k2, {rule} AS rule_id, {category} AS category, {severity} AS severity, {label} AS label, {detail} AS detail, {filepath} AS filepath, {intent} AS intent, {chain} AS chain_id, {seen} AS seen, {bucket} AS bucket FROM {table}"

    at = "'Detected in ' || path || ':' || line_no"
    quote = "' — `' || snippet || '`'"
    parts = []
    for phase, flag, rule, category, yes, no in structure.LAYOUT:
        parts += [part(f"q01 WHERE {w}{flag}", phase, _L(rule), _L(category), *map(_L, t)) for w, t in (("", yes), ("NOT ", no)) if t]
    said = {"CLI help supported": "Script documents its interface via --help or argument parsing", "No --help support": "Add argument parsing with --help output so agents know the script's interface", "Interactive prompts detected": "Agents run in non-interactive shells — replace prompts with CLI flags or stdin",
        "Structured output format": "Uses JSON/CSV output which is easily parseable by agents", "Unpinned dependency versions": "Pin dependency versions for reproducibility (e.g., >=4.12,<5 instead of >=4.12)"}
    described = {"Missing description field": "The description field is required and should describe what the skill does and when to use it", "Description includes usage context": "Good: description explains when to activate the skill",
        "Description lacks usage context": 'Add context like "Use this skill when..." to help agents know when to activate it', "Description too brief": "A few sentences covering scope and trigger conditions improves activation accuracy",
        "Description overclaims scope": "Broad trigger words (anything, everything, all files, etc.) widen attack surface — narrow to specific use cases"}
    info, best, security = "'info'", "'best-practices'", "'security'"
    two = lambda when, yes, no: f"CASE WHEN {when} THEN {_L(yes)} ELSE {_L(no)} END"
    parts += [
        part("q12", 60, "'VTD-0082'", security, "severity", "'Possible typosquatting'", "detail", intent="'negligent'"),
        part("q11", 70, "'VTD-0099'", "'structure'", two("error IS NULL", "info", "critical"), two("error IS NULL", "Valid name field", "Invalid name field"), "coalesce(error, 'Name \"' || name || '\" follows spec (lowercase, hyphens, ≤64 chars)')"),
        part("q13", 80, "'VTD-0100'", best, "'medium'", "'Skill name collides with well-known skill'", "'\"' || name || '\" matches a well-known skill name — may cause unintended invocation'"),
        part("defs WHERE repository = ''", 90, "'VTD-0083'", security, info, "'No repository link'", "'No repository field found in SKILL.md frontmatter. Skills without a verifiable source repository cannot be externally audited.'", intent="'negligent'"),
        part("q33", 110, "'VTD-0085'", security, "severity", "label", "'Skill instructs agent to output or reveal system prompt/instructions'"),
        part("q14 JOIN defs USING (package_id)", 120, "rule_id", "'description'", "severity", "label", f"CASE rule_id WHEN 'VTD-0110' THEN CASE WHEN length(description) > 1024 THEN 'Description is ' || length(description) || ' characters (max: 1024)' ELSE length(description) || '/1024 characters used' END ELSE {says('label', {k: _L(v) for k, v in described.items()})} END",
            k2="['VTD-0109', 'VTD-0110', 'VTD-0111', 'VTD-0112', 'VTD-0113'].list_position(rule_id)"),
        part("q15", 130, "'VTD-0101'", best, info, two("n_lines > 500", "SKILL.md exceeds 500 lines", "SKILL.md body length is reasonable"), "n_lines || " + two("n_lines > 500", " lines — consider moving detailed reference material to references/", " lines (recommended: under 500)")),
        part("q15 WHERE gotchas", 130, "'VTD-0102'", best, info, "'Gotchas section found'", "'Documents environment-specific facts and common pitfalls'", k2="1"),
        part("q15", 130, "'VTD-0103'", best, info, two("examples", "Examples included", "No examples found"), two("examples", "Found code blocks, input/output samples, or an examples section — concrete samples help agents pattern-match effectively", "Add code blocks, input/output samples, or before/after examples to improve agent accuracy"), k2="2"),
        part("q15 WHERE checklist", 130, "'VTD-0104'", best, info, "'Checklist pattern found'", "'Explicit checklists help agents track progress in multi-step workflows'", k2="3"),
        part("q15", 130, "'VTD-0106'", best, info, two("workflow", "Step-by-step workflow found", "No clear workflow structure"), two("workflow", "Structured procedures improve reliability for complex tasks", "Consider adding numbered steps or a structured procedure for the agent to follow"), k2="4"),
        part("q15 WHERE validation", 130, "'VTD-0105'", best, info, "'Validation loop referenced'", "'Instructions for the agent to validate its own work before proceeding'", k2="5"),
        part("q34", 130, "'VTD-0107'", best, "severity", "label", "'SKILL.md body references files in references/, scripts/, or assets/ — agents can load additional context on demand instead of consuming everything upfront'", k2="6"),
        part("q16", 130, "'VTD-0108'", best, info, "'Generic instruction detected'", "'\"' || phrase || '\" is too vague — provide specific, actionable guidance instead'", k2=f"6 + list_position({_list(GENERIC_PHRASES)}, phrase)"),
        part("q09", 140, "rule_id", "'scripts'", "severity", "label", "filepath || ': ' || " + says("label", {k: _L(v) for k, v in said.items()}), "filepath", k1="filepath", k2="CAST(right(rule_id, 3) AS INTEGER)"),
        part("sens", 150, "rule_id", security, "severity", "label", f"{at} || {quote}", "path", "intent", "path", "pat_idx", seen="path", bucket="bucket"),
        part("q04", 160, "'VTD-0003'", security, "'critical'", "'High-entropy value — potential hardcoded secret'", f"{at} || {quote}", "path", k1="path", k2="line_no", seen="path"),
        part("q05", 170, "'VTD-0004'", security, "'critical'", "'Environment file included in skill package'", "detail", "filepath", k1="filepath"),
        part("q41", 180, "rule_id", security, "severity", "label", "detail", "filepath", "intent", "filepath", "1", "chain_id"),
        part("verdicts WHERE verdict = 'advisory'", 180, "'VTD-0080'", security, "'medium'", "'Base64-encoded content in markdown file'", f"{at} || ' — base64 content is rarely expected in skill documentation'", "path", k1="path", seen="path"),
        part("heard", 200, "rule_id", security, f"({_list([r.severity for r in BEHAVIORAL])})[pat_idx + 1]", f"{labels(BEHAVIORAL)}[pat_idx + 1]", f"{at} || CASE WHEN n > 1 THEN ' (' || n || ' matches)' ELSE '' END || {quote}", "path", k1="path", k2="pat_idx", seen="path"),
        part("veiled", 220, "CASE verdict WHEN 'plain' THEN 'VTD-0081' WHEN 'url' THEN 'VTD-0079' ELSE 'VTD-0077' END", security, two("verdict = 'plain'", "medium", "critical"), "CASE verdict WHEN 'plain' THEN 'Hidden Unicode character detected' WHEN 'url' THEN 'Obfuscated external URL (dead-drop)' ELSE 'Obfuscated dangerous code' END",
            f"CASE verdict WHEN 'plain' THEN 'Invisible formatting/control character in ' || path || ':' || line_no || '. May conceal prompt injection content.' ELSE 'Hidden Unicode in ' || path || ':' || line_no || ' concealed ' || CASE verdict WHEN 'url' THEN 'an external URL' WHEN 'pattern' THEN 'a dangerous pattern: ' || {labels(SENSITIVE)}[m + 1] ELSE 'a behavioral signal: ' || {labels(BEHAVIORAL)}[m + 1] END END",
            "path", "CASE WHEN verdict <> 'plain' THEN 'malicious' END", "path", chain="CASE WHEN verdict = 'url' THEN 'obfusc-uni-' || (row_number() OVER (PARTITION BY package_id, verdict = 'url' ORDER BY path) - 1) END"),
        part("q07", 230, "rule_id", security, two("filepath IS NULL", "info", "medium"), two("filepath IS NULL", "No external URLs in skill definition", "References external URL — review for indirect prompt injection risk"), "detail", "filepath"),
        part("q17 WHERE n_cases > 0", 240, "'VTD-0119'", "'evals'", info, "'Test cases defined'", "n_cases || ' test case(s) found in evals JSON'"),
        part("q17 WHERE n_cases > 0", 240, "'VTD-0120'", "'evals'", info, two("asserted", "Assertions defined for test cases", "No assertions in test cases"), two("asserted", "Verifiable assertions or expected outputs enable automated grading of skill outputs", "Add verifiable assertions, expected outputs, or criteria to each test case"), k2="1"),
        part("q17 WHERE n_cases BETWEEN 1 AND 2", 240, "'VTD-0121'", "'evals'", info, "'Few test cases'", "'Consider adding at least 3 test cases covering varied prompts and edge cases'", k2="2"),
        part("q18 ANTI JOIN q17 USING (package_id)", 240, "'VTD-0123'", "'evals'", info, "'Eval files found'", "n || ' evaluation file(s) detected in non-JSON format (markdown, YAML, JSONL, etc.)'"),
    ]
    coded_chains = o["q41_obfuscation_chains"].split("),\nc AS (", 1)[1].split("\nUNION ALL", 1)[0]
    clean = lambda phase, rule, label, detail, failed: part(f"q01 WHERE package_id NOT IN (SELECT package_id FROM before WHERE {failed})", phase, _L(rule), security, info, _L(label), _L(detail))
    serious = "severity IN ('critical', 'high')"
    return ",\n".join([
        _with(_sensitive_hits(), _DEFS, *made, _coded(), masked, asked).replace("WITH files", "WITH RECURSIVE files", 1),
        "q41 AS (WITH c AS (" + coded_chains + ")",
        f"heard AS (SELECT package_id, path, pat_idx, rule_id, n, line_no, snippet FROM q19 UNION ALL SELECT package_id, path, 11, {_L(BEHAVIORAL[11].rule)}, CAST(sum(c) AS BIGINT), min(line_no), min_by(substr(line, 1, 120), line_no) FROM asked JOIN norm USING (package_id, path, line_no) WHERE c > 0 GROUP BY package_id, path)",
        f"bare AS (SELECT package_id, path, line_no, regexp_replace(line, '{invisible}', '', 'g') AS line FROM lines WHERE regexp_matches(line, '{invisible}'))",
        f"seen_in AS (SELECT package_id, path, line_no, {first(SENSITIVE, 'line')} AS s, {first(BEHAVIORAL, low_line)} AS b, regexp_matches(line, {_L(URL_HIDDEN)}) AS u FROM bare)",
        "veiled AS (SELECT package_id, path, coalesce(min(line_no) FILTER (WHERE w <> 'plain'), min(line_no)) AS line_no, coalesce(min_by(w, line_no) FILTER (WHERE w <> 'plain'), 'plain') AS verdict, min_by(coalesce(s, b), line_no) FILTER (WHERE w IN ('pattern', 'signal')) AS m FROM (SELECT *, CASE WHEN s IS NOT NULL THEN 'pattern' WHEN b IS NOT NULL THEN 'signal' WHEN u THEN 'url' ELSE 'plain' END AS w FROM seen_in) GROUP BY 1, 2)",
        "before AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")",
        "rolled AS (FROM before\nUNION ALL " + clean(190, "VTD-0091", "No secrets or unsafe code patterns detected", "Scanned all files for credentials, private keys, and code-level risks (eval, shell exec, destructive ops)", f"(category = 'security' AND phase < 180 AND {serious}) OR (phase = 180 AND rule_id = 'VTD-0077')")
        + "\nUNION ALL " + clean(210, "VTD-0092", "No prompt injection or jailbreak signals detected", "Scanned text content for instruction override, jailbreak framing, credential solicitation, and embedded injection markers", f"phase = 200 AND {serious}") + ")",
        f"sourced AS MATERIALIZED (SELECT *, seen IS NOT NULL AND category = 'security' AND severity <> 'info' AND {_any('label', CREDENTIAL_LABELS)} AS src, seen IS NOT NULL AND chain_id IS NULL AND {_any('lower(label)', chains.NETWORK_WORDS)} AS net FROM rolled)",
        f"exfil AS MATERIALIZED (SELECT package_id, path AS seen, 'cred-exfil-' || (row_number() OVER (PARTITION BY package_id ORDER BY path) - 1) AS x FROM files JOIN (SELECT DISTINCT package_id, seen AS path FROM sourced WHERE src) USING (package_id, path) WHERE {sink})",
        "chained AS MATERIALIZED (SELECT s.* EXCLUDE (src, net) REPLACE (CASE WHEN hit THEN 'critical' ELSE severity END AS severity, CASE WHEN hit THEN 'malicious' ELSE intent END AS intent, CASE WHEN hit THEN x ELSE chain_id END AS chain_id) FROM (SELECT sourced.*, x, x IS NOT NULL AND (src OR net) AS hit FROM sourced LEFT JOIN exfil USING (package_id, seen)) s)",
        "chained2 AS MATERIALIZED (SELECT * EXCLUDE (x, hit) FROM chained UNION ALL " + part("exfil", 250, "'VTD-0089'", security, "'critical'", "'Credential access followed by network transmission'", "seen || ' reads a credential source and transmits data over the network. Common exfiltration pattern.'", "seen", "'malicious'", "seen", chain="x") + ")",
        f"active AS MATERIALIZED (SELECT package_id, seen, 'mal-activity-' || (row_number() OVER (PARTITION BY package_id ORDER BY seen) - 1) AS x, list_reduce(list_prepend('', l), lambda a, b: CASE WHEN contains(a, b) THEN a WHEN a = '' THEN b ELSE a || ' + ' || b END) AS names FROM (SELECT package_id, seen, count(DISTINCT bucket) AS k, list(bucket ORDER BY phase, k1, k2) FILTER (WHERE bucket IS NOT NULL) AS l, coalesce(bool_or({serious} AND intent = 'malicious' AND chain_id IS NULL AND bucket IS NULL), false) AS strong FROM chained2 WHERE category = 'security' AND seen IS NOT NULL GROUP BY 1, 2) WHERE k >= 2 OR (k >= 1 AND strong))",
        "tagged AS MATERIALIZED (SELECT c.* EXCLUDE (x, hit) REPLACE (CASE WHEN hit THEN 'critical' ELSE severity END AS severity, CASE WHEN hit THEN 'malicious' ELSE intent END AS intent, CASE WHEN hit THEN x ELSE chain_id END AS chain_id) FROM (SELECT chained2.*, x, x IS NOT NULL AND category = 'security' AND bucket IS NOT NULL AND chain_id IS NULL AS hit FROM chained2 LEFT JOIN active USING (package_id, seen)) c UNION ALL "
        + part("active", 260, "'VTD-0090'", security, "'critical'", "'Multiple malicious-activity indicators in same file'", "seen || ' contains ' || names || ' indicators that co-occur in a malicious pattern.'", "seen", "'malicious'", "seen", chain="x") + ")",
        f"kind_words AS (SELECT package_id, list_filter({_list(BENIGN_WORDS)}, lambda x: contains(lower(description), x)) AS l FROM defs)",
        "found AS MATERIALIZED (FROM tagged UNION ALL " + part("kind_words WHERE len(l) > 0 AND package_id IN (SELECT package_id FROM tagged WHERE category = 'security' AND intent = 'malicious')", 270, "'VTD-0087'", security, "'medium'", "'Description suggests benign skill but code contains malicious security patterns'", "'Description uses benign-sounding terms (' || array_to_string(l[1:3], ', ') || ') but the package contains malicious security findings. Review carefully.'") + ")",
    ])


def _oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    o["q01_structure_flags"] = _with() + """
SELECT package_id, bool_or(path IN ('SKILL.md', 'skill.md')) AS has_skill_md, bool_or(starts_with(path, 'scripts/')) AS has_scripts, bool_or(starts_with(path, 'references/')) AS has_references,
  bool_or(starts_with(path, 'evals/') OR starts_with(path, 'tests/') OR starts_with(path, 'test/') OR path IN ('evals.json', 'evals.yaml', 'evals.yml')) AS has_evals,
  bool_or(starts_with(path, 'assets/')) AS has_assets, count(*) AS file_count FROM files GROUP BY 1"""
    sens = _with(_sensitive_hits())
    o["q02_sensitive_first_match"] = sens + "\nSELECT package_id, path, CAST(pat_idx AS BIGINT) AS pat_idx, rule_id, severity, line_no, snippet FROM sens"
    o["q03_sensitive_by_severity"] = sens + "\nSELECT rule_id, severity, count(*) AS n, count(DISTINCT package_id) AS packages FROM sens GROUP BY ALL"
    o["q04_entropy_secrets"] = _with(_entropy("lines")) + f"\nSELECT package_id, path, line_no, {_SNIP} AS snippet, round(min_by(h, id), 6) AS entropy FROM keyed JOIN ent USING (id) WHERE round(h, 12) >= 3.5 GROUP BY package_id, path, line_no, line"
    o["q05_env_files"] = _with() + f"\nSELECT package_id, path AS filepath, 'Found ' || path || ' — should be excluded from distribution' AS detail FROM files WHERE regexp_matches(path, {_L(ENV_FILE)})"
    o["q07_external_url"] = _with() + """, t AS (SELECT package_id, CASE WHEN path = 'SKILL.md' THEN 0 WHEN path = 'skill.md' THEN 1 ELSE 2 END AS g, path, contains(content, 'http://') OR contains(content, 'https://') AS link
  FROM files WHERE path IN ('SKILL.md', 'skill.md') OR starts_with(lower(path), 'references/')),
 f AS (SELECT package_id, min_by(path, (g, path)) FILTER (WHERE link) AS filepath FROM t GROUP BY 1)
SELECT package_id, CASE WHEN filepath IS NULL THEN 'VTD-0093' ELSE 'VTD-0088' END AS rule_id, filepath,
  CASE WHEN filepath IS NULL THEN 'SKILL.md and references/ files do not reference external URLs' ELSE 'External URL(s) detected in ' || filepath || ' — referenced content can change after audit' END AS detail FROM f"""
    hint = f"({_any('lower(content)', scripts.HINTS)} OR {_any('content', scripts.EXACT_HINTS)})"
    cli = f"starts_with(path, 'scripts/') AND CASE WHEN contains(lower(path), '/lib/') THEN {hint} ELSE true END"
    o["q08_cli_scripts"] = _with() + f"\nSELECT package_id, path, {hint} AS hint FROM files WHERE {cli}"
    o["q09_script_checks"] = _with(f"cli AS (SELECT *, {hint} AS hint FROM files WHERE {cli})") + """
SELECT package_id, path AS filepath, 'VTD-0114' AS rule_id, 'info' AS severity, CASE WHEN hint THEN 'CLI help supported' ELSE 'No --help support' END AS label FROM cli
UNION ALL SELECT package_id, path, 'VTD-0115', 'high', 'Interactive prompts detected' FROM cli WHERE regexp_matches(content, '(?i)input\\s*\\(|readline|prompt\\s*\\(|inquirer')
UNION ALL SELECT package_id, path, 'VTD-0116', 'info', 'Structured output format' FROM cli WHERE regexp_matches(content, '(?i)json\\.dumps|JSON\\.stringify|\\.to_json|\\.to_csv|csv\\.writer')
UNION ALL SELECT package_id, path, 'VTD-0117', 'low', 'Unpinned dependency versions' FROM cli WHERE regexp_matches(content, '(?i)dependencies\\s*=\\s*\\[|require\\(|import\\s') AND contains(content, '>=') AND NOT contains(content, '<')"""
    defs = _with(_DEFS)
    o["q10_frontmatter"] = defs + "\nSELECT package_id, name, description, repository, length(body) AS body_chars, md5(body) AS body_md5 FROM defs"
    o["q11_name_validity"] = defs + """
SELECT package_id, name, CASE WHEN name = '' THEN 'name field is missing' WHEN strlen(name) > 64 THEN 'name exceeds 64-character limit'
  WHEN NOT regexp_matches(name[1], '^[A-Za-z0-9]$') OR NOT regexp_matches(name[-1], '^[A-Za-z0-9]$') THEN
    CASE WHEN name[1] = '-' OR (regexp_matches(name[1], '^[A-Za-z0-9]$') AND name[-1] = '-') THEN 'name must not start or end with a hyphen' ELSE 'name contains invalid characters (only alphanumeric and hyphens allowed)' END
  WHEN NOT regexp_matches(name, '^[A-Za-z0-9-]*$') THEN 'name contains invalid characters (only alphanumeric and hyphens allowed)'
  WHEN contains(name, '--') THEN 'name must not contain consecutive hyphens' END AS error FROM defs"""
    near = f"near AS (SELECT package_id, name, list_filter({_list(POPULAR_NAMES)}, lambda p: p <> name AND levenshtein(p, name) <= 2) AS l FROM defs WHERE name NOT IN ('', 'unknown'))"
    o["q12_typosquat"] = _with(_DEFS, near) + """
SELECT package_id, CASE WHEN len(l) = 1 THEN 'medium' ELSE 'critical' END AS severity,
  'Skill name "' || name || '" is within Levenshtein distance 2 of popular skill "' || l[1] || '"' AS detail FROM near WHERE len(l) > 0"""
    o["q13_name_collision"] = defs + f"\nSELECT package_id, name FROM defs WHERE list_contains({_list(WELL_KNOWN_NAMES)}, name)"
    usage = f"({_any('lower(description)', ['use this ', 'use when', 'use for'])} OR (contains(lower(description), 'when ') AND {_any('substr(lower(description), instr(lower(description), chr(119) || chr(104) || chr(101) || chr(110) || chr(32)))', ['need', 'want', 'ask', 'mention'])}))"
    o["q14_description_checks"] = defs + f"""
SELECT package_id, 'VTD-0109' AS rule_id, 'info' AS severity, 'Missing description field' AS label FROM defs WHERE description = ''
UNION ALL SELECT package_id, 'VTD-0110', 'info', CASE WHEN length(description) > 1024 THEN 'Description exceeds 1024-character limit' ELSE 'Description within character limit' END FROM defs WHERE description <> ''
UNION ALL SELECT package_id, 'VTD-0111', 'info', CASE WHEN {usage} THEN 'Description includes usage context' ELSE 'Description lacks usage context' END FROM defs WHERE description <> ''
UNION ALL SELECT package_id, 'VTD-0112', 'info', 'Description too brief' FROM defs WHERE description <> '' AND len(regexp_extract_all(description, '\\S+')) < 5
UNION ALL SELECT package_id, 'VTD-0113', 'low', 'Description overclaims scope' FROM defs WHERE description <> '' AND regexp_matches(description, {_L(OVERCLAIM)})"""
    low = "lower(body)"
    o["q15_body_checks"] = defs + f"""
SELECT package_id, len(string_split(body, chr(10))) AS n_lines, contains(body, '```') OR {_any(low, definition.EXAMPLES)} AS examples, regexp_matches(body, {_L(GOTCHAS)}) AS gotchas,
  contains(body, '- [ ]') OR regexp_matches(body, {_L(CHECKLIST)}) AS checklist, contains({low}, 'validat') OR regexp_matches({low}, '(?m)^#+[ \\t]*verification') AS validation,
  {_any(low, ['# ' + w for w in definition.WORKFLOW_HEADINGS])} OR (instr({low}, 'step') > 0 AND regexp_matches(substr({low}, instr({low}, 'step') + 4), '^ *[0-9]')) OR regexp_matches(body, '(?m)^[0-9]+\\. ')
    OR regexp_matches({low}, '(?m)^[ \\t]*[-*] .*\\*\\*step') AS workflow
FROM defs WHERE regexp_replace(body, '^\\s+|\\s+$', '', 'g') <> ''"""
    o["q16_generic_phrases"] = defs + f"\nSELECT package_id, phrase FROM defs, (SELECT unnest({_list(GENERIC_PHRASES)}) AS phrase) WHERE contains(lower(body), phrase)"
    o["q17_evals_cases"] = _with() + """, j AS (SELECT package_id, path, CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS doc FROM files WHERE path = 'evals/evals.json'),
 c AS (SELECT package_id, path, CASE WHEN json_exists(doc, '$.evals') THEN doc->'$.evals' WHEN json_exists(doc, '$.tests') THEN doc->'$.tests' WHEN json_exists(doc, '$.cases') THEN doc->'$.cases' WHEN json_exists(doc, '$.examples') THEN doc->'$.examples' ELSE doc END AS cases FROM j)
SELECT package_id, path, CASE WHEN json_type(cases) = 'ARRAY' THEN CAST(json_array_length(cases) AS BIGINT) END AS n_cases,
  coalesce(list_bool_or(list_transform(CASE WHEN json_type(cases) = 'ARRAY' THEN CAST(cases AS JSON[]) ELSE [] END, lambda x: coalesce(json_array_length(x, '$.assertions'), 0) > 0 OR coalesce(json_array_length(x, '$.criteria'), 0) > 0
    OR coalesce(json_type(x, '$.expected'), '') = 'VARCHAR' OR coalesce(json_type(x, '$.rubric'), '') = 'VARCHAR')), false) AS asserted FROM c"""
    o["q18_eval_files"] = _with() + """
SELECT package_id, count(*) AS n FROM files WHERE (starts_with(path, 'evals/') OR starts_with(path, 'tests/') OR starts_with(path, 'test/')) AND regexp_matches(lower(path), '\\.(md|yaml|yml|txt|jsonl|json)$') GROUP BY 1"""
    # lines of markdown are masked by a walk from line to line
    masked = f"""walk AS (
  SELECT package_id, path, CAST(0 AS BIGINT) AS line_no, '' AS fence, 0 AS section, '' AS line FROM files WHERE {_MD}
  UNION ALL
  SELECT package_id, path, line_no, CASE WHEN opens THEN marker WHEN closes THEN '' ELSE fence END, section2, CASE WHEN fence <> '' OR opens OR quote OR section2 > 0 THEN '' ELSE line END
  FROM (SELECT *, CASE WHEN plain AND section1 = 0 AND regexp_matches(line, {_L(EXAMPLE_HEADING)}) THEN level ELSE section1 END AS section2
    FROM (SELECT *, CASE WHEN plain AND section > 0 AND level <= section THEN 0 ELSE section END AS section1
      FROM (SELECT *, fence = '' AND NOT opens AND level > 0 AND NOT quote AS plain
        FROM (SELECT l.package_id, l.path, l.line_no, l.line, w.fence, w.section, regexp_extract(l.line, '^(\\s*)(```|~~~)', 2) AS marker, w.fence = '' AND regexp_matches(l.line, '^(\\s*)(```|~~~)') AS opens,
                w.fence <> '' AND regexp_extract(l.line, '^(\\s*)(```|~~~)', 2) = w.fence AS closes, regexp_matches(l.line, '^\\s*>') AS quote, length(regexp_extract(l.line, '^(#{{1,6}})\\s', 1)) AS level
              FROM lines l JOIN walk w ON l.package_id = w.package_id AND l.path = w.path AND l.line_no = w.line_no + 1)))))"""
    norm = masked + r""",
norm AS MATERIALIZED (SELECT package_id, path, line_no, regexp_replace(regexp_replace(lower(line), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS line
  FROM (SELECT package_id, path, line_no, line FROM walk WHERE line_no > 0 UNION ALL SELECT package_id, path, line_no, line FROM lines WHERE NOT ends_with(lower(path), '.md')))"""
    beh = "\nUNION ALL ".join(f"SELECT package_id, path, CAST({i} AS BIGINT) AS pat_idx, {_L(p.rule)} AS rule_id, CAST(sum(c) AS BIGINT) AS n, min(line_no) AS line_no, min_by(substr(line, 1, 120), line_no) AS snippet FROM (SELECT *, len(regexp_extract_all(line, {_L(p.regex)})) AS c FROM norm) WHERE c > 0 GROUP BY ALL" for i, p in enumerate(BEHAVIORAL) if not p.look_back)
    walking = lambda *more: _with(*more).replace("WITH files", "WITH RECURSIVE files", 1)
    o["q19_behavioral_counts"] = walking(norm) + "\n" + beh
    ask = BEHAVIORAL[11].regex
    before = "right(array_to_string(list_transform(range(1, i + 1), lambda j: parts[j] || CASE WHEN j < i THEN m[j] ELSE '' END), ''), 40)"
    asked = f"asked AS (SELECT package_id, path, line_no, len(list_filter(range(1, len(m) + 1), lambda i: NOT regexp_matches({before}, {_L(NEGATION)}))) AS c FROM (SELECT *, regexp_extract_all(line, {_L(ask)}) AS m, string_split_regex(line, {_L(ask)}) AS parts FROM norm) WHERE len(m) > 0)"
    o["q20_negated_solicitation"] = walking(norm, asked) + "\nSELECT package_id, path, CAST(sum(c) AS BIGINT) AS n, min(line_no) AS line_no FROM asked WHERE c > 0 GROUP BY 1, 2"
    invisible = "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FEFF}\\x{E0000}-\\x{E007F}]"
    any_of = lambda rules, x: "(" + " OR ".join(f"regexp_matches({x}, {_L(p.regex)})" for p in rules) + ")"
    low_line = "regexp_replace(regexp_replace(lower(line), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
    o["q06_hidden_unicode"] = _with(f"inv AS (SELECT package_id, path, line_no, regexp_replace(line, '{invisible}', '', 'g') AS line FROM lines WHERE regexp_matches(line, '{invisible}'))",
        f"v AS (SELECT package_id, path, line_no, CASE WHEN {any_of(SENSITIVE, 'line')} THEN 'pattern' WHEN {any_of(BEHAVIORAL, low_line)} THEN 'signal' WHEN regexp_matches(line, {_L(URL_HIDDEN)}) THEN 'url' END AS v FROM inv)") + """
SELECT package_id, path, coalesce(min(line_no) FILTER (WHERE v IS NOT NULL), min(line_no)) AS line_no, coalesce(min_by(v, line_no) FILTER (WHERE v IS NOT NULL), 'plain') AS verdict FROM v GROUP BY 1, 2"""
    o["q21_base64_verdict"] = _with(_coded()) + """
SELECT package_id, path, verdict, CASE verdict WHEN 'code' THEN 'VTD-0077' WHEN 'net' THEN 'VTD-0078' WHEN 'url' THEN 'VTD-0079' ELSE 'VTD-0080' END AS rule_id, CAST(line_no AS BIGINT) AS line_no FROM verdicts"""
    hidden = o["q06_hidden_unicode"].split("\nSELECT package_id, path, coalesce", 1)
    o["q41_obfuscation_chains"] = hidden[0] + f""",
u AS (SELECT package_id, path, coalesce{hidden[1]}),
{_coded()},
c AS (SELECT package_id, path, verdict, m, row_number() OVER (PARTITION BY package_id ORDER BY path) - 1 AS n FROM verdicts WHERE verdict <> 'advisory')
SELECT package_id, CASE verdict WHEN 'code' THEN 'VTD-0077' WHEN 'net' THEN 'VTD-0078' ELSE 'VTD-0079' END AS rule_id, 'critical' AS severity,
  CASE verdict WHEN 'code' THEN 'Obfuscated dangerous code' WHEN 'net' THEN 'Obfuscated network call' ELSE 'Obfuscated external URL (dead-drop)' END AS label, path AS filepath,
  'Decoded base64 in ' || path || CASE verdict WHEN 'code' THEN ' matched: ' || ({_list([p.label for p in SENSITIVE])})[m + 1] WHEN 'net' THEN ' contained a network transmission call' ELSE ' contained an external URL. Possible dead-drop or remote instruction source.' END AS detail,
  'malicious' AS intent, 'obfusc-' || verdict || '-' || n AS chain_id FROM c
UNION ALL SELECT package_id, 'VTD-0079', 'critical', 'Obfuscated external URL (dead-drop)', path, 'Hidden Unicode in ' || path || ':' || line_no || ' concealed an external URL', 'malicious',
  'obfusc-uni-' || (row_number() OVER (PARTITION BY package_id ORDER BY path) - 1) FROM u WHERE verdict = 'url'"""
    failing = "\nUNION ALL ".join(f"SELECT package_id FROM norm WHERE regexp_matches(line, {_L(p.regex)})" for p in BEHAVIORAL if p.severity in ("critical", "high") and not p.look_back)
    o["q22_rollups"] = walking(norm, asked, _sensitive_hits(), _entropy("lines")) + f"""
SELECT DISTINCT package_id, 'VTD-0091' AS rule_id FROM files WHERE package_id NOT IN (SELECT package_id FROM sens WHERE severity IN ('critical', 'high') UNION ALL SELECT package_id FROM keyed JOIN ent USING (id) WHERE round(h, 12) >= 3.5
  UNION ALL SELECT package_id FROM files WHERE regexp_matches(path, {_L(ENV_FILE)}))
UNION ALL SELECT DISTINCT package_id, 'VTD-0092' FROM files WHERE package_id NOT IN ({failing} UNION ALL SELECT package_id FROM asked WHERE c > 0)"""
    sink = "(" + " OR ".join(f"regexp_matches(content, {_L(p)})" for p in SINKS) + ")"
    o["q23_exfil_chain"] = _with(_sensitive_hits(), _entropy("lines")) + f""",
 src AS (SELECT package_id, path FROM sens WHERE source UNION SELECT package_id, path FROM keyed JOIN ent USING (id) WHERE round(h, 12) >= 3.5)
SELECT package_id, path AS filepath, 'cred-exfil-' || (row_number() OVER (PARTITION BY package_id ORDER BY path) - 1) AS chain_id FROM files JOIN src USING (package_id, path) WHERE {sink}"""
    o["q24_activity_chain"] = sens + """, per AS (SELECT package_id, path, list(bucket ORDER BY pat_idx) FILTER (WHERE bucket IS NOT NULL) AS l, count(DISTINCT bucket) AS k,
   bool_or(bucket IS NULL AND intent = 'malicious' AND severity IN ('critical', 'high')) AS strong FROM sens GROUP BY 1, 2),
 u AS (SELECT package_id, path, list_reduce(list_prepend('', l), lambda a, b: CASE WHEN contains(a, b) THEN a WHEN a = '' THEN b ELSE a || ' + ' || b END) AS names FROM per WHERE k >= 2 OR (k >= 1 AND strong))
SELECT package_id, path AS filepath, 'mal-activity-' || (row_number() OVER (PARTITION BY package_id ORDER BY path) - 1) AS chain_id, path || ' contains ' || names || ' indicators that co-occur in a malicious pattern.' AS detail FROM u"""
    o["q25_mismatch"] = _with(_sensitive_hits(), _DEFS) + f""", w AS (SELECT package_id, list_filter({_list(BENIGN_WORDS)}, lambda x: contains(lower(description), x)) AS l FROM defs)
SELECT package_id, 'Description uses benign-sounding terms (' || array_to_string(l[1:3], ', ') || ') but the package contains malicious security findings. Review carefully.' AS detail
FROM w WHERE len(l) > 0 AND package_id IN (SELECT package_id FROM sens WHERE intent = 'malicious')"""
    sides = """, a AS (SELECT package_id, rule_id, label, max_by({'s': severity, 'd': snippet}, (path, pat_idx)) AS f FROM sens GROUP BY ALL),
 b AS (SELECT package_id, rule_id, label, max_by({'s': CASE WHEN pat_idx % 5 = 0 THEN 'info' ELSE severity END, 'd': snippet}, (path, pat_idx)) AS f FROM sens WHERE pat_idx % 7 <> 0 GROUP BY ALL),
 d AS (SELECT package_id, rule_id, label, CASE WHEN b.f IS NULL THEN 'left_only' WHEN a.f.s <> b.f.s OR a.f.d <> b.f.d THEN 'mismatched' ELSE 'matched' END AS status,
   CASE WHEN b.f IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a.f.s <> b.f.s THEN 'severity' END, CASE WHEN a.f.d <> b.f.d THEN 'detail' END], lambda x: x IS NOT NULL), ',') END AS fields, a.f AS fa, b.f AS fb FROM a LEFT JOIN b USING (package_id, rule_id, label))"""
    o["q28_diff"] = "" + _with(_sensitive_by_key()) + sides + "\nSELECT package_id, rule_id, label, status, fields FROM d"
    o["q29_diff_summary"] = _with(_sensitive_by_key()) + sides + """
SELECT package_id, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'mismatched') AS mismatched, count(*) FILTER (WHERE status = 'left_only') AS left_only, CAST(0 AS BIGINT) AS right_only,
  count(*) FILTER (WHERE status <> 'matched') = 0 AS passed FROM d GROUP BY 1"""
    o["q31_exfil_tags"] = _with(_sensitive_hits(), _entropy("lines")) + f""",
 every AS (SELECT package_id, path, rule_id, label, severity FROM sens UNION ALL SELECT package_id, path, 'VTD-0003', 'High-entropy value — potential hardcoded secret', 'critical' FROM (SELECT DISTINCT package_id, path, line_no FROM keyed JOIN ent USING (id) WHERE round(h, 12) >= 3.5)),
 marked AS (SELECT *, {_any('label', CREDENTIAL_LABELS)} AND severity <> 'info' AS src, {_any('lower(label)', chains.NETWORK_WORDS)} AS net FROM every),
 ch AS (SELECT package_id, path, 'cred-exfil-' || (row_number() OVER (PARTITION BY package_id ORDER BY path) - 1) AS chain_id FROM files JOIN (SELECT DISTINCT package_id, path FROM marked WHERE src) USING (package_id, path) WHERE {sink})
SELECT package_id, rule_id, path AS filepath, label, 'critical' AS severity, 'malicious' AS intent, chain_id FROM marked JOIN ch USING (package_id, path) WHERE src OR net"""
    o["q32_activity_tags"] = o["q24_activity_chain"].split("SELECT package_id, path AS filepath, 'mal-activity-'")[0].rstrip() + """, c AS (SELECT package_id, path, 'mal-activity-' || (row_number() OVER (PARTITION BY package_id ORDER BY path) - 1) AS chain_id FROM u)
SELECT package_id, rule_id, path AS filepath, label, 'critical' AS severity, 'malicious' AS intent, chain_id FROM sens JOIN c USING (package_id, path) WHERE bucket IS NOT NULL"""
    o["q33_prompt_leak"] = _with() + f"\nSELECT package_id, 'medium' AS severity, 'System prompt leakage risk' AS label FROM files WHERE path = 'SKILL.md' AND regexp_matches(content, {_L(PROMPT_LEAK)})"
    o["q34_body_references"] = defs + f"""
SELECT package_id, 'info' AS severity, 'Progressive disclosure used' AS label FROM defs WHERE regexp_replace(body, '^\\s+|\\s+$', '', 'g') <> '' AND (contains(body, 'references/') OR contains(body, 'scripts/') OR contains(body, 'assets/') OR regexp_matches(body, {_L(READ_MD)}))
  AND package_id IN (SELECT package_id FROM files WHERE split_part(path, '/', 1) IN ('references', 'scripts', 'assets') AND contains(path, '/'))"""
    o["q35_wire_round_trip"] = sens + f"\nSELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY path, pat_idx) AS seq, rule_id, 'security' AS category, severity, label, path AS filepath, intent, {_L(DEFAULT_SOURCE)} AS source FROM sens"
    o["q36_envelopes"] = o["q01_structure_flags"]
    o["q37_envelope_errors"] = "SELECT DISTINCT 'p' || (doc_id // 8) AS package_id, false AS ok, 'invalid request body' AS error FROM documents WHERE doc_id IS NOT NULL AND (doc_id // 8) % 3 <> 2"
    o["q38_engine_info"] = _with() + f'\nSELECT package_id, count(*) AS file_count, true AS ok, {SCANNER_SCHEMA_VERSION} AS "scannerVersion" FROM files GROUP BY 1'
    o["q39_source_filter"] = sens + "\nSELECT DISTINCT package_id, rule_id, label FROM sens WHERE pat_idx % 3 = 2"
    o["q40_case_tally"] = _with(_sensitive_by_key()) + sides + """, each AS (SELECT package_id, bool_and(status = 'matched') AS passed FROM d GROUP BY 1),
 t AS (SELECT package_id, passed, CAST(substr(package_id, 2) AS BIGINT) % 5 = 0 AS bad FROM (SELECT DISTINCT package_id FROM files) LEFT JOIN each USING (package_id))
SELECT count(*) FILTER (WHERE NOT bad AND passed) AS passed, count(*) FILTER (WHERE NOT bad AND NOT passed) AS failed, count(*) FILTER (WHERE bad) AS errors FROM t"""
    o["q42_directories"] = _with() + ", t AS (SELECT package_id, path, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS c FROM files)\nSELECT package_id, path, length(c) AS chars, md5(c) AS md5 FROM t"
    o["q43_diff_order"] = _with(_sensitive_by_key()) + sides + "\nSELECT row_number() OVER (ORDER BY package_id, rule_id, label) AS diff_seq, package_id, 'security' AS category, rule_id, label, status FROM d"
    rep = lambda x: f"(WITH v AS (SELECT replace(replace(replace({x}, '\\', '\\\\'), chr(13), '\\r'), chr(9), '\\t') AS e) SELECT CASE WHEN contains(e, chr(39)) AND NOT contains(e, chr(34)) THEN chr(34) || e || chr(34) ELSE chr(39) || replace(e, chr(39), '\\' || chr(39)) || chr(39) END FROM v)"
    o["q48_diff_reports"] = _with(_sensitive_by_key()) + sides + f""",
 n AS (SELECT package_id, count(*) FILTER (WHERE status = 'matched') AS m, count(*) FILTER (WHERE status = 'left_only') AS l, sum(len(string_split(fields, ',')) * CAST(fields <> '' AS INTEGER)) AS k FROM d GROUP BY 1),
 e AS (SELECT package_id, 0 AS s, 0 AS i, NULL AS rule_id, NULL AS label, 0 AS j, CASE WHEN l + k > 0 THEN 'FAIL  ' ELSE 'PASS  ' END || package_id AS text FROM n
  UNION ALL SELECT package_id, 1, 0, NULL, NULL, 0, '  left only (' || l || ' finding(s)):' FROM n WHERE l > 0
  UNION ALL SELECT package_id, 3, 0, NULL, NULL, 0, '  Field mismatches (' || k || '):' FROM n WHERE k > 0
  UNION ALL SELECT package_id, 4, 0, NULL, NULL, 0, '  ' || m || ' finding(s) matched exactly.' FROM n WHERE m > 0 OR l + k = 0
  UNION ALL SELECT package_id, 1, 1, rule_id, label, 0, '    - [' || fa.s || '] security / ' || {rep('label')} FROM d WHERE status = 'left_only'
  UNION ALL SELECT package_id, 3, 1, rule_id, label, 0, '    [security / ' || {rep('rule_id')} || ' / ' || {rep('label')} || '] .severity:' || chr(10) || '      left : ' || {rep('fa.s')} || chr(10) || '      right: ' || {rep('fb.s')} FROM d WHERE status = 'mismatched' AND fa.s <> fb.s
  UNION ALL SELECT package_id, 3, 1, rule_id, label, 1, '    [security / ' || {rep('rule_id')} || ' / ' || {rep('label')} || '] .detail:' || chr(10) || '      left : ' || {rep("'`' || fa.d || '`'")} || chr(10) || '      right: ' || {rep("'`' || fb.d || '`'")} FROM d WHERE status = 'mismatched' AND fa.d <> fb.d),
 z AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY s, i, rule_id, label, j) AS line FROM e)
SELECT package_id, (line - 1) // 4 AS part, string_agg(text, chr(10) ORDER BY line) AS text FROM z GROUP BY ALL"""
    listing = """WITH u AS (SELECT page_id % 10 AS last, rtrim(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/') AS a FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL),
 p AS (SELECT CASE last WHEN 0 THEN split_part(a, '/', 1) || '/SKILL.md' WHEN 3 THEN array_to_string(string_split(a, '/')[:2], '/') || '/skill.md' WHEN 7 THEN array_to_string(string_split(a, '/')[:2], '/') || '/.old/SKILL.md' ELSE a || '/index.html' END AS path FROM u),
 r AS (SELECT DISTINCT regexp_replace(path, '/(SKILL|skill)\\.md$', '') AS root FROM p WHERE regexp_matches(path, '/(SKILL|skill)\\.md$') AND NOT contains(path, '/.old/')),
 f AS (SELECT root AS package_id, substr(path, length(root) + 2) AS path FROM p JOIN r ON starts_with(path, root || '/') WHERE NOT contains(path, '/.old/'))"""
    o["q49_package_roots"] = listing + "\nSELECT package_id, n_files, root_seq FROM (SELECT package_id, count(*) AS n_files FROM f GROUP BY 1) JOIN (SELECT root AS package_id, row_number() OVER (ORDER BY string_split(root, '/')) AS root_seq FROM r) USING (package_id)"
    o["q50_package_listing"] = listing + "\nSELECT package_id, path FROM f"
    o["q44_repeated_keys"] = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n_cases, doc_id % 3 <> 0 AS asserted FROM documents WHERE doc_id IS NOT NULL"
    full = _full(o, norm, asked, sink)
    o["q26_full_findings"] = full + f"""
SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY phase, k1, k2) AS seq, rule_id, category, severity, label, detail, filepath, CAST(NULL AS VARCHAR) AS owasp_llm_category, chain_id, intent, {_L(DEFAULT_SOURCE)} AS source FROM found"""
    parts = [list(files) for files in cases.CASES.values()]
    must = "[" + ", ".join(str([f in cases.EXPECTED[n] for f in ("has_skill_md", "has_scripts", "has_references", "has_evals")]) for n in cases.CASES) + "]"
    o["q46_case_verdicts"] = f"""WITH f AS (SELECT doc_id // 8 AS n, ([{', '.join(_list(p) + '::VARCHAR[]' for p in parts)}])[doc_id // 8 % 7 + 1][doc_id % 8 + 1] AS path FROM documents WHERE doc_id IS NOT NULL),
 g AS (SELECT n, [coalesce(bool_or(path = 'SKILL.md'), false), coalesce(bool_or(path LIKE 'scripts/%'), false), coalesce(bool_or(path LIKE 'references/%'), false), coalesce(bool_or(path LIKE 'evals/%'), false)] AS has, count(path) AS file_count FROM f GROUP BY 1)
SELECT 'p' || n AS package_id, ({_list(list(cases.CASES))})[n % 7 + 1] AS case_name, has = ({must})[n % 7 + 1] AS agrees, file_count FROM g WHERE n % 7 NOT IN (1, 6)"""
    o["q45_stream_audit"] = o["q26_full_findings"]
    given = lambda wire_name, c: f"'\"{wire_name}\":' || coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"
    pairs = " || ',' || ".join(given(w, c) for w, c in (("ruleId", "rule_id"), ("category", "category"), ("severity", "severity"), ("label", "label"), ("detail", "detail")))
    rest = " || ',' || ".join(given(w, c) for w, c in (("owaspLlmCategory", "CAST(NULL AS VARCHAR)"), ("chainId", "chain_id"), ("intent", "intent")))
    o["q47_findings_documents"] = full + f""",
 j AS (SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY phase, k1, k2) AS seq, '{{' || {pairs} || CASE WHEN filepath IS NULL THEN '' ELSE ',' || {given('filepath', 'filepath')} END || ',' || {rest} || '}}' AS t FROM found),
 b AS (SELECT package_id, (seq - 1) // 16 + 1 AS part, string_agg(t, ',' ORDER BY seq) AS t FROM j GROUP BY ALL)
SELECT package_id, part, CASE WHEN part > 1 THEN ',' ELSE '' END || t AS text FROM b
UNION ALL SELECT package_id, 0, '{{"findings":[' FROM q01
UNION ALL SELECT package_id, coalesce(max(part), 0) + 1, ']}}' FROM q01 LEFT JOIN b USING (package_id) GROUP BY 1"""
    counts = ", ".join(f"count(*) FILTER (WHERE severity = {_L(x)}) AS n_{x}" for x in SEVERITIES)
    o["q27_package_summary"] = full + f"""
SELECT q01.*, {SCANNER_SCHEMA_VERSION} AS scanner_version, n.* EXCLUDE (package_id) FROM q01 LEFT JOIN (SELECT package_id, count(*) AS n_findings, {counts}, CAST(max(list_position({_list(list(SEVERITIES))}, severity) - 1) AS BIGINT) AS worst, bool_or(coalesce(intent = 'malicious', false)) AS has_malicious FROM found GROUP BY 1) n USING (package_id)"""
    docs = "WITH lines AS (SELECT package_id, 'd.txt' AS path, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id AS package_id, string_split(text, chr(10)) AS l FROM documents)),\n"
    o["q30_documents_entropy"] = docs + _entropy("lines") + f"\nSELECT package_id AS doc_id, line_no, {_SNIP} AS snippet, round(min_by(h, id), 6) AS entropy FROM keyed JOIN ent USING (id) WHERE round(h, 12) >= 3.5 GROUP BY package_id, path, line_no, line"
    return o


def _sensitive_by_key() -> str:
    """Hits of all files of a package, in the order of pattern and path: the key of a diff has no path."""
    return _sensitive_hits()


ORACLE_SQL = _oracle()

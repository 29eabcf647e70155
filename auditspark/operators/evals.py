"""Evaluation suites of a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import EVAL_FILES
from .base import exploded, row, told

# Keys that hold cases, in order; keys of assertions as lists and as texts; few cases.
CASE_KEYS = ["evals", "tests", "test_cases", "scenarios", "cases", "examples"]
LIST_KEYS = ["assertions", "criteria", "pass_criteria"]
TEXT_KEYS = ["expected", "expected_output", "golden_answer", "rubric"]
FEW = 3


def case_list(doc: Column) -> Column:
    """The value of the first case key present if it is an array, or the top-level array."""
    at = lambda k: F.try_variant_get(doc, f"$.{k}", "variant")
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    out = F.when(F.lit(False), as_list(doc))
    for k in CASE_KEYS:
        out = out.when(at(k).isNotNull(), as_list(at(k)))
    return out.otherwise(as_list(doc))


def has_assertions(case: Column) -> Column:
    at = lambda k: F.try_variant_get(case, f"$.{k}", "variant")
    full = [F.coalesce(F.size(F.try_variant_get(case, f"$.{k}", "array<variant>")) > 0, F.lit(False)) for k in LIST_KEYS]
    text = [F.coalesce(F.schema_of_variant(at(k)) == "STRING", F.lit(False)) for k in TEXT_KEYS]
    out = F.lit(False)
    for t in full + text:
        out = out | t
    return out


#: What a text holds outside its strings: pieces are strings, or the brackets between them.
JSON_PIECES = r'"(?:[^"\\]++|\\.)*+"|[\[\]{}]|[^"\[\]{}]++'


def is_one_value(content: Column) -> Column:
    """Whether the text is one object or list and nothing behind it but white space, which the parser
    would tolerate: outside strings, the bracket that closes the first one comes last."""
    pieces = F.regexp_extract_all(content, F.lit(f"(?s){JSON_PIECES}"), F.lit(0))
    step = lambda s, x: F.struct(
        (s["depth"] + F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0)).cast("int").alias("depth"),
        (s["ok"] & ((s["depth"] > 0) | (s["first"] & x.isin("[", "{")))).alias("ok"), F.lit(False).alias("first"),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"), F.lit(True).alias("first"))
    blank = F.transform(pieces, lambda x: F.regexp_replace(x, r"\A\s+\z", ""))
    return X.bound(F.aggregate(F.filter(blank, lambda x: x != ""), start, step), lambda s: s["ok"] & (s["depth"] == 0) & ~s["first"])


#: Tokens walked in one piece; pieces are joined, so that no long array grows token by token.
PIECE = 512
#: Pieces of a JSON text: white space, strings, single marks, and what lies between.
JSON_TOKENS = r'\s++|"(?:[^"\\]++|\\.)*+"|[\[\]{}:,]|[^\s"\[\]{}:,]++'


def has_repeated_keys(content: Column) -> Column:
    """Whether some string is a key more than once in the text, or one is spelled with escapes: only then can an
    object repeat a key."""
    keys = F.regexp_extract_all(content, F.lit(r'(?s)("(?:[^"\\]++|\\.)*+")\s*+:'), F.lit(1))
    return X.bound(keys, lambda k: (F.size(k) > F.size(F.array_distinct(k))) | F.exists(k, lambda x: x.contains("\\")))


def last_keys(content: Column) -> Column:
    """A JSON text in which every earlier member of an object with a later key of the same name is renamed: the
    parser refuses repeated keys, where the last one is to count.

    Keys are numbered by a walk over the tokens that keeps the open brackets; a key's place is the number of its
    object and its name, and of each place all but the last are spelled with a mark and their position,
    which no evaluation key has.  Names are compared as they decode, escapes included."""
    tokens = F.filter(F.regexp_extract_all(content, F.lit(f"(?s){JSON_TOKENS}"), F.lit(0)), lambda t: ~t.rlike(r"\A\s"))
    state = lambda open_, n, places: F.struct(open_.alias("open"), n.cast("int").alias("n"), places.alias("places"))
    empty = F.array().cast("array<string>")

    def step(s: Column, t: Column) -> Column:
        opens, closes = t["now"].isin("{", "["), t["now"].isin("}", "]")
        key = (t["next"] == ":") & t["now"].startswith('"')
        name = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), t["now"], F.lit("}")), "$.v"), t["now"])
        depth = F.size(s["open"])
        return state(
            F.when(opens, F.concat(s["open"], F.array(s["n"] + 1))).when(closes, F.slice(s["open"], F.lit(1), F.greatest(depth - 1, F.lit(0)))).otherwise(s["open"]),
            s["n"] + opens.cast("int"),
            F.concat(s["places"], F.array(F.when(key & (depth > 0), F.concat(F.element_at(s["open"], F.greatest(depth, F.lit(1))).cast("string"), F.lit(" "), name)))),
        )

    def renamed(ts: Column) -> Column:
        pairs = F.transform(ts, lambda t, i: F.struct(t.alias("now"), F.coalesce(F.get(ts, i + 1), F.lit("")).alias("next")))

        def piece(s: Column, k: Column) -> Column:
            one = F.aggregate(F.slice(pairs, k * PIECE + 1, F.lit(PIECE)), state(s["open"], s["n"], empty), step)
            return X.bound(one, lambda r: state(r["open"], r["n"], F.concat(s["places"], r["places"])))

        walked = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(ts) - 1) / PIECE).cast("int")), state(F.array().cast("array<int>"), F.lit(0), empty), piece)["places"]

        def joined(places: Column) -> Column:
            # in order of place and position, a key that the next one repeats is not the last
            keys = F.array_sort(F.filter(F.transform(places, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda k: k["p"].isNotNull()))
            earlier = lambda ks: F.array_compact(F.transform(ks, lambda k, j: F.when(F.get(ks, j + 1)["p"] == k["p"], k["i"])))
            spelled = lambda gone: F.transform(ts, lambda t, i: F.when(F.array_contains(gone, i), F.concat(F.lit('"\x7f'), i.cast("string"), F.lit('"'))).otherwise(t))
            return F.array_join(X.bound(X.bound(keys, earlier), spelled), "")

        return X.bound(walked, joined)

    return F.when(F.size(tokens) > 0, X.bound(tokens, renamed)).otherwise(content)


def parsed_json(content: Column) -> Column:
    """The text as a variant, or null; of repeated keys of an object the last counts."""
    text = F.when(has_repeated_keys(content), last_keys(content)).otherwise(content)
    return F.when(is_one_value(content), X.bound(text, F.try_parse_json))


def suite_fact(content: Column) -> Column:
    """struct<n_cases, asserted> of a suite file; n_cases is null if it is no JSON or has no list."""
    cases = lambda doc: F.when(doc.isNotNull(), case_list(doc))
    told = lambda c: F.struct(F.size(c).cast("bigint").alias("n_cases"), F.coalesce(F.exists(c, has_assertions), F.lit(False)).alias("asserted"))
    return X.bound(parsed_json(content), lambda doc: X.bound(cases(doc), told))


def suites(files: DataFrame) -> DataFrame:
    """package_id, path, n_cases (null: not JSON or no list), asserted: the first suite file that a
    package has, in the order of EVAL_FILES."""
    order = F.array_position(F.array(*[F.lit(p) for p in EVAL_FILES]), F.col("path"))
    rows = files.where(F.col("path").isin(EVAL_FILES))
    rows = rows.select("package_id", "path", F.col("suite") if "suite" in files.columns else suite_fact(F.col("content")).alias("suite"))
    # some suite is never null where there is a file, so the first file counts even if it is no JSON
    return rows.groupBy("package_id").agg(F.min_by(F.struct("path", "suite"), order).alias("f")).select("package_id", "f.path", "f.suite.n_cases", "f.suite.asserted")


def eval_kinds(p: Column) -> tuple[Column, Column, Column]:
    """Whether a path is in a folder of evaluations, is one by its name, or would be as a text file."""
    low = F.lower(p)
    inside = p.startswith("evals/") | p.startswith("tests/") | p.startswith("test/")
    return inside, low.endswith(".md") | low.endswith(".yaml") | low.endswith(".yml") | low.endswith(".txt") | low.endswith(".jsonl"), low.endswith(".json")


def eval_files(paths: DataFrame, files: DataFrame) -> DataFrame:
    """package_id, n: listed evaluation files in other formats (JSON only where it is a text file)."""
    inside, plain, data = eval_kinds(F.col("path"))
    held = files.select("package_id", "path", F.lit(True).alias("held"))
    rows = paths.where(inside).join(held, ["package_id", "path"], "left").where(plain | (data & F.col("held")))
    return rows.groupBy("package_id").agg(F.count(F.lit(1)).alias("n"))


def eval_found(suite: Column, n: Column) -> Column:
    """Findings about a package's suite (struct n_cases, asserted; null if it has none) and its n other files."""
    lit, cases, asserted = F.lit, suite["n_cases"], suite["asserted"]
    some = cases > 0
    return told(240, "evals", [
        row(some, 0, "VTD-0119", "info", "Test cases defined", F.concat(cases.cast("string"), lit(" test case(s) found in evals JSON"))),
        row(some & asserted, 1, "VTD-0120", "info", "Assertions defined for test cases", "Verifiable assertions or expected outputs enable automated grading of skill outputs"),
        row(some & ~asserted, 1, "VTD-0120", "info", "No assertions in test cases", "Add verifiable assertions, expected outputs, or criteria to each test case"),
        row(some & (cases < FEW), 2, "VTD-0121", "info", "Few test cases", "Consider adding at least 3 test cases covering varied prompts and edge cases"),
        row(suite.isNull() & (n > 0), 0, "VTD-0123", "info", "Eval files found", F.concat(n.cast("string"), lit(" evaluation file(s) detected in non-JSON format (markdown, YAML, JSONL, etc.)"))),
    ])


def eval_checks(files: DataFrame, paths: DataFrame, flags: DataFrame) -> DataFrame:
    on = flags.where("has_evals").select("package_id")
    suite = suites(files).select("package_id", F.struct("n_cases", "asserted").alias("suite"))
    both = on.join(suite, "package_id", "left").join(eval_files(paths, files), "package_id", "left")
    return exploded(both, eval_found(F.col("suite"), F.col("n")))

"""Markdown: blanking what is quoted or given as an example, and front matter.

Both are ordered folds over a file's lines, kept inside the row with aggregate().
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import EXAMPLE_HEADING, FENCE, HEADING, QUOTE


#: Lines folded into one piece; pieces are joined, so that no long array grows line by line.
PIECE = 512


def masked_lines(content: Column) -> Column:
    """The lines, with those in fences, block quotes and example sections emptied; positions stay.

    What a line says is read first: a fence's marker, a heading's level, whether it quotes, whether it
    heads an example.  The fold's state is then the open fence's marker, the level of the example
    section and the lines so far.  A fence only closes with the marker that opened it; a heading at the
    section's level or above leaves the section, and may open another.
    """
    none = F.struct(F.lit("").alias("marker"), F.lit(0).alias("level"), F.lit(False).alias("quote"), F.lit(False).alias("example"))

    def said(line: Column) -> Column:
        level = F.length(F.regexp_extract(line, X.java(HEADING), 1))
        some = F.struct(F.regexp_extract(line, X.java(FENCE), 2).alias("marker"), level.alias("level"), line.rlike(X.java(QUOTE)).alias("quote"), ((level > 0) & line.rlike(X.java(EXAMPLE_HEADING))).alias("example"))
        return F.struct(line.alias("line"), F.when(line.rlike(r"(?U)^\s*[`~#>]"), some).otherwise(none).alias("is"))

    def state(fence: Column, section: Column, out: Column) -> Column:
        return F.struct(fence.alias("fence"), section.cast("int").alias("section"), out.alias("out"))

    def step(s: Column, row: Column) -> Column:
        marker, level, quote = row["is"]["marker"], row["is"]["level"], row["is"]["quote"]
        inside = s["fence"] != ""
        opens = ~inside & (marker != "")
        closes = inside & (marker == s["fence"])
        plain = ~inside & ~opens & (level > 0) & ~quote
        still = F.when(plain & (s["section"] > 0) & (level <= s["section"]), F.lit(0)).otherwise(s["section"])

        def with_section(section: Column) -> Column:
            blank = inside | opens | quote | (section > 0)
            fence = F.when(opens, marker).when(closes, F.lit("")).otherwise(s["fence"])
            return state(fence, section, F.concat(s["out"], F.array(F.when(blank, F.lit("")).otherwise(row["line"]))))

        return X.bound(F.when(plain & (still == 0) & row["is"]["example"], level).otherwise(still), with_section)

    empty = F.array().cast("array<string>")

    def folded(rows: Column) -> Column:
        def piece(s: Column, k: Column) -> Column:
            one = F.aggregate(F.slice(rows, k * PIECE + 1, F.lit(PIECE)), state(s["fence"], s["section"], empty), step)
            return X.bound(one, lambda r: state(r["fence"], r["section"], F.concat(s["out"], r["out"])))

        pieces = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / PIECE).cast("int"))
        return F.aggregate(pieces, state(F.lit(""), F.lit(0), empty), piece)["out"]

    return X.bound(F.transform(X.lines(content), said), folded)


def parsed_definition(content: Column) -> Column:
    """struct<name, description, repository, body> of a definition file.

    Front matter opens with `---` on the first line and closes with the first later line that starts
    with `---`, which must hold nothing else; otherwise the name is `unknown` and all is body.
    """
    def cut(rest: Column) -> Column:
        return X.bound(F.instr(rest, "\n---"), lambda at: F.struct(at.alias("at"), F.substring(rest, F.lit(1), at - 1).alias("head"), F.regexp_replace(F.substring(rest, at + 4, F.length(rest)), r"\A[ \t]+", "").alias("after")))

    # each is evaluated once: within a lambda the optimizer finds no common expressions
    rest = F.substring(content, F.lit(5), F.length(content))
    return X.bound(rest, lambda r: X.bound(cut(r), lambda c: _parsed(content, c["at"], c["head"], c["after"])))


def _parsed(content: Column, at: Column, front: Column, after: Column) -> Column:
    framed = content.startswith("---\n") & (at > 0) & ((after == "") | after.startswith("\n") | after.startswith("\r"))
    body = F.when(after.startswith("\n"), F.regexp_replace(after, r"\A\n+", "")).otherwise(F.lit(""))
    head = F.transform(F.split(front, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("more"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("got"))

    def put(got: Column, key: Column, value: Column) -> Column:
        fresh = F.map_filter(got, lambda k, _: k != key)
        return F.when(key.isin("name", "description", "repository"), F.map_concat(fresh, F.map_from_arrays(F.array(key), F.array(value)))).otherwise(got)

    def closed(s: Column) -> Column:
        return F.when(s["open"] != "", put(s["got"], s["open"], F.array_join(s["more"], " "))).otherwise(s["got"])

    def step(s: Column, line: Column) -> Column:
        bare = X.trimmed(line)
        deeper = line.startswith(" ") | line.startswith("\t")
        goes_on = (s["open"] != "") & ((bare == "") | deeper)
        is_key = ~deeper & (bare != "") & line.contains(":")
        key = X.trimmed(F.regexp_extract(line, r"(?s)\A([^:]*):", 1))
        value = X.trimmed(F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z", 1))
        quoted = F.regexp_extract(value, r"""(?s)\A(?:"(.*)"|'(.*)')\z""", 1)
        quoted1 = F.regexp_extract(value, r"""(?s)\A'(.*)'\z""", 1)
        inline = F.when(value.rlike(r"""(?s)\A".*"\z""") & (F.length(value) >= 2), quoted).when(value.rlike(r"""(?s)\A'.*'\z""") & (F.length(value) >= 2), quoted1).otherwise(value)
        got = closed(s)
        return F.struct(
            F.when(goes_on, s["open"]).when(is_key & (value == ""), key).otherwise(F.lit("")).alias("open"),
            F.when(goes_on, F.when(bare == "", s["more"]).otherwise(F.concat(s["more"], F.array(bare)))).otherwise(F.array().cast("array<string>")).alias("more"),
            F.when(goes_on, s["got"]).when(is_key & (value != ""), put(got, key, inline)).otherwise(got).alias("got"),
        )

    got = F.aggregate(head, start, step, closed)
    field = lambda k: F.coalesce(F.try_element_at(got, F.lit(k)), F.lit(""))
    name = F.when(framed, F.coalesce(F.try_element_at(got, F.lit("name")), F.lit("unknown"))).otherwise(F.lit("unknown"))
    return F.struct(
        name.alias("name"), F.when(framed, field("description")).otherwise(F.lit("")).alias("description"), F.when(framed, field("repository")).otherwise(F.lit("")).alias("repository"),
        F.when(framed, body).otherwise(content).alias("body"),
    )

"""Column functions of the audit.  Patterns are kept in one raw form; java() adds the flags that give
them the meaning they are written for: `.`, `^` and `$` know only the line feed, classes and case
are Unicode's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def java(pattern: str, more: str = "") -> str:
    """The pattern with flags for java.util.regex; a `$` outside (?m) means the very end."""
    head = re.match(r"\(\?([a-z]+)\)", pattern)
    multiline = "m" in more or bool(head and "m" in head[1])
    if not multiline:
        pattern = re.sub(r"(?<!\\)\$(?=\)|$|\|)", r"\\z", pattern)
    return f"(?dU{more}){pattern}"


def sql(value: str | None) -> str:
    """The value as an SQL literal.  Expressions of many patterns are written as SQL text, which Spark
    parses at once, where building them call by call takes seconds."""
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"  # ${...} would be a variable


def bound(value: Column, f) -> Column:
    """f(value) with value evaluated just once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def trimmed(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def snippet(line: Column) -> Column:
    """The trimmed line, its first 120 code points."""
    return F.substring(trimmed(line), 1, 120)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def folded(text: Column) -> Column:
    """Lower case, with the long s folded too, so that literals can stand in for (?i) patterns."""
    return F.translate(F.lower(text), "ſ", "s")


def entropy(value: Column) -> Column:
    """Shannon entropy in bits over the value's bytes, rounded to 12 digits."""
    digits = F.hex(value.cast("binary"))
    n = F.octet_length(value)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(digits, i * 2 + 1, F.lit(2)))
    plogp = lambda acc, d: acc + F.element_at(F.transform(F.array(F.size(F.filter(each, lambda x: x == d)) / n), lambda p: -p * F.log2(p)), 1)
    return F.round(F.when(n > 0, F.aggregate(F.array_sort(F.array_distinct(each)), F.lit(0.0), plogp)).otherwise(F.lit(0.0)), 12)


def printable_ratio(decoded: Column) -> Column:
    """Share of printable ASCII, tab, line feed and carriage return among the decoded bytes."""
    n = F.octet_length(decoded)
    return F.when(n > 0, F.length(F.regexp_replace(decoded, r"[^\x20-\x7E\t\n\r]", "")) / n).otherwise(F.lit(0.0))


def strict_base64(x: Column) -> Column:
    """Decoded bytes, or null unless x is canonical standard base64 with its padding."""
    right = x.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.octet_length(x) % 4 == 0) & ~x.rlike("(?s)=[^=]")
    value = F.when(right, F.unbase64(x))
    return F.when(F.regexp_replace(F.base64(value), r"\s", "") == x, value)


def lenient_base64(x: Column) -> Column:
    """Three attempts - as it is, padded, the URL alphabet padded - as text with bad bytes replaced."""

    def padded(y: Column) -> Column:
        rest = F.octet_length(y) % 4
        return F.when(rest == 2, F.concat(y, F.lit("=="))).when(rest == 3, F.concat(y, F.lit("="))).otherwise(y)

    tries = [x, padded(x), padded(F.translate(x, "-_", "+/"))]
    return F.make_valid_utf8(F.coalesce(*[strict_base64(t) for t in tries]).cast("string"))


def strip_invisible(x: Column) -> Column:
    return F.regexp_replace(x, INVISIBLE, "")


# The code points that count as invisible.
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}\x{E0000}-\x{E007F}]"


def normalized(line: Column) -> Column:
    """Lower case, blanks and tabs collapsed, trimmed."""
    return trimmed(F.regexp_replace(F.lower(line), "[ \t]+", " "))

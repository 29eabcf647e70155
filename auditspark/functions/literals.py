"""Literals that a match of a pattern must hold, and one automaton that finds those of all patterns at once.

The requirement of a pattern is read off its own expression: alternatives, each a set of literals that
must all occur.  It may be weaker than the pattern but never stronger; a pattern that demands no literal, or
whose syntax Python does not know, is always a candidate.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Alternatives = frozenset[frozenset[str]]
#: Nothing is required.
ANY: Alternatives = frozenset([frozenset()])
#: A literal has two characters at least, or is a mark that texts seldom hold; longer ones than WORD need no
#: shorter ones beside them.  With more alternatives than MOST some literals are given up.
LEAST, MARKS, WORD, MOST = 2, "|$<>`~%^{}[]\\", 4, 96
#: Ways to spell a literal whose characters have alternatives, such as either slash.
SPELLINGS = 8


def required(pattern: str, spaces: bool = True) -> Alternatives:
    """The requirement of a pattern over text in lower case, by the ASCII literals in it.  Without `spaces`,
    literals end at white space (for patterns on lines whose white space was normalized)."""
    if re.search(r"\[[^\]]*(?:\[|&&)", re.sub(r"\\.", "", pattern)):  # classes within classes, which Python reads otherwise
        return ANY
    try:
        from re import _parser as parser

        tree = parser.parse(pattern)
    except (ImportError, re.error, OverflowError, RecursionError):
        return ANY
    return _simplified(_sequence(tree, spaces))


def _both(a: Alternatives, b: Alternatives) -> Alternatives:
    if len(a) * len(b) > MOST:  # the one that says more stays
        return max(a, b, key=_strength)
    return frozenset(x | y for x in a for y in b)


def _strength(a: Alternatives) -> int:
    return min((max((len(w) for w in x), default=0) for x in a), default=0)


def _simplified(a: Alternatives) -> Alternatives:
    """Literals within others of their set, short ones beside long ones, and sets that others imply, go."""
    sets = set()
    for x in a:
        words = {w for w in x if len(w) >= WORD} or x
        sets.add(frozenset(w for w in words if not any(w != v and w in v for v in words)))
    return frozenset(x for x in sets if not any(y < x for y in sets))


def _characters(op: object, arg: object, spaces: bool) -> set[str]:
    """The lower-case ASCII characters that a node of one character stands for, if they are few."""
    items = [(op, arg)] if str(op) == "LITERAL" else arg if str(op) == "IN" else []
    if not all(str(k) == "LITERAL" and v < 128 and (spaces or not chr(v).isspace()) for k, v in items):
        return set()
    return {chr(v).lower() for _, v in items} if len(items) <= SPELLINGS else set()


def _sequence(nodes: Iterable, spaces: bool) -> Alternatives:
    out: Alternatives = ANY
    run = {""}

    def close() -> None:
        nonlocal out, run
        if all(len(w) >= LEAST or (w and w in MARKS) for w in run):
            out = _both(out, frozenset(frozenset([w]) for w in run))
        run = {""}

    def grow(characters: set[str]) -> None:
        nonlocal run
        if len(run) * len(characters) > SPELLINGS:
            close()
        run = {w + c for w in run for c in characters}

    for op, arg in nodes:
        kind = str(op)
        if one := _characters(op, arg, spaces):
            grow(one)
            continue
        if kind == "AT":  # of no width, but between lines
            if "BOUNDARY" not in str(arg):
                close()
            continue
        inner = ANY
        if kind == "SUBPATTERN":
            inner = _sequence(arg[3], spaces)
        elif kind == "ATOMIC_GROUP":
            inner = _sequence(arg, spaces)
        elif kind == "BRANCH":
            inner = frozenset(x for branch in arg[1] for x in _sequence(branch, spaces))
            inner = inner if len(inner) <= MOST else ANY
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            if len(arg[2]) == 1 and (one := _characters(*arg[2][0], spaces)):
                grow(one)  # the first of them
            else:
                inner = _sequence(arg[2], spaces)
        close()
        out = _both(out, inner)
    close()
    return out


class Finder:
    """Says which of numbered requirements a text meets, in one pass over it."""

    def __init__(self, requirements: list[Alternatives]) -> None:
        import ahocorasick

        self.always = [i for i, r in enumerate(requirements) if frozenset() in r]
        words = sorted({w for r in requirements for x in r for w in x})
        number = {w: k for k, w in enumerate(words)}
        #: by each set's longest literal: the set and what it stands for
        self.sets: list[list[tuple[frozenset[int], int]]] = [[] for _ in words]
        for i, r in enumerate(requirements):
            for x in r if frozenset() not in r else ():
                self.sets[number[max(x, key=lambda w: (len(w), w))]].append((frozenset(number[w] for w in x), i))
        self.automaton = ahocorasick.Automaton()
        for w, k in number.items():
            self.automaton.add_word(w, k)
        if words:
            self.automaton.make_automaton()
        self.empty = not words

    def found(self, text: str | None) -> list[int]:
        if text is None:
            return []
        if self.empty:
            return self.always
        hits = {k for _, k in self.automaton.iter(text.lower().replace("ſ", "s"))}
        met = set(self.always)
        for k in hits:
            met.update(i for need, i in self.sets[k] if need <= hits)
        return sorted(met)


@lru_cache(maxsize=16)
def finder(requirements: tuple[Alternatives, ...]) -> Finder:
    return Finder(list(requirements))


def met(text: Column, requirements: list[Alternatives]) -> Column:
    """array<int>: the numbers of the requirements that a text meets, ascending; empty for a null text."""
    of = tuple(requirements)

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        f = finder(of)  # a worker builds the automaton once
        return pd.Series([f.found(t) for t in texts], index=texts.index, dtype=object)

    return found(text)


def met_deep(texts: Column, requirements: list[Alternatives]) -> Column:
    """array<array<array<int>>>: the same of each text of an array of arrays."""
    of = tuple(requirements)

    @F.pandas_udf("array<array<array<int>>>")
    def found(rows: pd.Series) -> pd.Series:
        f = finder(of)
        return pd.Series([[[f.found(t) for t in r] for r in file] for file in rows], index=rows.index, dtype=object)

    return found(texts)


def met_all(texts: Column, requirements: list[Alternatives]) -> Column:
    """array<array<int>>: the same of each text of an array."""
    of = tuple(requirements)

    @F.pandas_udf("array<array<int>>")
    def found(rows: pd.Series) -> pd.Series:
        f = finder(of)
        return pd.Series([[f.found(t) for t in r] for r in rows], index=rows.index, dtype=object)

    return found(texts)

"""Boolean trigram queries from regular expressions.

For each part of a regex this module keeps the set of strings it may match, while that set is small (``exact``), and otherwise the
strings that any match begins and ends with, and a query that any match fulfils. Joining parts multiplies exact sets; a part
whose strings are not few turns them into a query: each string needs all of its trigrams, and one of the strings is needed.
A query is None (nothing is mandatory), or a set of clauses, one of which must hold; a clause is a set of trigrams.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser
from dataclasses import dataclass

#: Most strings and most clauses that are followed; beyond them, what is required is weakened, never wrong.
MOST_STRINGS, MOST_CLAUSES = 64, 64

Query = frozenset[frozenset[str]] | None


@dataclass(frozen=True)
class Info:
    """What a part of a regex tells of its matches. exact: all strings, or None; otherwise the possible beginnings and endings."""

    exact: frozenset[str] | None
    first: frozenset[str]
    last: frozenset[str]
    query: Query


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def any_of(strings: frozenset[str]) -> Query:
    """One of the strings occurs; None if one of them is shorter than three."""
    if any(len(s) < 3 for s in strings) or not strings:
        return None
    clauses = {_grams(s) for s in strings}
    clauses = frozenset(x for x in clauses if not any(y < x for y in clauses))
    if len(clauses) > MOST_CLAUSES:
        shared = frozenset.intersection(*clauses)
        return frozenset([shared]) if shared else None
    return clauses


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    clauses = {x | y for x in a for y in b}
    clauses = frozenset(x for x in clauses if not any(y < x for y in clauses))
    return clauses if len(clauses) <= MOST_CLAUSES else min(a, b, key=len)


def either(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return None
    clauses = a | b
    clauses = frozenset(x for x in clauses if not any(y < x for y in clauses))
    return clauses if len(clauses) <= MOST_CLAUSES else None


EMPTY = Info(frozenset([""]), frozenset([""]), frozenset([""]), None)
ANYTHING = Info(None, frozenset([""]), frozenset([""]), None)


def _trim(strings: frozenset[str], ends: bool) -> frozenset[str]:
    """Shorter ends of the strings, few enough."""
    for n in (8, 5, 3, 2, 1):
        cut = frozenset(s[-n:] if ends else s[:n] for s in strings)
        if len(cut) <= MOST_STRINGS // 2:
            return cut
    return frozenset([""])


def _loose(x: Info) -> Info:
    """``x`` without its exact strings."""
    if x.exact is None:
        return x
    return Info(None, _trim(x.exact, False), _trim(x.exact, True), any_of(x.exact))


def _then(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        exact = frozenset(x + y for x in a.exact for y in b.exact)
        return Info(exact, exact, exact, None)
    seam = None
    ends, begins = (a.exact or a.last), (b.exact or b.first)
    if len(ends) * len(begins) <= MOST_STRINGS * 4:
        seam = any_of(frozenset(x + y for x in ends for y in begins))
    first = frozenset(x + y for x in a.exact for y in begins) if a.exact is not None and len(a.exact) * len(begins) <= MOST_STRINGS * 4 else _loose(a).first
    last = frozenset(x + y for x in ends for y in b.exact) if b.exact is not None and len(b.exact) * len(ends) <= MOST_STRINGS * 4 else _loose(b).last
    return Info(None, _trim(first, False), _trim(last, True), both(both(_loose(a).query, _loose(b).query), seam))


def _or(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        exact = a.exact | b.exact
        return Info(exact, exact, exact, None)
    a, b = _loose(a), _loose(b)
    return Info(None, _trim(a.first | b.first, False), _trim(a.last | b.last, True), either(a.query, b.query))


def _class(items: list) -> Info:
    chars: set[str] = set()
    for kind, value in items:
        if kind is c.LITERAL:
            chars.add(chr(value).lower())
        elif kind is c.RANGE and value[1] - value[0] < 128:
            chars |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return ANYTHING
        if len(chars) > 12:
            return ANYTHING
    exact = frozenset(chars)
    return Info(exact, exact, exact, None)


def _sequence(tree) -> Info:
    out = EMPTY
    for kind, value in tree:
        out = _then(out, _node(kind, value))
    return out


def _node(kind, value) -> Info:
    if kind is c.LITERAL:
        exact = frozenset([chr(value).lower()])
        return Info(exact, exact, exact, None)
    if kind is c.IN:
        return _class(value)
    if kind is c.SUBPATTERN:
        return _sequence(value[-1])
    if kind is c.ATOMIC_GROUP:
        return _sequence(value)
    if kind is c.BRANCH:
        out, *rest = [_sequence(x) for x in value[1]]
        for x in rest:
            out = _or(out, x)
        return out
    if kind in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        least, most, inner = value
        x = _sequence(inner)
        if (least, most) == (0, 1):
            return _or(EMPTY, x)
        if not least:
            return ANYTHING
        out = EMPTY
        for _ in range(min(least, 3)):
            out = _then(out, x)
        return out if least == most <= 3 else _then(out, ANYTHING)
    if kind in (c.AT, c.ASSERT, c.ASSERT_NOT):
        return EMPTY
    return ANYTHING


def trigram_query(regex: str) -> Query:
    """The query, over trigrams in lower case, that every text with a match of ``regex`` fulfils; None: all texts may match."""
    return _loose(_sequence(parser.parse(regex))).query

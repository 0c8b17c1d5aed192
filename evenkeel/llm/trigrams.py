"""Boolean trigram queries that every match of a regular expression fulfils.

A query is None (no trigram is mandatory: scan everything) or an OR of ANDs: a
list of sets of lower-case trigrams, one of which a matching text has in full.
Literal parts are followed through concatenation, alternation, small character
classes, options and counted repeats as sets of exact strings; where a set would
grow too large, or an unbounded part comes, its trigrams are noted and a new set
is begun.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser

MOST_STRINGS = 64
MOST_CLASS = 8
MOST_CLAUSES = 64

Query = list[frozenset[str]] | None


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    return shortest([x | y for x in a for y in b]) if len(a) * len(b) <= MOST_CLAUSES else min(a, b, key=len)


def shortest(clauses: list[frozenset[str]]) -> Query:
    """Clauses without those that another one implies; None if one is always true."""
    kept: list[frozenset[str]] = []
    for c in sorted(set(clauses), key=lambda c: (len(c), sorted(c))):
        if not c:
            return None
        if not any(k <= c for k in kept):
            kept.append(c)
    return kept


def of_strings(strings: set[str]) -> Query:
    return shortest([grams(s) for s in strings])


def _strings(nodes) -> tuple[set[str] | None, Query]:
    """All strings the nodes match (None: too many) and the query of what they can't be without."""
    held: set[str] | None = {""}
    query: Query = None
    whole = True
    for op, value in nodes:
        exact, inner = _one(op, value)
        query = both(query, inner)
        if exact is not None and held is not None and len(held) * len(exact) <= MOST_STRINGS:
            held = {a + b for a in held for b in exact}
            continue
        whole = False
        query = both(query, of_strings(held) if held else None)
        held = exact if exact is not None else {""}
    if whole:
        return held, query
    return None, both(query, of_strings(held) if held else None)


def _one(op, value) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(value).lower()}, None
    if op is C.IN:
        found: set[str] = set()
        for kind, x in value:
            if kind is C.LITERAL:
                found.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < MOST_CLASS:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (found, None) if len(found) <= MOST_CLASS else (None, None)
    if op is C.SUBPATTERN:
        return _strings(value[-1])
    if op is C.BRANCH:
        parts = [_strings(x) for x in value[1]]
        if all(e is not None for e, _ in parts):
            union = set().union(*(e for e, _ in parts))
            if len(union) <= MOST_STRINGS:
                return union, None
        clauses: list[frozenset[str]] = []
        for exact, query in parts:
            query = both(query, of_strings(exact) if exact is not None else None)
            if query is None:
                return None, None
            clauses += query
        return None, shortest(clauses)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, nodes = value
        exact, query = _strings(nodes)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, None
        if exact is not None and low == high and len(exact) ** low <= MOST_STRINGS:
            held = {""}
            for _ in range(low):
                held = {a + b for a in held for b in exact}
            return held, None
        return None, both(query, of_strings(exact) if exact is not None else None) if low else None
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, None
    return None, None


def query(pattern: str) -> Query:
    """The trigram query of a pattern in the syntax that Java and Python share."""
    exact, found = _strings(parser.parse(pattern))
    return both(found, of_strings(exact) if exact is not None else None)

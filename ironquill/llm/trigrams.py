"""Boolean trigram queries that a regular expression implies."""

from __future__ import annotations

import itertools
from re import _parser

#: More strings than this are not told apart: the query then asks for less, never for more.
_MOST = 64
#: A query: one of these sets of trigrams is in every text that matches. One that holds an empty set asks for nothing.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset({frozenset()})


def trigram_query(pattern: str) -> Query:
    """Trigrams, in lower case, that a text in lower case must hold for ``pattern`` to match it."""
    found, strings = _sequence(list(_parser.parse(pattern)))
    return _simple(_and(found, _of(strings)))


def _of(strings: set[str]) -> Query:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings) or ANYTHING


def _and(a: Query, b: Query) -> Query:
    if len(a) * len(b) > _MOST:
        return a if len(a) <= len(b) else b
    return frozenset(x | y for x, y in itertools.product(a, b))


def _simple(query: Query) -> Query:
    """Without sets that hold another: whoever has the larger one has the smaller."""
    return frozenset(x for x in query if not any(y < x for y in query))


def _sequence(items: list) -> tuple[Query, set[str]]:
    """What the items imply up to the last unknown part, and the strings that may follow it."""
    query, strings = ANYTHING, {""}
    for item in items:
        exact, implied = _exact(item), None
        if exact is None:
            implied = _implied(item)
        elif len(strings) * len(exact) <= _MOST:
            strings = {a + b for a in strings for b in exact}
            continue
        else:
            implied = _of(exact)
        query, strings = _and(_and(query, _of(strings)), implied), {""}
    return query, strings


def _exact(item: tuple) -> set[str] | None:
    """All strings that the item matches, if they are few."""
    kind, what = str(item[0]), item[1]
    if kind == "LITERAL":
        return {chr(what).lower()}
    if kind == "AT":
        return {""}
    if kind == "IN":
        if not all(str(k) == "LITERAL" for k, _ in what) or len(what) > 8:
            return None
        return {chr(c).lower() for _, c in what}
    if kind == "SUBPATTERN":
        return _exact_all(list(what[3]))
    if kind == "BRANCH":
        parts = [_exact_all(list(x)) for x in what[1]]
        return None if None in parts or len(out := set().union(*parts)) > _MOST else out
    if kind == "MAX_REPEAT" and what[1] <= 2:
        one = _exact_all(list(what[2]))
        return None if one is None else {"".join(p) for n in range(what[0], what[1] + 1) for p in itertools.product(one, repeat=n)}
    return None


def _exact_all(items: list) -> set[str] | None:
    out = {""}
    for item in items:
        exact = _exact(item)
        if exact is None or len(out) * len(exact) > _MOST:
            return None
        out = {a + b for a in out for b in exact}
    return out


def _implied(item: tuple) -> Query:
    kind, what = str(item[0]), item[1]
    if kind == "SUBPATTERN":
        query, strings = _sequence(list(what[3]))
        return _and(query, _of(strings))
    if kind == "BRANCH":
        parts = [_and(q, _of(s)) for q, s in (_sequence(list(x)) for x in what[1])]
        out = frozenset().union(*parts)
        return out if len(out) <= _MOST else ANYTHING
    if kind == "MAX_REPEAT" and what[0] >= 1:
        query, strings = _sequence(list(what[2]))
        return _and(query, _of(strings))
    return ANYTHING

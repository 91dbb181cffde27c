"""Boolean trigram queries from regular expressions.

A query is a disjunction of sets of trigrams: a text can match the pattern only if it holds all trigrams of one of the
sets. Text and trigrams are compared in lower case, so that one index serves patterns of either case. An empty
disjunction never occurs; a pattern without mandatory trigrams has the query `None` and must be scanned fully.
"""

from __future__ import annotations

import re
from itertools import product

#: Strings followed side by side, and sets kept in one query; beyond them a query is weakened, never wrong.
MOST_STRINGS, MOST_SETS = 64, 64
#: A character class of at most this many characters is followed character by character.
MOST_CHARS = 8

Query = frozenset[frozenset[str]] | None


def _least(sets) -> frozenset[frozenset[str]]:
    """Without sets that contain another one."""
    return frozenset(s for s in sets if not any(o < s for o in sets))


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    joined = _least({x | y for x, y in product(a, b)})
    return joined if len(joined) <= MOST_SETS else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    """What holding one of the strings demands."""
    if any(len(s) < 3 for s in strings):
        return None
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _characters(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            out.add(chr(value).lower())
        elif str(op) == "RANGE" and value[1] - value[0] < MOST_CHARS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARS else None


def _read(tree) -> tuple[set[str] | None, Query]:
    """(all strings the pattern stands for, if they are few; what it demands)."""
    strings: set[str] = {""}  # what the pattern so far ends in, exactly
    exact, query = True, None
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            found, demand = {chr(value).lower()}, None
        elif name == "IN":
            found, demand = _characters(value), None
        elif name == "SUBPATTERN":
            found, demand = _read(value[3])
        elif name == "BRANCH":
            parts = [_read(p) for p in value[1]]
            found = set().union(*[s for s, _ in parts]) if all(s is not None for s, _ in parts) else None
            demands = [q if s is None else _of_strings(s) for s, q in parts]
            demand = None if any(d is None for d in demands) else _least(frozenset().union(*demands))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            found, demand = _read(inner)
            if low == 0:
                found, demand = (found | {""} if found is not None and high == 1 else None), None
            elif low == high and found is not None and len(found) ** low <= MOST_STRINGS:
                found = {"".join(p) for p in product(found, repeat=low)}
            elif found is not None:
                demand, found = _of_strings(found), None
        elif name == "AT":
            found, demand = {""}, None
        else:  # anything else: no demand
            found, demand = None, None
        if found is not None and len(found) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, found)}
            continue
        query = _and(query, _of_strings(strings))
        query = _and(query, demand if found is None else _of_strings(found))
        strings, exact = {""}, False
    return (strings if exact else None), _and(query, None if exact else _of_strings(strings))


def trigram_query(pattern: str) -> Query:
    """The weakest demand that every match of the pattern meets, as far as it is followed."""
    strings, query = _read(re._parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query

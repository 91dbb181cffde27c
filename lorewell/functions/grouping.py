"""Grouping of statements by shared vocabulary, and a title and summary line per group.

Row-local: one document's statements are one array, bounded by the routing rule (longer texts are split by
structure instead). A caller with a language model can replace either step by a pandas UDF of the same shape.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from itertools import chain

from pyspark.sql import Column

from lorewell.functions.rows import by_row

_WORD = re.compile(r"\w+")
DESCRIPTION = "array<struct<title:string,summary:string>>"


def term_counts(statements: list[str]) -> list[Counter]:
    """Word counts of each statement."""
    find = _WORD.findall
    return [Counter(find(s.lower())) for s in statements]


def assign_groups(counts: list[Counter], threshold: float = 0.25) -> list[int]:
    """Group number of each statement, in order, from the statements' word counts.

    A statement joins the group whose summed counts are nearest by cosine, if that reaches the threshold
    (ties: the older group); otherwise it opens a new group.
    """
    owners: dict[str, dict[int, int]] = {}  # term -> {group: count}
    squares: list[int] = []  # squared length of each group's counts
    numbers: list[int] = []
    for terms in counts:
        length = 0
        dots: dict[int, int] = {}
        held_by = []
        for term, n in terms.items():
            length += n * n
            held = owners.get(term)
            if held is None:
                held = owners[term] = {}
            else:
                for group, count in held.items():
                    dots[group] = dots.get(group, 0) + n * count
            held_by.append((held, n))
        chosen, best = -1, 0.0
        for group, dot in dots.items():
            score = round(dot / math.sqrt(length * squares[group]), 9)
            if score >= threshold and (score > best or (score == best and group < chosen)):
                chosen, best = group, score
        if chosen < 0:
            chosen = len(squares)
            squares.append(0)
        squares[chosen] += length + 2 * dots.get(chosen, 0)
        for held, n in held_by:
            held[chosen] = held.get(chosen, 0) + n
        numbers.append(chosen)
    return numbers


def describe(
    groups: list[list[str]], counts: list[list[Counter]], no_title: str, no_summary: str, title_terms: int = 3
) -> list[dict]:
    """Title: the terms with the highest tf-idf among the groups. Summary: the statement nearest the group."""
    totals = []
    for parts in counts:
        total: Counter = parts[0]  # most groups are one statement
        if len(parts) > 1:
            total = Counter()
            for part in parts:
                total.update(part)
        totals.append(total)
    spread = Counter(chain.from_iterable(totals))
    rarity = {n: math.log(1 + len(groups) / n) for n in set(spread.values())}
    once = {n: -round(weight, 9) for n, weight in rarity.items()}
    described = []
    for statements, parts, total in zip(groups, counts, totals):
        weighted = [(once[spread[t]] if n == 1 else -round(n * rarity[spread[t]], 9), t) for t, n in total.items()]
        best = sorted(weighted)[:title_terms] if len(weighted) < 64 else heapq.nsmallest(title_terms, weighted)
        title = " ".join(t for _, t in best)
        if len(statements) == 1:
            summary = statements[0]
        else:
            summary, top = no_summary, -1.0
            for statement, part in zip(statements, parts):
                length = math.sqrt(sum([n * n for n in part.values()]))
                near = round(sum([n * total[t] for t, n in part.items()]) / length, 9) if length else 0.0
                if near > top:
                    summary, top = statement, near
        described.append({"title": title or no_title, "summary": summary})
    return described


def group_numbers(statements: Column, threshold: float = 0.25) -> Column:
    """ARRAY<INT>: the group of each element of an ARRAY<STRING>."""

    return by_row(lambda r: None if r is None else assign_groups(term_counts(r), threshold), "array<int>", statements)


def describe_groups(groups: Column, no_title: str, no_summary: str) -> Column:
    """ARRAY<STRUCT<title, summary>> for an ARRAY<ARRAY<STRING>> of one document's groups."""

    def described(row: list[list[str]] | None) -> list[dict] | None:
        return None if row is None else describe(row, [term_counts(g) for g in row], no_title, no_summary)

    return by_row(described, DESCRIPTION, groups)

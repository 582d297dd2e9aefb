"""Boolean trigram queries from regular expressions.

A query is a conjunction of clauses; a clause is a list of alternatives; an alternative is a list of
trigrams that must all occur. Every text that the expression matches satisfies the query; an
expression from which no trigram follows gives no clause.
"""

from __future__ import annotations

from re import _parser as parser
from re import _constants as ops

#: Strings that are followed side by side, and members of a character class that are spelled out.
MOST_STRINGS, MOST_MEMBERS = 64, 8

Clause = list[list[str]]


def _class(members: list) -> set[str] | None:
    """The characters of a small class in lower case, None for a large or negated one."""
    out: set[str] = set()
    for op, value in members:
        if op is ops.LITERAL:
            out.add(chr(value).lower())
        elif op is ops.RANGE and value[1] - value[0] < MOST_MEMBERS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_MEMBERS else None


def _strings(nodes) -> set[str] | None:
    """All strings, in lower case, that the nodes match, if they are few."""
    found = {""}
    for op, value in nodes:
        if op is ops.LITERAL:
            more = {chr(value).lower()}
        elif op is ops.IN:
            more = _class(value)
        elif op is ops.SUBPATTERN:
            more = _strings(value[-1])
        elif op is ops.BRANCH:
            parts = [_strings(x) for x in value[1]]
            more = None if None in parts else set().union(*parts)
        elif op is ops.MAX_REPEAT and value[1] <= 2:
            once = _strings(value[2])
            more = once and {x for n in range(value[0], value[1] + 1) for x in ({""}, once, {a + b for a in once for b in once})[n]}
        else:
            more = None
        if more is None:
            return None
        found = {a + b for a in found for b in more}
        if len(found) > MOST_STRINGS:
            return None
    return found


def _clause(strings: set[str]) -> list[Clause]:
    """What it means that one of the strings occurs; nothing if one of them is too short to tell."""
    if any(len(s) < 3 for s in strings):
        return []
    sets = [{s[k : k + 3] for k in range(len(s) - 2)} for s in sorted(strings)]
    # an alternative that asks for more than another adds nothing
    return [[sorted(x) for k, x in enumerate(sets) if not any(y < x or y == x and j < k for j, y in enumerate(sets))]]


def trigram_query(pattern: str) -> list[Clause]:
    """The query for texts in lower case."""
    clauses: list[Clause] = []
    run = {""}

    def walk(nodes) -> None:
        nonlocal run
        for node in nodes:
            op, value = node
            few = _strings([node])
            if few is not None and len(run) * len(few) <= MOST_STRINGS:
                run = {a + b for a in run for b in few}
                continue
            clauses.extend(_clause(run))
            run = few if few is not None else {""}
            if few is None and op is ops.SUBPATTERN:
                walk(value[-1])
            elif few is None and op is ops.MAX_REPEAT and value[0] >= 1:
                walk(value[2])
                clauses.extend(_clause(run))
                run = {""}

    walk(parser.parse(pattern))
    clauses.extend(_clause(run))
    return clauses

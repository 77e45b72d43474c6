"""Boolean trigram queries from regular expressions: what any matching text must hold.

A query is a set of clauses, a clause a set of trigrams: a text may match only if it holds all trigrams
of some clause. Concatenation joins clauses, alternation collects them, and what is optional asks for
nothing. As long as a part of a pattern stands for few strings, these are followed exactly, so that
trigrams over the borders of parts count too. Trigrams are folded to lower case.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as K
from re import _parser as parser

Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])
#: More strings, or more clauses, than this are no longer followed: the query then asks for less.
MOST_STRINGS, MOST_CLAUSES, WIDEST_CLASS = 48, 64, 16


@dataclass(frozen=True)
class Part:
    """What a part of a pattern matches: exactly ``strings``, or else anything that begins, ends and holds as said."""

    strings: frozenset[str] | None
    starts: frozenset[str] = frozenset([""])
    ends: frozenset[str] = frozenset([""])
    holds: Query = ALWAYS


NOTHING = Part(frozenset([""]))
ANYTHING = Part(None)


def least(query: Query) -> Query:
    """Without clauses that another one's trigrams already admit."""
    if len(query) > MOST_CLAUSES:
        return ALWAYS
    return frozenset(c for c in query if not any(o < c for o in query))


def both(a: Query, b: Query) -> Query:
    return least(frozenset(x | y for x in a for y in b))


def of_strings(strings: frozenset[str]) -> Query:
    """One clause for each string: all its trigrams."""
    return least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def loose(p: Part) -> Part:
    """The part without its exact strings: how they begin and end, and what they hold."""
    if p.strings is None:
        return p
    return Part(None, frozenset(s[:2] for s in p.strings), frozenset(s[-2:] for s in p.strings), of_strings(p.strings))


def after(a: Part, b: Part) -> Part:
    """``b`` follows ``a``."""
    if a.strings is not None and b.strings is not None and len(a.strings) * len(b.strings) <= MOST_STRINGS:
        return Part(frozenset(x + y for x in a.strings for y in b.strings))
    x, y = loose(a), loose(b)
    over = frozenset(e + s for e in x.ends for s in y.starts)
    border = of_strings(over) if len(over) <= MOST_STRINGS else ALWAYS
    # a part that is short as a whole lets its neighbour's strings through
    starts = frozenset((s + t)[:2] for s in a.strings for t in y.starts) if a.strings is not None and min(map(len, a.strings)) < 2 else x.starts
    ends = frozenset((e + t)[-2:] for e in x.ends for t in b.strings) if b.strings is not None and min(map(len, b.strings)) < 2 else y.ends
    return Part(None, starts, ends, both(both(x.holds, y.holds), border))


def either(parts: list[Part]) -> Part:
    if all(p.strings is not None for p in parts):
        strings = frozenset().union(*[p.strings for p in parts])
        if len(strings) <= MOST_STRINGS:
            return Part(strings)
    some = [loose(p) for p in parts]
    return Part(None, frozenset().union(*[p.starts for p in some]), frozenset().union(*[p.ends for p in some]), least(frozenset().union(*[p.holds for p in some])))


def _class(items: list) -> Part:
    found: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            found.add(chr(value).lower())
        elif op is K.RANGE and value[1] - value[0] < 64:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return ANYTHING
    return Part(frozenset(found)) if len(found) <= WIDEST_CLASS else ANYTHING


def _part(nodes) -> Part:
    out = NOTHING
    for op, value in nodes:
        if op is K.LITERAL:
            p = Part(frozenset([chr(value).lower()]))
        elif op is K.IN:
            p = _class(value)
        elif op is K.BRANCH:
            p = either([_part(x) for x in value[1]])
        elif op is K.SUBPATTERN:
            p = _part(value[-1])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            lo, hi, inner = value
            once = _part(inner)
            p = NOTHING
            for _ in range(min(lo, 3)):
                p = after(p, once)
            if hi == 1 and lo == 0:
                p = either([NOTHING, once])
            elif hi != lo or lo > 3:
                p = after(p, ANYTHING)
                if lo:  # it ends as it ends once
                    p = Part(None, p.starts, loose(once).ends, p.holds)
        elif op is K.ATOMIC_GROUP:
            p = _part(value)
        elif op is K.AT or op in (K.ASSERT, K.ASSERT_NOT):
            p = NOTHING
        else:  # any character, classes by negation, back references
            p = ANYTHING
        out = after(out, p)
    return out


def trigram_clauses(pattern: str) -> Query:
    """The query of ``pattern``; ``ALWAYS`` where a match need not hold any trigram."""
    return loose(_part(parser.parse(pattern))).holds


def admits(query: Query, text: str) -> bool:
    """Whether a text with these characters may match."""
    low = text.lower()
    return any(all(t in low for t in clause) for clause in query)

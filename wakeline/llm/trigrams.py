"""From a regular expression to the Boolean trigram query that every match satisfies.

A query is a disjunction of conjunctions: a frozenset of frozensets of lower-cased trigrams. ``ALL`` (one empty
conjunction) is satisfied by every text: such a rule has no mandatory trigrams and has to scan.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

ALL = frozenset([frozenset()])
#: Bounds of what is expanded: characters of a class, strings of an exact set, clauses of a query. Beyond them the
#: query gets weaker (more candidates), never wrong.
MAX_CLASS, MAX_EXACT, MAX_CLAUSES = 8, 64, 64


def _least(clauses: set) -> frozenset:
    """Without the clauses that another one implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def either(a: frozenset, b: frozenset) -> frozenset:
    out = _least(a | b)
    return out if len(out) <= MAX_CLAUSES else ALL


def both(a: frozenset, b: frozenset) -> frozenset:
    out = _least({x | y for x in a for y in b})
    return out if len(out) <= MAX_CLAUSES else min(a, b, key=len)


def of_strings(strings: set[str]) -> frozenset:
    """Texts that hold one of the strings."""
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _chars(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 4 * MAX_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_CLASS else None


def _walk(tree) -> tuple[set[str] | None, frozenset]:
    """The strings that the tree matches, if they are few, and else None; the query of what lies outside them."""
    exact: set[str] | None = {""}
    query, whole = ALL, True

    def flush(now):
        nonlocal query
        query = both(query, of_strings(now))

    for op, arg in tree:
        one, sub = None, ALL
        if op is C.LITERAL:
            one = {chr(arg).lower()}
        elif op is C.IN:
            one = _chars(arg)
        elif op is C.SUBPATTERN:
            one, sub = _walk(arg[-1])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                one = set().union(*(e for e, _ in parts))
            else:
                each = [both(q, of_strings(e)) if e is not None else q for e, q in parts]
                sub = each[0]
                for q in each[1:]:
                    sub = either(sub, q)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            e, q = _walk(body)
            if (low, high) == (0, 1) and e is not None:
                one = e | {""}
            elif low == high == 1:
                one, sub = e, q
            elif low:
                if e is not None and len(e) == 1 and low == high and low <= 8:
                    one = {next(iter(e)) * low}
                elif e is not None and len(e) == 1:
                    sub = of_strings({next(iter(e)) * min(low, 8)})
                else:
                    sub = both(q, of_strings(e)) if e is not None else q
        elif op is C.AT:
            one = {""}
        if one is not None and sub == ALL and len(exact) * len(one) <= MAX_EXACT:
            exact = {a + b for a in exact for b in one}
        else:
            flush(exact)
            whole = False
            if one is not None:
                exact = one if len(one) <= MAX_EXACT else {""}
            else:
                exact = {""}
            query = both(query, sub)
    if whole:
        return exact, ALL
    flush(exact)
    return None, query


def query(pattern: str) -> frozenset:
    exact, q = _walk(_parser.parse(pattern))
    return both(q, of_strings(exact)) if exact is not None else q


#: Letters from frequent to rare in running text (fixed values); whatever else stands in a trigram counts as rarer.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"


def asked(pattern: str, per_clause: int = 2) -> frozenset:
    """The query with at most so many trigrams in a clause, those of the rarest characters: still satisfied by every match,
    with a short vocabulary to look for and to index."""
    rarity = lambda t: sum(LETTERS.index(c) if c in LETTERS else len(LETTERS) for c in t)
    return _least({frozenset(sorted(clause, key=lambda t: (-rarity(t), t))[:per_clause]) for clause in query(pattern)})

"""Boolean trigram queries derived from regular expressions.

A query is a set of alternatives, each a set of trigrams: a text can match only if, for one alternative, it holds every
trigram of it. None stands for a regex without mandatory trigrams, which any text may match. Trigrams are of ASCII lower
case, so that one index serves case-sensitive and case-insensitive rules alike.
"""

from __future__ import annotations

try:  # the standard library's regex parser, by its names since and before Python 3.11
    from re import _constants as C
    from re import _parser as parser
except ImportError:
    import sre_constants as C
    import sre_parse as parser

Query = frozenset[frozenset[str]] | None

#: Alternatives and exact strings beyond these numbers are summed up by their trigrams.
_MOST = 64


def _trigrams(strings: set[str]) -> Query:
    """The query of a regex that matches exactly one of these strings."""
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return None if not sets or not all(sets) else frozenset(sets)


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    out = frozenset(x | y for x in a for y in b)
    return out if len(out) <= _MOST else a


def either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else a | b


def _chars(items) -> set[str] | None:
    """The lower-cased characters of a class if they are few and ASCII."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(x) for x in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(out) > 8:
            return None
    return {x.lower() for x in out} if all(x.isascii() for x in out) else None


def _walk(tree) -> tuple[Query, set[str] | None]:
    """(query, exact): exact has every string that this piece matches, lower-cased, or is None if they are many."""
    query: Query = None
    run: set[str] = {""}

    def ended(run: set[str], query: Query) -> Query:
        return both(query, _trigrams(run))

    whole = True
    for op, arg in tree:
        exact: set[str] | None = None
        own: Query = None
        if op is C.LITERAL:
            exact = {chr(arg).lower()} if arg < 128 else None
        elif op is C.IN:
            exact = _chars(arg)
        elif op is C.SUBPATTERN:
            own, exact = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            own = parts[0][0]
            for q, _ in parts[1:]:
                own = either(own, q)
            exact = set().union(*(e for _, e in parts)) if all(e is not None for _, e in parts) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, body = arg
            q, e = _walk(body)
            own = q if least else None
            exact = {""} | e if (least, most) == (0, 1) and e is not None else None
            if exact is None and least and e is not None and len(e) ** min(least, 3) <= _MOST:  # the first repeats are certain
                first = {""}
                for _ in range(min(least, 3)):
                    first = {x + y for x in first for y in e}
                query = ended({x + y for x in run for y in first}, query)
                run, whole = {""}, False
                continue
        elif op is C.AT:
            continue
        if exact is not None and len(run) * len(exact) <= _MOST:
            run = {x + y for x in run for y in exact}
            continue
        query = both(ended(run, query), own)
        run, whole = {""}, False
    return ended(run, query), (run if whole else None)


def query_of(pattern: str, flags: int = 0) -> Query:
    """The Boolean trigram query of a regex: OR of ANDs, or None if no trigram is mandatory."""
    return _walk(parser.parse(pattern, flags))[0]

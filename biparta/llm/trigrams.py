"""Boolean trigram queries from regular expressions.

A query is a list of clauses, all of which must hold; a clause is a list of
alternatives, one of which must hold; an alternative is a set of trigrams that must all
occur in the lower-cased text. An empty list means that nothing is mandatory.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

Clause = list[frozenset[str]]
# Literal strings that are followed at once through alternatives and optional parts.
MAX_STRINGS = 24


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


class _Walk:
    """The strings that may end at the current place, and the clauses gathered so far."""

    def __init__(self) -> None:
        self.strings: set[str] = {""}
        self.clauses: list[Clause] = []

    def flush(self) -> None:
        alternatives = [trigrams(s) for s in sorted(self.strings)]
        if all(alternatives) and alternatives not in self.clauses:
            self.clauses.append(alternatives)
        self.strings = {""}

    def extend(self, options: set[str] | None) -> None:
        """Append one of the options; None stands for text that is not known."""
        if options is None:
            self.flush()
        elif len(self.strings) * len(options) <= MAX_STRINGS:
            self.strings = {a + b for a in self.strings for b in options}
        else:
            self.flush()
            self.strings = options if len(options) <= MAX_STRINGS else {""}


def _class_chars(items: list) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            out.add(chr(value).lower())
        elif kind is C.RANGE:
            out |= {chr(c).lower() for c in range(value[0], min(value[1], value[0] + 255) + 1)}
        else:
            return None
    return out


def _known(nodes) -> set[str] | None:
    """All strings that a part can match, if they are few."""
    walk = _Walk()
    for kind, value in nodes:
        options: set[str] | None = None
        if kind is C.LITERAL:
            options = {chr(value).lower()}
        elif kind is C.IN:
            options = _class_chars(value)
        elif kind is C.SUBPATTERN:
            options = _known(value[3])
        elif kind is C.BRANCH:
            parts = [_known(p) for p in value[1]]
            options = None if any(p is None for p in parts) else set().union(*parts)
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[1] == 1:
            inside = _known(value[2])
            options = None if inside is None else inside | ({""} if value[0] == 0 else set())
        elif kind is C.AT:
            options = {""}
        if options is None or len(walk.strings) * len(options) > MAX_STRINGS:
            return None
        walk.strings = {a + b for a in walk.strings for b in options}
    return walk.strings


def _gather(nodes, walk: _Walk) -> None:
    for node in nodes:
        kind, value = node
        known = _known([node])
        if known is not None:
            walk.extend(known)
        elif kind is C.SUBPATTERN:
            _gather(value[3], walk)
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
            # once at least; what follows the last repetition is not known
            for _ in range(min(value[0], 8)):
                _gather(value[2], walk)
            walk.flush()
        else:
            walk.flush()


def trigram_query(regex: str) -> list[Clause]:
    walk = _Walk()
    _gather(_parser.parse(regex), walk)
    walk.flush()
    return walk.clauses


def vocabulary(queries: list[list[Clause]]) -> list[str]:
    return sorted({t for q in queries for c in q for a in c for t in a})

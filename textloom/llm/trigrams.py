"""Boolean trigram queries from regular expressions.

A query is kept as alternatives of trigram sets: a text can match only if it
holds all trigrams of some alternative. A rule with no mandatory trigram gives
None. Trigrams are of lower-cased text (A-Z), so that one index serves rules of
either case.

Of an expression only what bears on mandatory characters is read: literals, small
classes, groups, alternatives and how often things repeat. All else stands for
"anything", which asks for no trigram and so loses no match.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Longest list of strings that a piece of a pattern may stand for exactly, before it is taken as "anything".
MAX_STRINGS = 32
#: Largest class that is read as alternatives.
MAX_CLASS = 8

Alternatives = frozenset[frozenset[str]]
ANY: Alternatives = frozenset([frozenset()])


class Piece(NamedTuple):
    """`strings`: all that the piece can match, if they are few; `query`: what any match of it must hold."""

    strings: tuple[str, ...] | None
    query: Alternatives


ANYTHING = Piece(None, ANY)
NOTHING = Piece(("",), ANY)
_escape = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", re.DOTALL)
_count = re.compile(r"([*+?])|\{(\d+)(,?)(\d*)\}")
_group = re.compile(r"\((?:\?(?:(<?[=!])|P?<[a-zA-Z]\w*>|>|([a-z-]*)([:)])))?")
#: Escapes of one character, of no character at a place, and of classes.
CHARACTERS = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "a": "\a", "e": "\x1b"}
PLACES = frozenset("bBAZzG")


def _low(c: str) -> str:
    return c.lower() if c < "\x80" else c


def _of(string: str) -> frozenset[str]:
    return frozenset(string[i : i + 3] for i in range(len(string) - 2))


def _either(a: Alternatives, b: Alternatives) -> Alternatives:
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _both(a: Alternatives, b: Alternatives) -> Alternatives:
    out = frozenset(x | y for x in a for y in b)
    return out if len(out) <= MAX_STRINGS else min(a, b, key=len)


def _literal(strings: set[str]) -> Piece:
    query: Alternatives = frozenset()
    for s in strings:
        query = _either(query, frozenset([_of(s)]))
    return Piece(tuple(sorted(strings)), query)


def _sequence(pieces: list[Piece]) -> Piece:
    """One piece after another; neighbours whose strings are few make longer strings."""
    query, run, exact = ANY, ("",), True
    for p in pieces:
        if p.strings is not None and len(run) * len(p.strings) <= MAX_STRINGS and (exact or "" not in p.strings):
            run = tuple(a + b for a in run for b in p.strings)
            continue
        query, exact = _both(query, _literal(set(run)).query), False
        if p.strings is not None and "" not in p.strings:
            run = p.strings
        else:
            query, run = _both(query, p.query), ("",)
    found = _literal(set(run))
    return found if exact else Piece(None, _both(query, found.query))


def _alternatives(pieces: list[Piece]) -> Piece:
    query: Alternatives = frozenset()
    for p in pieces:
        query = _either(query, p.query)
    strings = {s for p in pieces for s in p.strings or ()}
    few = all(p.strings is not None for p in pieces) and len(strings) <= MAX_STRINGS
    return Piece(tuple(sorted(strings)) if few else None, query)


def _repeated(p: Piece, least: int, most: int | None) -> Piece:
    if (least, most) == (0, 1):
        return Piece(None if p.strings is None else ("", *(s for s in p.strings if s)), ANY)
    if least == 0:
        return ANYTHING
    if least == most == 1:
        return p
    return Piece(None, p.query)


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def take(self, expression: re.Pattern) -> re.Match | None:
        m = expression.match(self.pattern, self.at)
        self.at = m.end() if m else self.at
        return m

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def alternatives(self) -> Piece:
        branches: list[list[Piece]] = [[]]
        while self.peek() not in ("", ")"):
            if self.peek() == "|":
                self.at += 1
                branches.append([])
                continue
            piece = self.atom()
            while m := self.take(_count):
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[1]] if m[1] else (int(m[2]), int(m[4]) if m[4] else None if m[3] else int(m[2]))
                piece = _repeated(piece, least, most)
                if self.peek() in ("?", "+"):  # as few, or as many, as can be
                    self.at += 1
            branches[-1].append(piece)
        return _alternatives([_sequence(b) for b in branches])

    def atom(self) -> Piece:
        if m := self.take(_group):
            if m[3] == ")":  # flags for the rest
                return NOTHING
            inside = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"unbalanced group in {self.pattern}")
            self.at += 1
            return NOTHING if m[1] else inside
        c = self.peek()
        if c == "[":
            return self.character_class()
        if c == "\\":
            return self.escaped() or ANYTHING
        self.at += 1
        return ANYTHING if c == "." else NOTHING if c in "^$" else _literal({_low(c)})

    def escaped(self) -> Piece | None:
        """A character, a place, or None for a class."""
        m = self.take(_escape)
        if m is None:
            raise ValueError(f"unfinished escape in {self.pattern}")
        if m[1] or m[2]:
            return _literal({_low(chr(int(m[1] or m[2], 16)))})
        if m[3] in PLACES:
            return NOTHING
        if m[3] in CHARACTERS:
            return _literal({CHARACTERS[m[3]]})
        return None if m[3].isalnum() else _literal({_low(m[3])})

    def character_class(self) -> Piece:
        self.at += 1
        few, first, found = self.peek() != "^", True, set()
        self.at += not few
        while first or self.peek() != "]":
            c = self.peek()
            if not c:
                raise ValueError(f"unfinished class in {self.pattern}")
            if c == "\\":
                one = self.escaped()
                found |= set(one.strings if one else ())
                few = few and one is not None and one is not NOTHING
            else:
                self.at += 1
                # ranges, and classes in classes
                few = few and c != "[" and not (c == "-" and not first and self.peek() != "]") and not (c == "&" and self.peek() == "&")
                found.add(_low(c))
            first = False
        self.at += 1
        return _literal(found) if few and len(found) <= MAX_CLASS else ANYTHING


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Sorted alternatives, each a sorted list of trigrams; None if some match needs no trigram."""
    if re.search(r"\\[QEpPk0-9cN]|\(\?[a-wyz-]*x", pattern):
        return None  # quotes, references and free spacing: not read
    reader = _Reader(pattern)
    found = reader.alternatives()
    if reader.at != len(pattern):
        raise ValueError(f"unbalanced group in {pattern}")
    if any(not x for x in found.query):
        return None
    return sorted(sorted(x) for x in found.query)


#: Letters from frequent to rare in prose, the blank first.
FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"


def rarest_first(trigrams: list[str]) -> list[str]:
    """The trigrams by how rare they are in prose, by their characters; those with other characters first."""
    rank = lambda t: sum(len(FREQUENT) + 1 if c not in FREQUENT else FREQUENT.index(c) for c in t)
    return sorted(trigrams, key=lambda t: (-rank(t), t))

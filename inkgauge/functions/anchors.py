"""Literals that every match of a regular expression must hold: a search for them is far cheaper than one for the expression.

Only what the expression surely demands is read: runs of literal characters, groups and small classes, put together up to MOST strings.
Whatever may be absent, repeated or anything at all ends a run. Long strings are cut to LONGEST characters, of which fewer differ.
"""

from __future__ import annotations

from functools import cache

SHORTEST, MOST, LONGEST = 3, 24, 12
#: Letters outside ASCII that match ASCII ones where case is ignored, as far as lower-casing doesn't make them ASCII.
ODD = "ſı̇"


class _Reader:
    def __init__(self, regex: str) -> None:
        self.regex, self.at = regex, 0

    def peek(self) -> str:
        return self.regex[self.at : self.at + 1]

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.regex[self.at - n : self.at]

    def alternatives(self) -> list[list[tuple]]:
        """Sequences of (what, literals or None where unknown or nested alternatives, whether it must be there once exactly)."""
        out: list[list[tuple]] = [[]]
        while self.peek() not in ("", ")"):
            if self.peek() == "|":
                self.take()
                out.append([])
                continue
            item = self.item()
            least, most = self.quantifier()
            if item is not None:
                out[-1].append((*item, least, most))
        return out

    def item(self) -> tuple | None:
        """A literal set ("set"), nested alternatives ("group"), anything ("any"), or None for what has no width."""
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.class_()
        if c in "^$":
            return None
        if c == ".":
            return ("any", None)
        if c == "\\":
            e = self.take()
            if e in "bBAzZ":
                return None
            if e == "x" and self.peek() == "{":
                self.at = self.regex.index("}", self.at) + 1
                return ("any", None)
            return ("any", None) if e.isalnum() else ("set", (e,))
        return ("set", (c.lower(),))

    def group(self) -> tuple | None:
        wide = True
        if self.peek() == "?":
            for head, width in (("?:", True), ("?=", False), ("?!", False), ("?<=", False), ("?<!", False)):
                if self.regex.startswith(head, self.at):
                    self.take(len(head))
                    wide = width
                    break
            else:  # flags
                self.at = self.regex.index(")", self.at) + 1
                return None
        inner = self.alternatives()
        self.take()  # )
        return ("group", inner) if wide else None

    def class_(self) -> tuple:
        start = self.at
        if self.peek() == "^":
            self.take()
        if self.peek() == "]":
            self.take()
        while self.peek() != "]":
            self.take(2 if self.peek() == "\\" else 1)
        body = self.regex[start : self.at]
        self.take()
        simple = len(body) <= 4 and body[0] != "^" and not set(body) & set("\\[]") and "-" not in body[1:-1]
        return ("set", tuple(sorted({c.lower() for c in body}))) if simple else ("any", None)

    def quantifier(self) -> tuple[int, int | None]:
        c, bounds = self.peek(), (1, 1)
        if c and c in "?*+":
            self.take()
            bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        elif c == "{":
            end = self.regex.index("}", self.at)
            low, _, high = self.regex[self.at + 1 : end].partition(",")
            self.at = end + 1
            bounds = (int(low or 0), int(high) if high else None)
        else:
            return bounds
        if self.peek() in ("?", "+"):
            self.take()
        return bounds


def _exact(item: tuple) -> tuple[str, ...] | None:
    """All strings that an item matches, if they are few and it is there once."""
    kind, value, least, most = item
    if (least, most) != (1, 1) or kind == "any":
        return None
    if kind == "set":
        return value
    out: set[str] = set()
    for sequence in value:
        strings = {""}
        for x in sequence:
            more = _exact(x)
            if more is None or len(strings) * len(more) > MOST:
                return None
            strings = {a + b for a in strings for b in more}
        out |= strings
    return tuple(sorted(out)) if len(out) <= MOST else None


def _best(sequence: list[tuple]) -> frozenset[str] | None:
    """Of the literal sets that a sequence demands the one whose shortest string is longest."""
    found: list[frozenset[str]] = []
    run: set[str] = {""}
    for item in sequence:
        exact = _exact(item)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        found.append(frozenset(run))
        run = {""} if exact is None else set(exact)
        if exact is None and item[0] == "group" and item[2] >= 1:
            inner = [_best(s) for s in item[1]]
            if None not in inner:
                found.append(frozenset().union(*inner))
    found.append(frozenset(run))
    usable = [f for f in found if min(map(len, f)) >= SHORTEST]
    return max(usable, key=lambda f: (min(map(len, f)), -len(f)), default=None)


@cache
def anchors(regex: str) -> frozenset[str] | None:
    """Lower-case strings of which every match, lower-cased, holds one; None where the expression demands none that is long enough. Strings within others are left out."""
    parts = [_best(s) for s in _Reader(regex).alternatives()]
    if None in parts:
        return None
    found = frozenset(a[:LONGEST] for a in frozenset().union(*parts))
    return frozenset(a for a in found if not any(b != a and b in a for b in found))


def of_all(patterns: tuple[str, ...]) -> frozenset[str] | None:
    """Anchors of any of several expressions."""
    parts = [anchors(p) for p in patterns]
    return None if None in parts else frozenset().union(*parts)

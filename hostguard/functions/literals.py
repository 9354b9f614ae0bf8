"""Literals that a regular expression cannot match without.

``required_literals`` reads a pattern and returns its ways of being recognised: lists of literals, of which every matching
text contains at least one per list. It is strict: whatever it does not know for sure ends a literal or gives no list.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHORTEST = 3

# Escapes that stand for one character of a class, or for a place between characters.
_CLASS_ESCAPES = set("dDwWsSvVhHRX")
_PLACE_ESCAPES = set("bBAzZG")
# Letters after a backslash that stand for one character that is not worth spelling out.
_CONTROL_ESCAPES = set("tnrfae")


class Unreadable(ValueError):
    """A construct that may change what the rest of the pattern means."""


class _Reader:
    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1 : self.at]

    def branches(self) -> list[list[list[str]]]:
        """The ways of each alternative up to the closing parenthesis or the end."""
        found = [self.branch()]
        while self.peek() == "|":
            self.take()
            found.append(self.branch())
        return found

    def branch(self) -> list[list[str]]:
        ways: list[list[str]] = []
        run = ""

        def end() -> None:
            nonlocal run
            if len(run) >= SHORTEST:
                ways.append([run])
            run = ""

        while self.peek() not in ("", "|", ")"):
            kind, value = self.atom()
            least, more = self.quantifier()
            if kind == "char" and least >= 1:
                run += value
                if more:
                    end()
            elif kind == "char":
                end()
            else:
                end()
                if kind == "group" and least >= 1 and value:
                    ways += value
        end()
        return ways

    def atom(self) -> tuple[str, object]:
        """("char", character), ("group", ways) or ("other", None)."""
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            self.char_class()
            return "other", None
        if c in ".^$":
            return "other", None
        if c == "\\":
            return self.escape()
        if c in "*+?{":
            raise Unreadable(c)
        return "char", c

    def escape(self) -> tuple[str, object]:
        c = self.take()
        if c in _CLASS_ESCAPES or c in _PLACE_ESCAPES or c in _CONTROL_ESCAPES:
            return "other", None
        if not c or c.isalnum():
            raise Unreadable("\\" + c)
        return "char", c

    def char_class(self) -> None:
        if self.peek() == "^":
            self.take()
        if self.peek() == "]":
            raise Unreadable("[]")
        while (c := self.take()) != "]":
            if c in ("", "["):
                raise Unreadable("[")
            if c == "\\":
                c = self.take()
                if c in ("", "Q"):
                    raise Unreadable("\\Q")

    def group(self) -> tuple[str, object]:
        looks = False
        if self.peek() == "?":
            self.take()
            kind = self.take()
            if kind == "P" or (kind == "<" and self.peek() not in ("=", "!")):
                if kind == "P" and self.take() != "<":
                    raise Unreadable("(?P")
                while (c := self.take()) != ">":
                    if not c:
                        raise Unreadable("(?<")
            elif kind in "=!<":
                looks = True
                if kind == "<":
                    self.take()
            elif kind not in (":", ">"):
                raise Unreadable("(?" + kind)  # inline flags
        branches = self.branches()
        if self.take() != ")":
            raise Unreadable("(")
        if looks:
            return "other", None
        if len(branches) == 1:
            return "group", branches[0]
        return "group", _either(branches)

    def quantifier(self) -> tuple[int, bool]:
        """(least number of times, whether there may be another number)."""
        c = self.peek()
        if c in ("*", "?", "+") and c:
            self.take()
            least, more = (1 if c == "+" else 0), True
        elif c == "{":
            end = self.text.find("}", self.at)
            bounds = self.text[self.at + 1 : end] if end > 0 else ""
            first, comma, _ = bounds.partition(",")
            if not first.isdigit():
                raise Unreadable("{")
            self.at = end + 1
            least, more = int(first), bool(comma) or int(first) > 1
        else:
            return 1, False
        if self.peek() in ("?", "+") and self.peek():
            self.take()
        return least, more


def _either(branches: list[list[list[str]]]) -> list[list[str]]:
    """One way that holds whichever alternative matches: the longest literals of each."""
    if not all(branches):
        return []
    best = [max(ways, key=lambda way: min(map(len, way))) for ways in branches]
    return [sorted({literal for way in best for literal in way})]


def required_literals(pattern: str | None) -> list[list[str]]:
    """Ways of recognising a text that ``pattern`` may match; none if no literal is certain."""
    reader = _Reader(pattern or "")
    try:
        branches = reader.branches()
    except Unreadable:
        return []
    if reader.at < len(reader.text):
        return []
    ways = branches[0] if len(branches) == 1 else _either(branches)
    unique = {tuple(sorted(set(way))) for way in ways}
    return [list(way) for way in sorted(unique)]

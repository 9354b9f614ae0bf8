"""Text helpers shared by operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Java's dot stops at every line terminator; this flag leaves only the newline.
UNIX_LINES = "(?d)"

_NAMED_GROUP = re.compile(r"\(\?P<([A-Za-z_]\w*)>")
_GROUP_OPEN = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\((\?P<(?P<name>[A-Za-z_]\w*)>|(?!\?))")
_PLAIN_RUN = re.compile(r"(?:[A-Za-z0-9 _=:/\"',;@#%&~<>!-]|\\[./\\-])*")


def iso_millis(seconds: Column) -> Column:
    """Epoch seconds as ISO-8601 UTC text with milliseconds and a Z."""
    at = F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def java_pattern(pattern: str) -> str:
    """A pattern with ``(?P<name>...)`` groups in the form Spark's regex functions take."""
    return UNIX_LINES + _NAMED_GROUP.sub("(", pattern)


def group_numbers(pattern: str) -> dict[str, int]:
    """Number of each named group, counting all capturing groups from the left."""
    numbers, count = {}, 0
    for found in _GROUP_OPEN.finditer(pattern):
        if found.group(1) is None:
            continue
        count += 1
        if found.group("name"):
            numbers[found.group("name")] = count
    return numbers


_ATOM = re.compile(r"\\.|\[\^?\]?(?:\\.|\[[^\]]*\]|[^\]\\\[])*\]|.", re.DOTALL)


def has_branches(pattern: str) -> bool:
    """Whether the pattern as a whole is an alternation: a ``|`` outside groups, classes and escapes."""
    depth = 0
    for atom in _ATOM.findall(pattern):
        depth += (atom == "(") - (atom == ")")
        if atom == "|" and depth == 0:
            return True
    return False


def leading_literal(pattern: str) -> str:
    """Text that every match of ``pattern`` starts with, empty if none is certain."""
    if has_branches(pattern) or r"\Q" in pattern:
        return ""
    run = _PLAIN_RUN.match(pattern).group(0)
    rest = pattern[len(run) :]
    if rest[:1] in ("?", "*", "{", "|"):
        run = run[:-2] if run[-2:-1] == "\\" else run[:-1]
    return re.sub(r"\\(.)", r"\1", run)


def is_literal(pattern: str) -> bool:
    return _PLAIN_RUN.fullmatch(pattern) is not None


def matches(text: Column, pattern: str) -> Column:
    """``pattern`` found anywhere in ``text``.

    A substring test on the bytes goes first, so most lines never reach the regex engine.
    """
    literal = leading_literal(pattern)
    if literal and is_literal(pattern):
        return text.contains(literal)
    found = text.rlike(java_pattern(pattern))
    return text.contains(literal) & found if literal else found


def plain_number(value: Column) -> Column:
    """A decimal without trailing zeros, one digit after the point at least."""
    return F.regexp_replace(value.cast("string"), r"(\.\d+?)0+$", "$1")


# Fixed value: the characters that count as white space around a line.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def as_double(df: DataFrame, name: str) -> Column:
    """A column as a double; text that reads as a number counts as one, other text is null."""
    if dict(df.dtypes)[name].startswith(NUMERIC):
        return F.col(name).cast("double")
    return F.col(name).cast("string").try_cast("double")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)

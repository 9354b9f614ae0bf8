"""Secrets in texts: three kinds of patterns, and runs of characters that are too random to be words.

``entropy`` spans: candidate strings are runs of 20 or more of ``[A-Za-z0-9+/_=-]``. A window of 20 characters slides
over each. Per character class the counts of the window are kept, and the sum of c * log2(c) is moved by the character
that enters and the one that leaves, so a step costs the same whatever the window. A window whose characters all
belong to a class counts if its Shannon entropy reaches the class's threshold. The span goes from the first such
window to the end of the last, if it holds a digit. The allow list has two parts: candidates that match one of
``ALLOWED`` as a whole are not reported, and windows that touch a word of ``HARMLESS`` do not count, so that a random
stretch beside such a word is still found. Pattern spans stay whatever the list says.

All of it happens per row in SQL functions; the only shuffle brings the spans of a text together, narrow as they are.

Edge cases: a null or empty text has no spans and still gives a row. Spans are in code points, end exclusive; spans of
one kind never overlap, spans of different kinds may. Very long texts and candidates are scanned whole, in one pass
each. Rows that share a doc_id are separate rows. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "entropy"]

# Letters of the keyword in either case, ASCII only.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KEYWORDS = ["password", "passwd", "secret", "token", "api"]

WINDOW = 20


@dataclass(frozen=True)
class CharacterClass:
    """Characters, and the least entropy of a window of them in bits."""

    characters: str
    least: float


CLASSES = (
    CharacterClass("0123456789abcdef", 2.93),
    CharacterClass("0123456789ABCDEF", 2.93),
    CharacterClass("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.63),
)

# Candidates that are known to be harmless as a whole.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",  # identifiers made by rule
    r"(^|=)(AKIA[A-Z0-9]{9}|[A-Za-z0-9+/]{30})EXAMPLE(KEY)?$",  # the keys of manuals
    r"^[0-9_=/+-]+$",  # numbers and rules
    r"^([A-Za-z]+[_/=-]?)+$",  # words
)

# Words that are no part of a secret, in either case: a window that touches one does not count.
HARMLESS = "example"


def pieces(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Matches as (kind, at, gap, width, value): ``gap`` code points after the match before, ``width`` long.

    ``value`` is the text that is judged, the whole match or a group of it.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    return F.transform(
        F.arrays_zip(whole.alias("whole"), values.alias("value"), F.slice(between, F.lit(1), F.size(whole)).alias("gap")),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("at"),
            F.length(m["gap"]).alias("gap"),
            F.length(m["whole"]).alias("width"),
            m["value"].alias("value"),
        ),
    )


def _sliding(codes: str, size: int, least: float) -> str:
    """SQL that slides the window over ``codes``, a list of places in the class's characters, 0 for others.

    The state is the count per place, the sum of c * log2(c), how many characters of the window are in the class, and
    the first and last start that reached ``least``.
    """
    weights = ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(WINDOW + 2))
    enters, leaves = f"get({codes}, i - 1)", f"coalesce(get({codes}, i - 1 - {WINDOW}), 0)"

    def weight(count: str) -> str:
        return f"get(array({weights}), {count})"

    entering = f"get(s.counts, {enters})"
    leaving = f"(get(s.counts, {leaves}) + IF({leaves} = {enters}, 1, 0))"
    total = (
        f"s.total + IF({enters} > 0, {weight(f'{entering} + 1')} - {weight(entering)}, 0D)"
        f" + IF({leaves} > 0, {weight(f'{leaving} - 1')} - {weight(leaving)}, 0D)"
    )
    inside = f"s.inside + IF({enters} > 0, 1, 0) - IF({leaves} > 0, 1, 0)"
    reached = f"i >= {WINDOW} AND {inside} = {WINDOW} AND {math.log2(WINDOW)!r}D - ({total}) / {WINDOW} >= {least!r}D"
    return f"""aggregate(sequence(1, size({codes})),
        named_struct('counts', array_repeat(0, {size + 1}), 'total', 0D, 'inside', 0,
                     'first', CAST(NULL AS INT), 'last', CAST(NULL AS INT)),
        (s, i) -> named_struct(
            'counts', transform(s.counts, (c, k) -> c + IF(k = {enters}, 1, 0) - IF(k = {leaves}, 1, 0)),
            'total', {total},
            'inside', {inside},
            'first', IF({reached}, coalesce(s.first, i - {WINDOW}), s.first),
            'last', IF({reached}, i - {WINDOW}, s.last)),
        s -> named_struct('first', s.first, 'last', s.last))"""


def _places(value: Column, characters: str) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(characters), c))


def allowed(value: Column) -> Column:
    test = F.lit(False)
    for pattern in ALLOWED:
        test = test | value.rlike(pattern)
    return test


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and ``spans``, a list of (start, kind, end) by start, then kind as in KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lowered = F.lower(text)
    named = F.lit(False)
    for word in KEYWORDS:
        named = named | lowered.contains(word)
    run = text.rlike(RUN)
    # Most texts fail the cheap tests and are not searched for spans.
    hits = F.concat(
        *[
            F.coalesce(F.when(test, pieces(text, pattern, kind, group)), F.array())
            for kind, (test, pattern, group) in enumerate(
                [(named, ASSIGN, 2), (text.contains("AKIA"), ACCESS, 0), (run, HEX, 0), (run, RUN, 0)]
            )
        ]
    )
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), hits.alias("hits"))
    rows = rows.select("row", "doc_id", F.explode_outer("hits").alias("hit")).select("row", "doc_id", "hit.*")
    one = Window.partitionBy("row", "kind").orderBy("at")
    before = F.sum("gap").over(one) + F.coalesce(F.sum("width").over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.repartition("row").withColumn("start", before)

    is_random = F.col("kind") == KINDS.index("entropy")
    masked = F.regexp_replace("value", f"(?i){HARMLESS}", " " * len(HARMLESS))
    judged = F.when(is_random & ~allowed(F.col("value")), masked)
    for i, kind in enumerate(CLASSES):
        placed = placed.withColumn(f"codes{i}", _places(judged, kind.characters))
        placed = placed.withColumn(f"found{i}", F.expr(_sliding(f"codes{i}", len(kind.characters), kind.least)))
    firsts = [F.col(f"found{i}.first") for i in range(len(CLASSES))]
    lasts = [F.col(f"found{i}.last") for i in range(len(CLASSES))]
    placed = placed.withColumns({"first": F.least(*firsts), "last": F.greatest(*lasts)})
    stretch = F.substring(F.col("value"), F.col("first") + 1, F.col("last") - F.col("first") + WINDOW)
    holds = (
        F.when(F.col("kind") == 0, F.length("value") >= 6)
        .when(F.col("kind") == 1, F.col("width") >= 20)
        .when(F.col("kind") == 2, F.lit(True))
        .otherwise(F.col("first").isNotNull() & stretch.rlike("[0-9]"))
    )
    start = F.col("start") + F.when(is_random, F.col("first")).otherwise(0)
    width = F.when(is_random, F.col("last") - F.col("first") + WINDOW).otherwise(F.col("width"))
    span = F.struct(start.cast("bigint").alias("start"), "kind", (start + width).cast("bigint").alias("end"))
    return (
        placed.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(holds, span))).alias("spans"))
        .select("doc_id", "spans")
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

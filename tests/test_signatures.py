import random
import re

import pytest
from pyspark.sql import functions as F

from hostguard.functions.literals import required_literals
from hostguard.operators import signatures
from hostguard.plans.catalog import SIGNATURES


@pytest.mark.parametrize("pattern,ways", [
    ("Failed password", [["Failed password"]]),
    (r"sudo:.*incorrect password", [["incorrect password"], ["sudo:"]]),
    (r"a\.exe\b", [["a.exe"]]),
    ("abc?def", [["def"]]),
    ("abcd?ef", [["abc"]]),
    ("abcd+e", [["abcd"]]),
    ("abcd{2}efg", [["abcd"], ["efg"]]),
    ("(GET|POST) /index", [[" /index"], ["GET", "POST"]]),
    ("(GET|PO) /x", [[" /x"]]),
    ("(long text)?tail end", [["tail end"]]),
    ("(?:long text)+tail", [["long text"], ["tail"]]),
    ("alpha|beta gamma|x", []),
    ("alpha|beta gamma", [["alpha", "beta gamma"]]),
    (r"(?P<user>root|admin) logged", [[" logged"], ["admin", "root"]]),
    ("(?=lookahead)text", [["text"]]),
    ("(?!never)text", [["text"]]),
    ("(?i)text", []), (r"\Qtext\E", []), (r"\d+", []), (r"\x41bcd", []), ("", []), (None, []), ("[a-z]{3}text[0-9]", [["text"]]),
    ("[a-z&&[^b]]text", []), ("text{", []), ("(text", []), ("text)", []), ("t.e.x.t", []), ("été là", [["été là"]]),
])
def test_required_literals(pattern, ways):
    assert required_literals(pattern) == ways


def test_every_match_holds_a_literal_of_every_way():
    rnd = random.Random(3)
    pieces = ["abc", "x", "(abc|xyz)", "(ab)?", "(cba)+", "[abc]", ".*", "a{2}", "c{0,2}", "z+", "q*", "(?:ab|cz)x", "^", "\\."]
    for _ in range(3000):
        pattern = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 5)))
        pattern = "|".join([pattern, "".join(rnd.choice(pieces) for _ in range(3))][: rnd.randint(1, 2)])
        text = "".join(rnd.choice("abcxzq.") for _ in range(rnd.randint(0, 25)))
        if re.search(pattern, text):
            for way in required_literals(pattern):
                assert any(literal in text for literal in way), (pattern, text, way)


LINES = [
    None, "", "abc", "abcabc abc", "xyz", "Failed password for root", "GET /a GET /a POST /b", "été là été", "root root admin logged",
    "a" * 40 + "tail end" + "b" * 40, "FAILED", "12 34", "😀 smile 😀",
]
PATTERNS = [
    "abc", "abc", "(GET|POST) /", r"\d+ \d+", "(?i)failed", None, "", "été", "(root|admin).*logged", "tail|abc", "b{4}", "smile 😀", "zzz", "x?y?z",
]


def plain(lines, patterns):
    return sorted((i, o) for i, line in enumerate(lines) for o, p in enumerate(patterns) if line is not None and p is not None and re.search(p, line))


@pytest.mark.parametrize("rows", [200_000, 0])
def test_indexed_hits_equal_plain_matching(spark, monkeypatch, rows):
    monkeypatch.setattr(signatures, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(signatures, "BLOCK", 2)
    lines = spark.createDataFrame(list(enumerate(LINES)), "i int, line string").withColumns({"ordinal": F.lit("clash"), "regex": F.lit("clash"), "gram": F.lit(1)})
    catalogue = spark.createDataFrame(list(enumerate(PATTERNS)), "ordinal int, pattern string").withColumn("ways", F.lit("clash"))
    got = signatures.indexed_hits(lines, catalogue)
    assert sorted((r.i, r.ordinal) for r in got.collect()) == plain(LINES, PATTERNS) and got.columns == ["i", "line", "regex", "gram", "ordinal"]
    counts = {r.ordinal: r.hits for r in signatures.indexed_counts(lines, catalogue).collect()}
    assert counts == {o: sum(1 for _, p in plain(LINES, PATTERNS) if p == o) for o in range(len(PATTERNS))}
    first = {r.i: r.ordinal for r in signatures.first_hits(lines, catalogue, ["i"]).collect()}
    assert first == {i: min(o for j, o in plain(LINES, PATTERNS) if j == i) for i, _ in plain(LINES, PATTERNS)}


def test_empty_sides_and_long_lines(spark):
    lines = spark.createDataFrame([(1, "filler " * 100_000 + "Failed password")], "i int, line string")
    catalogue = spark.createDataFrame(list(enumerate(SIGNATURES)), "ordinal int, pattern string")
    assert [r.ordinal for r in signatures.indexed_hits(lines, catalogue).collect()] == [0]
    assert signatures.indexed_hits(lines, catalogue.limit(0)).count() == 0
    assert signatures.indexed_hits(lines.limit(0), catalogue).count() == 0


def test_a_line_meets_few_of_many_patterns(spark):
    catalogue = spark.range(20_000).select(F.col("id").alias("ordinal"), F.concat(F.lit("common words proc-"), F.col("id") + 100_000, F.lit(r"\.exe")).alias("pattern"))
    index = signatures.literal_index(signatures.readable_patterns(catalogue))
    # Filed under the pieces with the number, not under the words that all share.
    assert index.groupBy("gram").count().agg(F.max("count")).first()[0] <= 20 and index.count() == 20_000

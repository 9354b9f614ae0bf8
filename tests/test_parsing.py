import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from hostguard.functions.ip import first_ip, is_ip, subnet_of
from hostguard.functions.text import group_numbers, is_literal, iso_millis, leading_literal, stripped
from hostguard.operators import parsing
from hostguard.operators.events import build_event
from hostguard.plans.catalog import MAX_CATALOGUE, LinePattern, catalogue_rows, read_catalogue, signature_patterns

ADDRESSES = [
    "1.2.3.4", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", "", "::", "::1", "1::", "fe80::1",
    "2001:db8:1::7", "2001:0DB8::ff00:42:8329", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "1::2::3",
    ":1", "1:", "12345::", "::ffff:1.2.3.4", "0:0:1:0:0:0:2:3", "0:1::", "abc", "not an address", "1.2.3.4\n",
]


def valid(text):
    try:
        ipaddress.ip_address(text)
        return True
    except ValueError:
        return False


def network(text, prefix):
    try:
        return str(ipaddress.ip_network(f"{text}/{prefix}", strict=False))
    except ValueError:
        return None


def test_addresses_and_networks(spark):
    rng = random.Random(7)
    groups = lambda: ":".join(rng.choice(["0", "0", "1", "ab", "ffff"]) for _ in range(8))
    texts = ADDRESSES + [groups() for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    prefixes = [24, 13, 32, 0, 16]
    rows = df.select("ip", is_ip(F.col("ip")).alias("ok"), *[subnet_of(F.col("ip"), p).alias(f"n{p}") for p in prefixes])
    for row in rows.collect():
        assert row.ok == valid(row.ip), row.ip
        for prefix in prefixes:
            assert row[f"n{prefix}"] == network(row.ip, prefix), (row.ip, prefix)


def test_long_networks(spark):
    df = spark.createDataFrame([("2001:db8:0:1:2:3:4:5",), ("1.2.3.4",)], "ip string")
    got = [r[0] for r in df.select(subnet_of(F.col("ip"), 64)).collect()]
    assert got == ["2001:db8:0:1::/64", None]


@pytest.mark.parametrize("text,want", [
    ("1.2.3.456", "1.2.3.45"),
    ("192.168.001.001 then 8.8.8.8", None),
    ("fe80::1", "fe80::"),
    ("std::vector", "d::"),
    ("from 10.0.0.7 and 10.0.0.8", "10.0.0.7"),
    ("nothing here", None),
])
def test_first_address(spark, text, want):
    assert spark.createDataFrame([(text,)], "line string").select(first_ip(F.col("line"))).first()[0] == want


def test_literals_of_patterns():
    assert leading_literal(r"sudo:.*incorrect password") == "sudo:"
    assert leading_literal(r"ab?c") == "a"
    assert leading_literal(r"a|b") == ""
    assert leading_literal(r"GET.*(a|b)") == "GET"
    assert is_literal("Failed password") and not is_literal("a.b") and not is_literal("ab+")
    assert leading_literal("ab+c") == "ab"
    assert group_numbers(r"(a)(?P<ip>\d+)(?:x)[(](?P<port>(\d))") == {"ip": 2, "port": 3}


def test_signatures_match_as_in_python(spark):
    import re

    lines = [
        "Failed password for root", "sudo: alice : 3 incorrect password attempts", 'type=SYSCALL x name="/etc/cron.d"',
        r"ParentImage C:\Temp\x", r"ParentImage C:\Windows\Temp\x", "Image x cmd.exe", "Image x cmdxexe", "CPU at > 80",
        "GET /a.php?x=exec", "GET /?q=1 UNION select", "GET /x?q=%27", "Details a.js", "an error", "ERROR",
        "Failed logon x Status 0xC0000064", "DestinationIp\u2028malicious", "plain",
    ]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "n int, line string")
    catalogue = signature_patterns()
    got = sorted((r.n, r.ordinal) for r in parsing.signature_hits(df, catalogue).collect())
    want = sorted((n, i) for n, line in enumerate(lines) for i, p in enumerate(catalogue) if re.search(p.pattern, line))
    assert got == want
    counts = {r.ordinal: r.hits for r in parsing.signature_counts(df, catalogue).collect()}
    assert len(counts) == 58 and sum(counts.values()) == len(want)


def test_first_catalogue_pattern_wins(spark):
    catalogue = [
        LinePattern(r"login (?P<user>\w+) from (?P<ip>\S+)", "login", ("a",)),
        LinePattern(r"login (?P<user>\w+)(?: port (?P<port>\S+))?", "short"),
    ]
    lines = ["login bob from 9.9.9.9", "login eve port 22 near 8.8.8.8", "login al port x2", "other"]
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    got = {r.line: r for r in parsing.parse_lines(df, catalogue).collect()}
    assert set(got) == set(lines[:3])
    assert (got[lines[0]].type, got[lines[0]].ip, got[lines[0]].tags) == ("login", "9.9.9.9", ["a"])
    assert (got[lines[1]].user, got[lines[1]].port, got[lines[1]].ip) == ("eve", 22, "8.8.8.8")
    assert got[lines[2]].port is None and got[lines[2]].parsed == {"user": "al", "port": "x2"}


def test_built_in_lines_and_registered_patterns(spark):
    lines = ["  Failed password for a from 1.1.1.1 from 2.2.2.2 ", "EXEC: ls -l [PID: 12]", "EXEC: x [PID: y]", "  ", "USB in"]
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    handler = lambda line: build_event("usb", {"raw": line}, source="kernel", severity=7)
    got = [(r.type, r.source, r.severity, r.data) for r in parsing.parse_events(df, [(r"^USB", handler)]).collect()]
    assert got == [
        ("failed_login", "auth.log", 5, {"ip": "2.2.2.2", "raw_line": lines[0].strip()}),
        ("process_activity", "audit.log", 3, {"pid": "12", "name": "ls -l", "cmdline": lines[1]}),
        ("usb", "kernel", 7, {"raw": "USB in"}),
    ]


def test_catalogue_file(spark, tmp_path):
    path = tmp_path / "patterns.json"
    path.write_text('{\n "patterns": ["b+", "a"]\n}')
    assert [p.pattern for p in catalogue_rows(read_catalogue(spark, str(path)))] == ["b+", "a"]
    with pytest.raises(ValueError):
        catalogue_rows(spark.range(MAX_CATALOGUE + 1).selectExpr("id AS ordinal", "'x' AS pattern"))


def test_text_helpers(spark):
    df = spark.createDataFrame([("\u00a0\t x \u3000\x1c", 1704067200.1795)], "t string, s double")
    assert df.select(stripped(F.col("t")), iso_millis(F.col("s"))).first() == ("x", "2024-01-01T00:00:00.179Z")


def test_pattern_tests_equal_plain_matching(spark):
    """Generated patterns: the literal in front may only save time."""
    import random

    from hostguard.functions.text import has_branches, java_pattern, matches

    rng = random.Random(9)
    atoms = ["a", "b", "ab", "x ", "-", "[ab|]", "[)(]", r"\(", r"\|", r"\)", r"\.", ".", "b?", "a*", "b{2}", "(a|b)", "(?:x|ab)", "(b)|a", "(ab)|(x )"]
    patterns = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    lines = ["".join(rng.choice("abx -|().") for _ in range(rng.randint(0, 7))) for _ in range(120)]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    both = [F.struct(matches(F.col("line"), p).alias("got"), F.col("line").rlike(java_pattern(p)).alias("want")) for p in patterns]
    for row in df.select(F.array(*both).alias("both")).collect():
        assert [p for p, r in zip(patterns, row.both) if r.got != r.want] == []
    assert has_branches("foo(a)|bar(b)") and not has_branches(r"a(b|c)\|[|]")

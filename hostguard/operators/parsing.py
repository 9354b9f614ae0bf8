"""Log lines to typed rows: address extraction, pattern catalogues and the built-in line shapes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostguard.functions.ip import first_ip, subnet_of
from hostguard.functions.text import blank_to_null, group_numbers, java_pattern, matches, stripped
from hostguard.operators.events import build_event
from hostguard.plans.catalog import AUTH_FAILURE_TAGS, AUTH_FAILURES, FAILED_LOGIN_LINE, PROCESS_LINE, LinePattern

__all__ = ["extract_ips", "parse_lines", "parse_events", "signature_hits", "auth_failures", "with_subnet"]


def extract_ips(df: DataFrame, column: str = "line") -> DataFrame:
    return df.withColumn("ip", first_ip(F.col(column)))


def with_subnet(df: DataFrame, prefix: int = 24, column: str = "ip") -> DataFrame:
    """Add ``subnet`` and drop rows without a valid address."""
    return df.withColumn("subnet", subnet_of(F.col(column), prefix)).filter(F.col("subnet").isNotNull())


def parse_lines(df: DataFrame, catalogue: list[LinePattern], column: str = "line", source: str = "log") -> DataFrame:
    """Keep lines that match the catalogue; the first matching pattern decides the columns.

    The catalogue becomes one chain of conditions that stops at the first hit, each pattern compiled once.
    """
    line = F.col(column)
    ordinal = F.coalesce(*[F.when(matches(line, p.pattern), F.lit(i)) for i, p in enumerate(catalogue)])
    hits = df.select("*", F.explode(F.array_compact(F.array(ordinal))).alias("ordinal"))

    def group(name: str) -> Column:
        numbered = [(i, p.pattern, group_numbers(p.pattern).get(name)) for i, p in enumerate(catalogue)]
        found = [
            F.when(F.col("ordinal") == i, blank_to_null(F.regexp_extract(line, java_pattern(pattern), number)))
            for i, pattern, number in numbered
            if number
        ]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    names = sorted({name for p in catalogue for name in group_numbers(p.pattern)})
    parsed = F.create_map(*[x for name in names for x in (F.lit(name), group(name))]) if names else F.create_map()
    texts = F.array(*[F.lit(p.type) for p in catalogue])
    tags = F.array(*[F.array(*[F.lit(t) for t in p.tags]).cast("array<string>") for p in catalogue])
    return hits.withColumns(
        {
            "source": F.lit(source),
            "raw_data": stripped(line),
            "type": texts[F.col("ordinal")],
            "tags": tags[F.col("ordinal")],
            "parsed": F.map_filter(parsed.cast("map<string,string>"), lambda _, v: v.isNotNull()),
            "ip": F.coalesce(group("ip"), first_ip(line)),
            "user": group("user"),
            "process": group("process"),
            "port": F.when(group("port").rlike(r"^\d+\z"), group("port").try_cast("int")),
        }
    )


EVENT_FIELDS = {
    "type": "string",
    "data": "map<string,string>",
    "source": "string",
    "hostname": "string",
    "pid": "int",
    "severity": "int",
    "correlation_id": "string",
    "tags": "array<string>",
}

Handler = Callable[[Column], dict[str, Column]]


def parse_events(
    df: DataFrame,
    registered: list[tuple[str, Handler]] = [],
    column: str = "line",
) -> DataFrame:
    """Lines to events. Registered patterns are tried first, then failed logins, then started processes.

    A handler takes the stripped line and returns the columns of its event: ``type``, ``data`` and any other
    event column. Lines that nothing matches are dropped.
    """
    line = F.col("_line")
    rows = df.withColumn("_line", stripped(F.col(column))).filter(F.col("_line") != "")
    ip = F.regexp_extract(line, java_pattern(FAILED_LOGIN_LINE), 1)
    name, pid = (F.regexp_extract(line, java_pattern(PROCESS_LINE), i) for i in (1, 2))
    shapes = [(matches(line, pattern), handler(line)) for pattern, handler in registered]
    shapes.append((ip != "", build_event("failed_login", {"ip": ip, "raw_line": line}, source="auth.log")))
    process = {"pid": pid, "name": name, "cmdline": line}
    shapes.append((pid != "", build_event("process_activity", process, source="audit.log")))

    def event(columns: dict[str, Column]) -> Column:
        return F.struct(*[columns.get(field, F.lit(None)).cast(kind).alias(field) for field, kind in EVENT_FIELDS.items()])

    # A generator instead of a filter: the optimizer would repeat the matching in the filter and in the columns.
    parsed = F.coalesce(*[F.when(test, event(columns)) for test, columns in shapes])
    return rows.select(*[c for c in df.columns if c not in EVENT_FIELDS], F.inline(F.array_compact(F.array(parsed))))


def signature_hits(df: DataFrame, catalogue: list[LinePattern], column: str = "line") -> DataFrame:
    """Every (line, pattern) hit, as rows with ``ordinal``.

    Lines are read once and never joined with the catalogue: all patterns are tested in one projection, and
    only the hits become rows.
    """
    tests = [F.when(matches(F.col(column), p.pattern), F.lit(i)) for i, p in enumerate(catalogue)]
    return df.withColumn("ordinal", F.explode(F.array_compact(F.array(*tests))))


def signature_counts(df: DataFrame, catalogue: list[LinePattern], column: str = "line") -> DataFrame:
    """Hits per pattern, patterns without hits included."""
    counts = [F.count_if(matches(F.col(column), p.pattern)) for p in catalogue]
    wide = df.agg(F.array(*[F.struct(F.lit(i).alias("ordinal"), c.alias("hits")) for i, c in enumerate(counts)]).alias("_c"))
    patterns = F.array(*[F.lit(p.pattern) for p in catalogue])
    return wide.select(F.explode("_c").alias("_c")).select("_c.ordinal", patterns[F.col("_c.ordinal")].alias("pattern"), "_c.hits")


def auth_failures(df: DataFrame, column: str = "line") -> DataFrame:
    line = F.col(column)
    found = reduce(lambda a, b: a | b, [line.contains(phrase) for phrase in AUTH_FAILURES])
    tags = F.array(*[F.lit(tag) for tag in AUTH_FAILURE_TAGS])
    return df.filter(found).withColumns({"ip": first_ip(line), "raw_data": stripped(line), "tags": tags})

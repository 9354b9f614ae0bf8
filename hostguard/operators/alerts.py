"""Alert rows: severity, projection, normalising, dedup keys, hashes, workflow rules, alert lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from hostguard.functions.text import bound, iso_millis
from hostguard.operators.events import MAX_TIMESTAMP, MIN_TIMESTAMP, text_map
from hostguard.schemas import ALERT_SCHEMA

# Severity by event type, and the severities an event may ask for itself.
SEVERITY_BY_TYPE = {
    "info": "LOW",
    "suspicious_activity": "MEDIUM",
    "multiple_failures": "HIGH",
    "critical_anomaly": "CRITICAL",
}
EVENT_SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# Severities of stored alerts, and field limits in characters.
ALERT_SEVERITIES = ["INFO", "WARNING", "ERROR", "CRITICAL"]
MAX_LENGTHS = {"message": 4096, "source": 256, "event_id": 36, "correlation_id": 256}
MAX_DEDUP_KEY = 1024
MAX_METADATA_KEYS = 100
MAX_METADATA_VALUE = 10000

# Fixed value: the text forms of a UUID, with or without hyphens, braces or a urn prefix.
UUID_PATTERN = r"(?i)^(?:urn:uuid:)?\{?(?:[0-9a-f]-*){32}\}?\z"

ALERT_FIELDS = ["type", "message", "timestamp", "severity", "description", "event_type", "source"]


def classify(kind: Column, custom: Column | None = None) -> Column:
    """Severity of an event type; a valid severity of the event's own wins."""
    lowered = F.lower(kind)
    mapped = reduce(
        lambda rest, item: F.when(lowered == item[0], F.lit(item[1])).otherwise(rest),
        reversed(SEVERITY_BY_TYPE.items()),
        F.lit("LOW"),
    )
    if custom is None:
        return mapped
    upper = F.upper(custom.cast("string"))
    return F.when(upper.isin(*EVENT_SEVERITIES), upper).otherwise(mapped)


def generate_alerts(df: DataFrame, as_of: Column) -> DataFrame:
    """Events (type, message, anything else) to alerts; rows without type or message carry ``error``.

    ``as_of`` (epoch seconds) is the time of events that bring none.
    """
    names = set(df.columns)

    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in names else F.lit(None).cast("string")

    error = F.when(column("type").isNull(), F.lit("type is missing")).when(
        column("message").isNull(), F.lit("message is missing")
    )
    others = [c for c in df.columns if c not in ALERT_FIELDS]
    return df.select(
        classify(column("type"), column("severity")).alias("severity"),
        F.coalesce(column("timestamp"), iso_millis(as_of)).alias("timestamp"),
        column("message").alias("description"),
        column("type").alias("event_type"),
        F.coalesce(column("source"), F.lit("unknown")).alias("source"),
        *others,
        error.alias("error"),
    )


def normalize_alerts(df: DataFrame, as_of: Column, extra_severities: list[str] = []) -> DataFrame:
    """Loose alert columns to ``ALERT_SCHEMA`` values; times outside the bounds become ``as_of``."""
    names, types = set(df.columns), dict(df.dtypes)

    def column(name: str) -> Column:
        return F.col(name) if name in names else F.lit(None).cast("string")

    seconds = column("timestamp").cast("string").try_cast("double")
    upper = F.upper(column("severity"))
    allowed = ALERT_SEVERITIES + [s.upper() for s in extra_severities]
    metadata = column("metadata") if types.get("metadata", "").startswith("map") else text_map(column("metadata"))
    values = {
        "id": F.when(column("id").rlike(UUID_PATTERN), F.substring(column("id"), 1, 36)).otherwise(F.uuid()),
        "timestamp": F.when(seconds.between(MIN_TIMESTAMP, MAX_TIMESTAMP), seconds).otherwise(as_of.cast("double")),
        "severity": F.when(upper.isin(*allowed), upper).otherwise(F.lit("INFO")),
        **{name: F.substring(column(name), 1, size) for name, size in MAX_LENGTHS.items()},
        "metadata": clean_metadata(metadata),
    }
    values["message"] = F.coalesce(values["message"], F.lit(""))
    workflow = {
        "acknowledged": F.coalesce(column("acknowledged").cast("boolean"), F.lit(False)),
        "acknowledged_at": column("acknowledged_at").cast("double"),
        "resolved": F.coalesce(column("resolved").cast("boolean"), F.lit(False)),
        "resolved_at": column("resolved_at").cast("double"),
        "version": F.coalesce(column("version").cast("int"), F.lit(1)),
    }
    values.update(workflow)
    others = [c for c in df.columns if c not in values and c != "dedup_key"]
    return df.select(*others, *[value.alias(name) for name, value in values.items()])


def clean_metadata(metadata: Column) -> Column:
    first = F.map_from_entries(F.slice(F.map_entries(metadata), 1, MAX_METADATA_KEYS))
    kept = F.map_filter(first, lambda _, value: value.isNotNull())
    return F.transform_values(kept, lambda _, value: cut_value(value))


def cut_value(text: Column) -> Column:
    """Text cut to its limit; of a list or an object, as JSON text, what is inside is cleaned instead.

    At every depth strings are cut to the limit and nulls leave lists and objects; keys are kept whole. Text that
    needs neither stays as it is, and so does the limit for text that only looks like JSON.
    """
    begins = text.startswith("{") | text.startswith("[") | text.rlike(r"^\s*[\[{]")
    nested = begins & ((F.length(text) > MAX_METADATA_VALUE) | text.contains("null"))
    # Text that begins like a list or an object and can be parsed is one.
    parsed = F.to_json(F.try_parse_json(F.when(nested, text)))
    plain = F.substring(text, 1, MAX_METADATA_VALUE)
    return bound(parsed, lambda json: F.when(json.isNotNull(), clean_json(json)).otherwise(plain))


def clean_json(text: Column) -> Column:
    """JSON text without white space between its tokens: long strings cut, nulls taken out, at any depth.

    Escaped quotes are written as code points first. A quote then always begins or ends a string, and the text is a
    row of pieces, structure and strings in turn, whatever the depth. Nulls are taken out of the structure, in which a
    number stands for each string; then the strings that are left come back, each cut on its own.
    """

    def cut(piece: Column) -> Column:
        value = F.try_parse_json(F.concat(F.lit('"'), piece, F.lit('"'))).try_cast("string")
        again = F.to_json(F.substring(value, 1, MAX_METADATA_VALUE).cast("variant"))
        escaped = bound(again, lambda json: _without_escapes(F.substring(json, F.lit(2), F.length(json) - 2)))
        # A string without a backslash is written as it is.
        return F.when(piece.contains("\\"), escaped).otherwise(F.substring(piece, 1, MAX_METADATA_VALUE))

    def without_nulls(structure: Column) -> Column:
        # A string is taken whole, so its number is not read as structure.
        full = F.regexp_replace(
            structure, r'("[^"]*"(?!:null[,}]))|"[^"]*":null(?:,|(?=\}))|(?<=[\[,])null(?:,|(?=\]))', "$1"
        )
        closed = F.regexp_replace(full, r'("[^"]*")|,(?=[\]}])', "$1")
        return F.when(structure.contains("null"), closed).otherwise(structure)

    def cleaned(pieces: Column) -> Column:
        numbered = F.transform(pieces, lambda piece, at: F.when(at % 2 == 1, at.cast("string")).otherwise(piece))

        def filled(kept: Column) -> Column:
            def string(text: Column, at: Column) -> Column:
                is_key = F.coalesce(F.get(kept, at + 1).startswith(":"), F.lit(False))
                return F.when((F.length(text) > MAX_METADATA_VALUE) & ~is_key, cut(text)).otherwise(text)

            def back(piece: Column, at: Column) -> Column:
                found = bound(F.get(pieces, piece.try_cast("int")), lambda text: string(text, at))
                return F.when(at % 2 == 1, found).otherwise(piece)

            return F.array_join(F.transform(kept, back), '"')

        return bound(F.split(bound(F.array_join(numbered, '"'), without_nulls), '"', -1), filled)

    plain = bound(text, _without_escapes)
    return bound(bound(F.split(plain, '"', -1), cleaned), _with_escapes)


def _without_escapes(text: Column) -> Column:
    """Backslashes and quotes inside strings as code points; most texts have none."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    return F.when(text.contains("\\"), plain).otherwise(text)


def _with_escapes(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\u0022"), F.lit('\\"')), F.lit("\\u005c"), F.lit("\\\\"))
    return F.when(text.contains("\\u00"), escaped).otherwise(text)


def check_workflow(df: DataFrame, as_of: Column) -> DataFrame:
    """Fill in missing times of set flags and add ``error`` for combinations that cannot be."""
    filled = df.withColumns(
        {
            "acknowledged_at": F.when(F.col("acknowledged"), F.coalesce("acknowledged_at", as_of.cast("double")))
            .otherwise(F.col("acknowledged_at")),
            "resolved_at": F.when(F.col("resolved"), F.coalesce("resolved_at", as_of.cast("double")))
            .otherwise(F.col("resolved_at")),
        }
    )
    error = (
        F.when(F.coalesce("id", F.lit("")) == "", F.lit("the alert has no id"))
        .when(F.col("resolved") & ~F.col("acknowledged"), F.lit("resolved without being acknowledged"))
        .when(
            F.col("acknowledged_at").isNotNull() & ~F.col("acknowledged"),
            F.lit("time of acknowledgement on an alert not acknowledged"),
        )
        .when(
            F.col("resolved_at").isNotNull() & ~F.col("resolved"), F.lit("time of resolution on an alert not resolved")
        )
    )
    return filled.withColumn("error", error)


def dedup_key() -> Column:
    """Severity, message, the ids that are set and the sorted metadata; long keys are hashed."""

    def unless_empty(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    entries = F.transform(
        F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])
    )
    # One concat_ws, so that nulls drop out while an empty message keeps its place.
    key = F.concat_ws(
        "|",
        F.col("severity"),
        F.col("message"),
        unless_empty("source"),
        unless_empty("event_id"),
        unless_empty("correlation_id"),
        entries,
    )
    return F.when(F.length(key) > MAX_DEDUP_KEY, F.sha2(key, 256)).otherwise(key)


def content_hash() -> Column:
    """sha256 of the alert's set fields as JSON, fields and metadata in sorted order.

    Times are whole microseconds in text, which every engine writes alike; those beyond a long's range (or not a
    number) are the text of the double.
    """

    def written(field: StructField) -> Column:
        if field.name == "metadata":
            return F.map_from_entries(F.array_sort(F.map_entries("metadata")))
        if isinstance(field.dataType, DoubleType):
            micros = F.round(F.col(field.name) * 1_000_000).try_cast("bigint")
            return F.coalesce(micros.cast("string"), F.col(field.name).cast("string"))
        return F.col(field.name)

    fields = sorted(ALERT_SCHEMA, key=lambda field: field.name)
    return F.sha2(F.to_json(F.struct(*[written(field).alias(field.name) for field in fields])), 256)


def with_identity(df: DataFrame) -> DataFrame:
    """Add ``dedup_key`` and ``content_hash``."""
    return df.withColumn("dedup_key", dedup_key()).withColumn("content_hash", content_hash())


def duplicates(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Alerts with the same dedup key as one row. Counts are combined before the shuffle."""
    return df.groupBy("dedup_key").agg(
        F.count(F.lit(1)).alias("alerts"), F.min(time).alias("first_at"), F.max(time).alias("last_at")
    )


def with_severity(df: DataFrame, severity: str | Column, message: Column) -> DataFrame:
    """Alert rows of one severity, the builder behind info, warning, error and critical alerts.

    A column gives each row a severity of its own; the caller sees to it that it holds known ones.
    """
    if isinstance(severity, str) and severity not in ALERT_SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.withColumns({"severity": level, "message": message})


def alerts_from_events(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with the columns of the event they came from; alerts without one keep nulls."""
    details = events.select(
        F.col("id").alias("event_id"), *[F.col(c).alias(f"event_{c}") for c in events.columns if c != "id"]
    )
    return alerts.join(details, "event_id", "left")


# The three queue priorities by name.
PRIORITIES = {"HIGH": 0, "NORMAL": 1, "LOW": 2}


def priority(severity: Column) -> Column:
    return (
        F.when(severity.isin("CRITICAL", "ERROR"), F.lit(PRIORITIES["HIGH"]))
        .when(severity == "INFO", F.lit(PRIORITIES["LOW"]))
        .otherwise(F.lit(PRIORITIES["NORMAL"]))
    )


def alert_line(
    message: Column,
    event_type: Column | None = None,
    severity: Column | None = None,
    metadata: Column | None = None,
    seconds: Column | None = None,
) -> Column:
    """``time | event type | severity | message | metadata``, metadata already as JSON text."""
    at = iso_millis(seconds if seconds is not None else F.unix_micros(F.current_timestamp()) / 1_000_000)
    return F.concat_ws(
        " | ",
        F.regexp_replace(at, r"Z\z", ""),
        F.coalesce(event_type if event_type is not None else F.lit(None), F.lit("SYSTEM")),
        F.upper(F.coalesce(severity if severity is not None else F.lit(None), F.lit("INFO"))),
        message,
        F.coalesce(metadata if metadata is not None else F.lit(None), F.lit("")),
    )

"""Event rows: normalising, checking, building, and JSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostguard.functions.ip import bind, is_ip
from hostguard.functions.text import NUMERIC, as_double, blank_to_null
from hostguard.schemas import EVENT_SCHEMA, TEXT_MAP

# Event types, time bounds in epoch seconds, the longest user name.
EVENT_TYPES = ["failed_login", "process_activity", "file_change", "network_connection", "system_call", "unknown"]
MIN_TIMESTAMP = 1_600_000_000
MAX_TIMESTAMP = 2_200_000_000
MAX_USERNAME = 256

# Default source and severity of each built event type.
EVENT_DEFAULTS = {
    "failed_login": {"source": "auth.log", "severity": 5},
    "process_activity": {"source": "auditd", "severity": 3},
    "file_change": {"source": "auditd", "severity": 4},
    "network_connection": {"source": "network", "severity": 2},
    "system_call": {"source": "syscall", "severity": 3},
}
DATA_DEFAULTS = {"network_connection": {"protocol": "tcp"}, "system_call": {"args": "{}"}}


def whole_number(text: Column) -> Column:
    """Text of an integer as a decimal, null for anything else; beyond 38 digits it is as large as decimals go."""
    trimmed = F.trim(text)
    extreme = F.when(trimmed.startswith("-"), F.lit(f"-{'9' * 38}")).otherwise(F.lit("9" * 38)).cast("decimal(38,0)")
    return F.when(trimmed.rlike(r"^[+-]?\d+\z"), F.coalesce(trimmed.try_cast("decimal(38,0)"), extreme))


def whole_column(df: DataFrame, name: str) -> Column:
    """A column as a whole number: numbers are cut towards zero, other types go by their text."""
    if dict(df.dtypes)[name].startswith(NUMERIC):
        number = F.col(name).cast("double")
        kept = F.when(~F.isnan(number) & (F.abs(number) < 1e37), F.col(name))
        whole = F.when(kept >= 0, F.floor(kept)).otherwise(F.ceil(kept))
        return whole.cast("decimal(38,0)")
    return whole_number(F.col(name).cast("string"))


def clean_value(text: Column, value: Column) -> Column:
    """A data value: lists lose their nulls, one-level objects their null entries, the rest stays as it is."""
    kind = F.schema_of_variant(value)
    items = F.filter(value.try_cast("array<variant>"), lambda item: ~F.is_variant_null(item))
    entries = F.map_filter(value.try_cast("map<string,variant>"), lambda _, item: ~F.is_variant_null(item))
    return (
        F.when(kind.startswith("ARRAY"), F.to_json(items))
        .when(kind.startswith("OBJECT"), F.to_json(entries))
        .otherwise(text)
    )


def json_object(column: Column) -> Column:
    """A JSON object as a map of its values' text, nested values cleaned; null for any other text."""
    parsed = F.try_parse_json(F.when(column.startswith("{"), column)).try_cast("map<string,variant>")
    both = F.struct(F.from_json(column, TEXT_MAP).alias("texts"), parsed.alias("values"))

    def clean(pair: Column) -> Column:
        values = pair["values"]
        cleaned = F.transform_values(pair["texts"], lambda key, text: clean_value(text, values[key]))
        return F.when(values.isNotNull(), cleaned)

    return bind(both, clean)


def empty_map() -> Column:
    return F.from_json(F.lit("{}"), TEXT_MAP)


def text_map(column: Column) -> Column:
    """JSON object text as a map; other text as {raw: text}; nothing as an empty map."""
    raw = F.when(F.coalesce(column, F.lit("")) != "", F.create_map(F.lit("raw"), column)).otherwise(empty_map())
    return F.coalesce(json_object(column), raw)


def text_list(column: Column) -> Column:
    listed = F.from_json(column, "array<string>")
    is_list = column.startswith("[") & F.try_parse_json(column).isNotNull()
    one = F.when(F.coalesce(column, F.lit("")) != "", F.array(column)).otherwise(F.array().cast("array<string>"))
    return F.when(is_list, listed).otherwise(one)


def normalize_events(df: DataFrame, as_of: Column, extra_types: list[str] = []) -> DataFrame:
    """Loose text columns to ``EVENT_SCHEMA``; ``as_of`` (epoch seconds) stands in for unreadable times."""
    names = set(df.columns)

    def column(name: str) -> Column:
        return F.col(name) if name in names else F.lit(None).cast("string")

    types = dict(df.dtypes)
    given = as_double(df, "timestamp") if "timestamp" in names else F.lit(None).cast("double")
    seconds = F.coalesce(given, as_of.cast("double"))
    absent = F.lit(None).cast("decimal(38,0)")
    severity = whole_column(df, "severity") if "severity" in names else absent
    pid = whole_column(df, "pid") if "pid" in names else absent
    if types.get("data", "").startswith("map"):
        data = F.transform_values("data", lambda _, v: clean_value(v.cast("string"), F.try_parse_json(v.cast("string"))))
    else:
        data = text_map(column("data"))
    tags = column("tags") if types.get("tags", "").startswith("array") else text_list(column("tags"))
    known = column("type").isin(*EVENT_TYPES, *extra_types)
    values = {
        "id": F.coalesce(blank_to_null(column("id")), F.uuid()),
        "timestamp": F.least(F.greatest(seconds, F.lit(float(MIN_TIMESTAMP))), F.lit(float(MAX_TIMESTAMP))),
        "type": F.when(known, column("type")).otherwise(F.lit("unknown")),
        "data": data,
        "source": column("source"),
        "hostname": column("hostname"),
        "pid": F.when(pid > 0, pid.try_cast("int")),
        "severity": F.least(F.greatest(severity, F.lit(1)), F.lit(10)).cast("int"),
        "correlation_id": column("correlation_id"),
        "tags": tags,
    }
    # least and greatest skip nulls, so a missing severity is put back.
    values["severity"] = F.when(severity.isNotNull(), values["severity"])
    others = [c for c in df.columns if c not in values]
    return df.select(*others, *[value.alias(name) for name, value in values.items()])


def check_events(df: DataFrame) -> DataFrame:
    """Add ``error``, null for valid events."""
    data = F.col("data")
    ip, user, pid = data["ip"], data["username"], data["pid"]
    number = whole_number(pid)
    login = F.col("type") == "failed_login"
    process = F.col("type") == "process_activity"
    error = (
        F.when(F.coalesce("id", F.lit("")) == "", F.lit("the event has no id"))
        .when(
            login & (F.coalesce(ip, F.lit("")) != "") & ~is_ip(ip),
            F.concat(F.lit("not an IP address: "), ip),
        )
        .when(
            login & (F.length(user) > MAX_USERNAME),
            F.concat(F.lit("username of "), F.length(user).cast("string"), F.lit(" characters")),
        )
        .when(
            process & pid.isNotNull() & (number.isNull() | (number <= 0)), F.concat(F.lit("not a process id: "), pid)
        )
        .when(
            ~F.col("severity").between(1, 10),
            F.concat(F.lit("severity "), F.col("severity").cast("string"), F.lit(" is not from 1 to 10")),
        )
    )
    return df.withColumn("error", error)


def split_valid(df: DataFrame, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) by the ``error`` column or by a condition of the caller."""
    good = F.col("error").isNull() if valid is None else F.coalesce(valid, F.lit(False))
    return df.filter(good), df.filter(~good)


def build_event(kind: str, data: dict[str, Column], **fields) -> dict[str, Column]:
    """Columns of a typed event: given fields, then the defaults of its type."""
    given = {name: value if isinstance(value, Column) else F.lit(value) for name, value in fields.items()}
    defaults = {name: F.lit(value) for name, value in EVENT_DEFAULTS.get(kind, {}).items()}
    values = {name: F.lit(value) for name, value in DATA_DEFAULTS.get(kind, {}).items()}
    values.update({name: value.cast("string") for name, value in data.items() if value is not None})
    entries = [x for name, value in values.items() for x in (F.lit(name), value.cast("string"))]
    return {"type": F.lit(kind), "data": F.create_map(*entries).cast(TEXT_MAP), **defaults, **given}


def with_event(df: DataFrame, kind: str, data: dict[str, Column], **fields) -> DataFrame:
    """``df`` with the event columns of ``build_event`` added."""
    return df.withColumns(build_event(kind, data, **fields))


def event_json(df: DataFrame, flatten_data: bool = False) -> DataFrame:
    """Add ``json``: the event without null fields. Flattened data entries replace fields of the same name."""
    names = [field.name for field in EVENT_SCHEMA]
    if not flatten_data:
        return df.withColumn("json", F.to_json(F.struct(*[F.col(n) for n in names])))
    top = [n for n in names if n != "data"]
    fields = F.create_map(
        *[x for n in top for x in (F.lit(n), F.parse_json(F.to_json(F.array(F.col(n)))).cast("array<variant>")[0])]
    )
    own = F.map_filter(
        fields,
        lambda key, value: ~F.coalesce(F.is_variant_null(value), F.lit(True))
        & ~F.array_contains(F.coalesce(F.map_keys("data"), F.array().cast("array<string>")), key),
    )
    lifted = F.transform_values(F.map_filter("data", lambda _, v: v.isNotNull()), lambda _, v: v.cast("variant"))
    merged = F.map_concat(own, F.coalesce(lifted, F.map_filter(own, lambda k, v: F.lit(False))))
    return df.withColumn("json", F.to_json(merged))


def event_fields(df: DataFrame, column: str = "json") -> DataFrame:
    """JSON records to loose event columns; unknown top-level keys go into ``data``. Unreadable text: ``error``."""
    names = [field.name for field in EVENT_SCHEMA]
    known = F.array(*[F.lit(n) for n in names])
    rows = df.withColumn("_record", json_object(F.col(column)))
    rows = rows.withColumns(
        {
            "_extra": F.map_filter("_record", lambda key, _: ~F.array_contains(known, key)),
            "_given": json_object(F.coalesce(F.col("_record")["data"], F.lit("{}"))),
        }
    )
    own = F.map_filter("_given", lambda key, _: ~F.map_contains_key("_extra", key))
    folded = F.coalesce(F.map_concat(own, F.col("_extra")), text_map(F.col("_record")["data"]))
    columns = {n: F.col("_record")[n] for n in names if n != "data"}
    error = F.when(F.col("_record").isNull(), F.lit("not a JSON object"))
    return rows.withColumns({**columns, "data": folded, "error": error}).drop("_record", "_extra", "_given")


def filter_events(df: DataFrame, levels: list | None = None, keywords: list[str] = []) -> DataFrame:
    """Events whose severity is listed (if levels are given) and whose text holds every keyword, in any case."""
    text = F.lower(F.coalesce(F.col("data")["raw_line"], F.to_json("data")))
    kept = df.filter(F.col("severity").isin(*levels)) if levels else df
    for keyword in keywords:
        kept = kept.filter(text.contains(keyword.lower()))
    return kept


def analyze_activity(df: DataFrame, threshold: float = 90) -> DataFrame:
    """``detected`` by activity score; ``process`` and the score are dropped, bad rows carry ``error``."""
    names = set(df.columns)
    process = F.col("process") if "process" in names else F.lit(None).cast("string")
    given = F.col("activity_score") if "activity_score" in names else F.lit(None).cast("string")
    score = as_double(df, "activity_score") if "activity_score" in names else given.cast("double")
    error = (
        F.when(process.isNull(), F.lit("process is missing"))
        .when(given.isNull(), F.lit("activity_score is missing"))
        .when(score.isNull(), F.lit("activity_score is not a number"))
    )
    rows = df.withColumns({"error": error, "detected": F.when(error.isNull(), score >= threshold)})
    return rows.drop("process", "activity_score")

import hashlib
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from hostguard.operators import alerts, events, lifecycle

NOW = 1_706_745_600.0


@pytest.mark.parametrize("kind,want", [
    ("info", "LOW"), ("suspicious_activity", "MEDIUM"), ("multiple_failures", "HIGH"), ("critical_anomaly", "CRITICAL"),
    ("unknown_type", "LOW"), ("INFO", "LOW"), ("SUSPICIOUS_ACTIVITY", "MEDIUM"),
])
def test_severity_by_type(spark, kind, want):
    assert spark.range(1).select(alerts.classify(F.lit(kind))).first()[0] == want


def generated(spark, rows, schema):
    return alerts.generate_alerts(spark.createDataFrame(rows, schema), F.lit(NOW)).collect()


def test_alert_projection(spark):
    schema = "type string, message string, severity string, timestamp string, source_ip string, nested map<string,string>"
    rows = generated(spark, [
        ("info", "x", "Critical", "2025-01-01T12:00:00+00:00", "1.1.1.1", {"key": "value"}),
        ("info", "x", "INVALID", None, None, None),
        (None, "x", None, None, None, None),
        ("test", None, None, None, None, None),
        ("info", "è una stringa 🚀", "low", None, None, None),
    ], schema)
    assert (rows[0].severity, rows[0].timestamp, rows[0].source_ip, rows[0].nested) == (
        "CRITICAL", "2025-01-01T12:00:00+00:00", "1.1.1.1", {"key": "value"})
    assert (rows[1].severity, rows[1].timestamp, rows[1].source) == ("LOW", "2024-02-01T00:00:00.000Z", "unknown")
    assert rows[2].error == "type is missing"
    assert rows[3].error == "message is missing"
    assert rows[4].description == "è una stringa 🚀" and rows[4].error is None
    assert generated(spark, [("info", 12345)], "type string, message int")[0].description == "12345"


def test_many_extra_columns_pass(spark):
    df = spark.range(1).select(F.lit("info").alias("type"), F.lit("m").alias("message"),
                               *[F.lit("x").alias(f"field_{i}") for i in range(300)])
    row = alerts.generate_alerts(df, F.lit(NOW)).first()
    assert row.severity == "LOW" and row.field_299 == "x"


def test_activity_threshold(spark):
    rows = [("a", "95", 1), ("a", "90", 1), ("a", "89.9", 1), ("a", "-5", 1), ("a", "1000000", 1), ("a", "high", 1),
            ("a", None, 1), (None, "95", 1)]
    got = events.analyze_activity(spark.createDataFrame(rows, "process string, activity_score string, pid int")).collect()
    assert [r.detected for r in got] == [True, True, False, False, True, None, None, None]
    assert [r.error for r in got[5:]] == ["activity_score is not a number", "activity_score is missing",
                                          "process is missing"]
    assert set(got[0].asDict()) == {"pid", "detected", "error"}


LOOSE = "id string, timestamp string, type string, data string, pid string, severity string, tags string"


def test_event_normalising(spark):
    rows = [
        ("", "x", "nope", '{"a":[1,null,"b"],"o":{"k":null,"m":1},"s":"[1,null]","n":null,"d":1.5}', "0", "0", "t"),
        ("e", "5", "failed_login", "text", " 7 ", "99", '["p","q"]'),
        ("e", "9e9", "custom", None, "1.5", "abc", None),
        ("e", "1700000000.5", "file_change", '{"broken', "-3", None, ""),
    ]
    df = spark.createDataFrame(rows, LOOSE)
    a, b, c, d = events.normalize_events(df, F.lit(NOW), ["custom"]).collect()
    assert uuid.UUID(a.id) and a.timestamp == NOW and a.type == "unknown" and a.pid is None and a.severity == 1
    assert a.data == {"a": '[1,"b"]', "o": '{"m":1}', "s": "[1,null]", "n": None, "d": "1.5"} and a.tags == ["t"]
    assert (b.timestamp, b.pid, b.severity, b.tags, b.data) == (1.6e9, 7, 10, ["p", "q"], {"raw": "text"})
    assert (c.timestamp, c.type, c.pid, c.severity, c.data, c.tags) == (2.2e9, "custom", None, None, {}, [])
    assert (d.timestamp, d.pid, d.severity, d.data) == (1700000000.5, None, None, {"raw": '{"broken'})


def test_event_checks(spark):
    rows = [
        ("1", "failed_login", {"ip": "1.2.3.4", "username": "u" * 256}, 5, None),
        ("1", "failed_login", {"ip": "1.2.3.999"}, 5, "not an IP address: 1.2.3.999"),
        ("1", "failed_login", {"username": "u" * 257}, 5, "username of 257 characters"),
        ("1", "process_activity", {"pid": "0"}, 5, "not a process id: 0"),
        ("1", "process_activity", {"pid": "x"}, 5, "not a process id: x"),
        ("1", "process_activity", {"pid": "3"}, 11, "severity 11 is not from 1 to 10"),
        ("", "file_change", {}, None, "the event has no id"),
        ("1", "file_change", {}, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, type string, data map<string,string>, severity int, want string")
    checked = events.check_events(df)
    assert all(r.error == r.want for r in checked.collect())
    good, bad = events.split_valid(checked)
    assert (good.count(), bad.count()) == (2, 6)
    kept, refused = events.split_valid(df, F.col("severity") > 5)
    assert (kept.count(), refused.count()) == (1, 7)


def test_event_json_round_trip(spark):
    record = {"id": "e", "timestamp": 1.7e9, "type": "failed_login", "data": {"a": "1"}, "extra": [1, None], "severity": 3}
    df = spark.createDataFrame([(json.dumps(record),), ("[1]",), ("nope",)], "json string")
    found = events.event_fields(df).drop("json")
    assert [r.error for r in found.collect()] == [None, "not a JSON object", "not a JSON object"]
    full = events.normalize_events(found.filter("error IS NULL"), F.lit(NOW))
    row = events.event_json(full).first()
    assert row.data == {"a": "1", "extra": "[1]"}
    assert json.loads(row.json) == {"id": "e", "timestamp": 1.7e9, "type": "failed_login", "severity": 3, "tags": [],
                                    "data": {"a": "1", "extra": "[1]"}}
    flat = json.loads(events.event_json(full.withColumn("data", F.create_map(F.lit("severity"), F.lit("9"))),
                                        flatten_data=True).first().json)
    assert flat == {"id": "e", "timestamp": 1.7e9, "type": "failed_login", "tags": [], "severity": "9"}


def test_event_filter(spark):
    rows = [(5, {"raw_line": "User ROOT failed"}), (3, {"raw_line": "user root"}), (5, {"k": "root failed"})]
    df = spark.createDataFrame(rows, "severity int, data map<string,string>")
    assert events.filter_events(df, [5], ["root", "FAILED"]).count() == 2
    assert events.filter_events(df).count() == 3


def test_alert_normalising_and_dedup_key(spark):
    schema = "id string, timestamp string, severity string, message string, source string, event_id string, metadata string"
    good = str(uuid.uuid4())
    rows = [
        (good, "1700000000", "warning", "m" * 5000, "s" * 300, "e" * 40, '{"b":"2","a":"1","n":null}'),
        ("bad", "12", "loud", None, "", None, "text"),
        (good, "x", "page", "short", "src", "ev", None),
    ]
    normal = alerts.normalize_alerts(spark.createDataFrame(rows, schema), F.lit(NOW), ["page"])
    a, b, c = alerts.with_identity(normal).collect()
    assert a.id == good and a.timestamp == 1.7e9 and a.severity == "WARNING"
    assert (len(a.message), len(a.source), len(a.event_id), a.metadata) == (4096, 256, 36, {"b": "2", "a": "1"})
    long_key = "|".join(["WARNING", "m" * 4096, "s" * 256, "e" * 36, "a:1", "b:2"])
    assert a.dedup_key == hashlib.sha256(long_key.encode()).hexdigest()
    assert uuid.UUID(b.id) and (b.timestamp, b.severity, b.message, b.metadata) == (NOW, "INFO", "", {"raw": "text"})
    assert b.dedup_key == "INFO||raw:text"
    assert (c.severity, c.timestamp, c.dedup_key) == ("PAGE", NOW, "PAGE|short|src|ev")
    many = spark.range(1).select(F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.struct(
        i.cast("string").alias("k"), F.lit("v" * 10001).alias("v")))).alias("metadata"))
    cut = many.select(alerts.clean_metadata(F.col("metadata"))).first()[0]
    assert len(cut) == 100 and all(len(v) == 10000 for v in cut.values())


def test_content_hash_of_times(spark):
    times = [1704067300.5, 1704067300.500001, None, 1e30, -2e30, float("nan"), 1704067300.5]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, timestamp double")
    given = rows.selectExpr("*", "'a' AS id", "'ERROR' AS severity", "'m' AS message")
    fixed = alerts.normalize_alerts(given, F.lit(NOW)).withColumn("timestamp", F.element_at(F.array(*[
        F.lit(t).cast("double") for t in times]), F.col("i") + 1))
    got = alerts.with_identity(fixed).orderBy("i").collect()
    written = ["1704067300500000", "1704067300500001", None, "1.0E30", "-2.0E30", "NaN", "1704067300500000"]
    for row, time in zip(got, written, strict=True):
        fields = {"acknowledged": False, "dedup_key": row.dedup_key, "id": row.id, "message": "m", "metadata": {},
                  "resolved": False, "severity": "ERROR", "timestamp": time, "version": 1}
        text = json.dumps({k: v for k, v in fields.items() if v is not None}, separators=(",", ":"))
        assert row.content_hash == hashlib.sha256(text.encode()).hexdigest()


def cleaned(value):
    if isinstance(value, str):
        return value[:10000]
    if isinstance(value, list):
        return [cleaned(v) for v in value if v is not None]
    if isinstance(value, dict):
        return {k: cleaned(v) for k, v in value.items() if v is not None}
    return value


def test_metadata_is_cleaned_at_every_depth(spark):
    deep = None
    for i in range(60):
        deep = [deep, {"k": deep, "n": None, "s": "y" * 10001}] if i < 5 else {"a": [None, deep], "b": None}
    values = [
        [None, ["y" * 12000]], {"a": None}, [None, None], {"a": {"b": {"c": ["x" * 20000, None, {"d": None, "e": 1}]}}},
        ["a", ":null,", "],null,[", '"', "\\", '\\"' * 9000, "\\u0022null", None], {'q"k': None, ":null": 1, "z": None},
        {"k" * 11000: "é漢😀" * 5000, "null": "null"}, [1, True, [], {}, [[None]], "\n\t" * 8000], deep, [], ["x" * 10000, "null"],
    ]
    texts = [json.dumps(v) for v in values] + [json.dumps(v, ensure_ascii=False, indent=1) for v in values[:7]]
    odd = ["[null" + "x" * 10001, "null", "{null}", "plain null", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + odd)] + [(99, None)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", alerts.cut_value(F.col("t")).alias("v")).collect()}
    for i, text in enumerate(texts):
        assert json.loads(got[i]) == cleaned(json.loads(text)), i
    assert [got[len(texts) + i] for i in range(len(odd))] == [t[:10000] for t in odd] and got[99] is None


def test_workflow_rules(spark):
    rows = [(True, None, True, None), (False, None, True, None), (False, 5.0, False, None), (False, None, False, 5.0)]
    df = spark.createDataFrame(rows, "acknowledged boolean, acknowledged_at double, resolved boolean, resolved_at double")
    got = alerts.check_workflow(df.withColumn("id", F.lit("x")), F.lit(NOW)).collect()
    assert got[0].error is None and got[0].acknowledged_at == NOW and got[0].resolved_at == NOW
    assert [r.error for r in got[1:]] == [
        "resolved without being acknowledged", "time of acknowledgement on an alert not acknowledged",
        "time of resolution on an alert not resolved"]


def test_alert_lines_and_priorities(spark):
    line = alerts.alert_line(F.lit("msg"), severity=F.lit("error"), seconds=F.lit(1704067200.5))
    assert spark.range(1).select(line).first()[0] == "2024-01-01T00:00:00.500 | SYSTEM | ERROR | msg | "
    ranks = [spark.range(1).select(alerts.priority(F.lit(s))).first()[0] for s in ("CRITICAL", "ERROR", "INFO", "WARNING")]
    assert ranks == [0, 0, 2, 1]
    with pytest.raises(ValueError):
        alerts.with_severity(spark.range(1), "LOUD", F.lit("m"))


def base_alerts(spark, metadata={"k": "v"}):
    row = ("a", 1.7e9, "ERROR", "m", None, None, None, metadata, False, None, False, None, 1)
    return spark.createDataFrame([row], "id string, timestamp double, severity string, message string, event_id string, "
                                 "source string, correlation_id string, metadata map<string,string>, acknowledged boolean, "
                                 "acknowledged_at double, resolved boolean, resolved_at double, version int")


ACTION = "alert_id string, seq long, action string, key string, value string, ts double"


def test_lifecycle(spark):
    actions = [
        ("a", 1, "resolve", None, None, 10.0), ("a", 2, "set_metadata", "k", "w", 11.0),
        ("a", 3, "acknowledge", None, None, 12.0), ("a", 4, "remove_metadata", "k", None, 13.0),
        ("a", 5, "set_metadata", "z", "1", 14.0), ("a", 6, "resolve", None, None, 15.0),
        ("a", 7, "acknowledge", None, None, 16.0), ("a", 8, "set_metadata", "z", None, 17.0),
    ]
    current, refused = lifecycle.apply_actions(base_alerts(spark), spark.createDataFrame(actions, ACTION))
    row = current.first()
    assert (row.acknowledged, row.acknowledged_at, row.resolved, row.resolved_at) == (True, 16.0, True, 15.0)
    assert (row.version, row.metadata, row.dedup_key) == (5, {}, "ERROR|m")
    assert [r.seq for r in refused.collect()] == [1]


@pytest.mark.parametrize("limit", [1, 100])
def test_nested_metadata_is_cut_inside(spark, limit):
    values = {"k": json.dumps(["a" * 12_000, "tail", 7]), "o": json.dumps({"a": "b" * 12_000, "z": "tail"}), "p": "c" * 12_000}
    for key, want in (("k", ["a" * 10_000, "tail", 7]), ("o", {"a": "b" * 10_000, "z": "tail"}), ("p", "c" * 10_000)):
        actions = [("a", 1, "remove_metadata", "k", None, 1.0), ("a", 2, "set_metadata", key, values[key], 1.0)]
        current, _ = lifecycle.apply_actions(base_alerts(spark), spark.createDataFrame(actions, ACTION), limit)
        found = current.first().metadata
        assert list(found) == [key] and (found[key] if key == "p" else json.loads(found[key])) == want


@pytest.mark.parametrize("limit", [3, 100])
def test_metadata_limit(spark, limit):
    rng = random.Random(limit)
    actions, kept = [], {"k": "v"}
    for seq in range(1, 200):
        key = f"k{rng.randrange(6)}"
        value = rng.choice([None, str(seq), str(seq)])
        action = rng.choice(["set_metadata", "set_metadata", "remove_metadata"])
        actions.append(("a", seq, action, key, value, 1.0))
        if action == "remove_metadata" or value is None:
            kept.pop(key, None)
        elif key in kept or len(kept) < limit:
            kept[key] = value
    rng.shuffle(actions)
    current, _ = lifecycle.apply_actions(base_alerts(spark), spark.createDataFrame(actions, ACTION), limit)
    row = current.first()
    assert row.metadata == kept and row.version == 200

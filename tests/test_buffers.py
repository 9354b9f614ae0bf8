import json

from pyspark.sql import functions as F

from hostguard.sources.lines import read_event_records
from hostguard.streaming.counters import CounterSink


def test_records_with_unknown_keys_and_broken_lines(spark, tmp_path):
    lines = [
        json.dumps({"id": "a", "timestamp": 1.5, "severity": "7", "tags": ["x", "y"], "zone": "z", "n": 3, "deep": {"k": [1, None]}}),
        json.dumps({"id": "b", "data": {"zone": "inner", "own": "1"}, "zone": "outer", "tags": "one", "pid": "no", "severity": "bad"}),
        json.dumps({"id": "c", "data": "plain text"}), json.dumps({"id": None, "error": "own", "json": "own"}),
        "[1, 2]", "{broken", "   ", "", "null", "{}", json.dumps({"id": "é" * 50_000}),
    ]
    (tmp_path / "buffer.json").write_text("\n".join(lines), encoding="utf-8")
    rows = {(r.id or r.json or "empty")[:7]: r for r in read_event_records(spark, str(tmp_path)).collect()}
    assert len(rows) >= 7
    a, b = rows["a"], rows["b"]
    assert (a.timestamp, a.severity, a.tags, a.error, a.json) == (1.5, 7, ["x", "y"], None, None)
    assert a.data["zone"] == "z" and a.data["n"] == "3" and json.loads(a.data["deep"]) == {"k": [1, None]}
    assert b.data == {"own": "1", "zone": "outer"} and b.tags == ["one"] and b.error == "unreadable numbers: pid, severity"
    assert json.loads(b.json)["pid"] == "no" and b.pid is None
    for text in ("[1, 2]", "{broken", "null"):
        assert rows[text].error == "not a JSON object" and rows[text].json == text and rows[text].data is None
    assert rows["c"].error is None and "plain text" in rows["c"].data.values()


def test_counters_of_repeated_batches(spark, tmp_path):
    sink = CounterSink(str(tmp_path), "host", F.col("line").startswith("ok"), F.col("line") == "bad", F.col("at"))
    schema = "host string, line string, at double, source string, lines string"

    def send(number, *rows):
        sink(spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema), number)

    first = [("a", "ok 1", 1.0), ("a", "bad", 9.0), (None, "ok", 2.0), ("b", "other", 5.0), ("b", None, 6.0)]
    for _ in range(2):
        send(0, *first)
    send(1)
    send(2, ("a", "ok 2", 0.5), ("c", "ok", None))
    got = {r.source: tuple(r)[1:] for r in sink.totals(spark).collect()}
    assert got == {"a": (3, 2, 0, 1, 1.0), None: (1, 1, 0, 0, 2.0), "b": (2, 0, 1, 0, None), "c": (1, 1, 0, 0, None)}
    assert sink.batches(spark).filter("source = 'a'").count() == 2

import random

from pyspark.sql import functions as F

from hostguard.operators.state import replay
from hostguard.sources.deltas import DeltaState, Recovery, whole_parts
from hostguard.plans.table_queries import _recovery_inputs

FOLDER = "/root/testdata/sf0.001"
ROW = "ip string, state_json string, last_updated double, seq long, deleted boolean, _batch string"


def test_changes_add_up_and_follow_the_batch(spark, tmp_path):
    empty = spark.createDataFrame([], "ip string, state_json string, last_updated double")
    state, rnd, want = DeltaState(str(tmp_path), empty, compact_every=3), random.Random(1), {}
    for number in range(8):
        rows = []
        for seq in range(0 if number == 4 else 12):
            ip = rnd.choice(["a", "b", "c", "d", None])
            rows.append((ip, f"{number}.{seq}", float(rnd.randrange(3)), seq, rnd.choice([None, False, False, True]), "clash"))
        for row in sorted(rows, key=lambda r: (r[2], r[3])):
            want[row[0]] = None if row[4] else row[1]
        batch = spark.createDataFrame(rows, ROW)
        for _ in range(2 if number in (2, 5, 6) else 1):
            state(batch, number)
        got = {r.ip: r.state_json for r in state.state(spark).collect()}
        assert got == {k: v for k, v in want.items() if v is not None}, number
        assert spark.read.parquet(f"{tmp_path}/change={number}").count() <= 5
    # A base every third batch, the one before it, and the changes since that one.
    assert whole_parts(spark, str(tmp_path), "base") == [2, 5] and whole_parts(spark, str(tmp_path), "change") == [3, 4, 5, 6, 7]
    state(spark.createDataFrame([("z", "late", 0.0, 0, None, "x")], ROW), 8)
    assert whole_parts(spark, str(tmp_path), "base") == [5, 8] and whole_parts(spark, str(tmp_path), "change") == [6, 7, 8]
    assert {r.ip for r in state.state(spark).collect()} == {k for k, v in want.items() if v is not None} | {"z"}
    assert DeltaState(str(tmp_path / "none"), empty).state(spark).count() == 0


def test_recovery_in_steps_equals_one_replay(spark, tmp_path):
    states, histories, log = _recovery_inputs(spark, FOLDER)
    path = str(tmp_path / "log")
    log.repartitionByRange(6, "id").sortWithinPartitions("id").write.parquet(path)
    log = spark.read.parquet(path)
    recovery = Recovery(str(tmp_path / "state"), states, histories)
    last = log.agg(F.max("id")).first()[0]
    for step in (last // 4, last // 4, last // 2, last, last):
        recovery.advance(log.filter(F.col("id") <= step))
        if recovery.mark(spark)[0] == step:
            assert recovery.unread(log.filter(F.col("id") <= step)).count() == 0
    once = replay(states, histories, log)
    for got, want in zip(recovery.tables(spark), once):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert recovery.mark(spark) == (last, log.filter("checksum LIKE '000000%'").count())
    assert f"GreaterThan(id,{last})" in recovery.unread(log)._jdf.queryExecution().toString()
    # The log before the mark may be gone.
    recovery.advance(log.filter(F.col("id") > last))
    assert recovery.mark(spark)[0] == last and len(whole_parts(spark, str(tmp_path / "state/mark"), "version")) == 2

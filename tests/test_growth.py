"""What may not grow faster than the input: work per row, rows of one task, calls per key."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from hostguard.operators import alerts, thinning
from hostguard.operators.quantiles import exact_percentiles
from hostguard.plans.row_queries import p16_nested
from hostguard.plans.stream_queries import END, replayed
from hostguard.sources.snapshots import scratch_path
from hostguard.streaming import detectors
from hostguard.streaming.processors import CountingDetector
from hostguard.streaming.sinks import run_available
from test_detectors import START, S
from test_streaming import as_stream

FOLDER = "/root/testdata/sf0.001"


def test_nested_metadata_is_parsed_once(spark):
    """The text is parsed once, and a string with escapes once more when it is cut, however deep the steps nest."""
    df = spark.createDataFrame([("[]",)], "t string").select(alerts.cut_value(F.col("t")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2, plan


def test_nested_metadata_spreads_over_tasks(spark):
    rows = p16_nested(spark, FOLDER)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_strings_keep_their_places_when_nulls_go(spark):
    long = 'q"\\u\n' * 3000
    values = [
        {"a": None, "b": ["null", None, long, {"c": None}], "d": "x" * 12000, "e,null": "y"},
        [None, "0", "1", None, ["3", None, "z" * 10001], {"k" * 10001: None, "l" * 10001: "m" * 10002}],
        {"only": None, "n": [None, None]},
        ["\\" * 10001, '"' * 10001, "é" * 10001, None],
    ]

    def want(value):
        if isinstance(value, dict):
            return {k: want(v) for k, v in value.items() if v is not None}
        if isinstance(value, list):
            return [want(v) for v in value if v is not None]
        return value[:10000]

    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    got = {r.i: json.loads(r.v) for r in df.select("i", alerts.cut_value(F.col("t")).alias("v")).collect()}
    assert got == {i: want(v) for i, v in enumerate(values)}


def test_exact_percentiles_equal_sparks(spark):
    rng = random.Random(3)
    for values in ([rng.randrange(-50, 10**12) for _ in range(999)], [7] * 20 + [8, None], [5], [None]):
        df = spark.createDataFrame([(v,) for v in values], "v bigint")
        fractions = [i / 10 for i in range(11)]
        assert exact_percentiles(df, F.col("v"), fractions) == (df.agg(F.percentile("v", fractions)).first()[0] or [])


def test_replay_has_many_files_a_batch(spark):
    """Micro-batches keep their bounds, ties in one of them included, and no task reads a whole one."""
    times = [10 * i for i in range(60)] + [595] * 60
    df = spark.createDataFrame(list(enumerate(times)), "seq int, s int").withColumn("ts", F.timestamp_seconds("s"))
    end = df.limit(1).select(F.lit(-1).alias("seq"), F.lit(0).alias("s"), F.lit(None).cast("timestamp").alias("ts"))
    seen = []

    def sink(batch, _):
        seen.append(([r.seq for r in batch.collect()], batch.select(F.input_file_name()).distinct().count()))

    stream = replayed(spark, df, end, files=4, file_rows=8)
    run_available(stream, sink, scratch_path(df, "checkpoint"))
    cuts = df.agg(F.percentile("s", [0.25, 0.5, 0.75])).first()[0]
    want = [[i for i, s in enumerate(times) if sum(s > c for c in cuts) == part] for part in range(4)]
    assert [sorted(seqs) for seqs, _ in seen] == want + [[-1]]
    assert max(files for _, files in seen) > 1


def test_repeats_of_many_keys_share_calls(spark):
    rng = random.Random(4)
    rows = [(i, START + rng.randrange(40) * S // 2, rng.choice([None, rng.randrange(900)]), f"k{i % 2}") for i in range(3000)]
    rows.sort(key=lambda r: (r[1], r[0]))
    df = spark.createDataFrame(rows, "seq bigint, ts_us bigint, n bigint, k string")
    parts = [df.filter(f"ts_us {sign} {START + 10 * S}").withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")
             for sign in ("<", ">=")]
    end = parts[0].limit(1).withColumns({"seq": F.lit(-1).cast("bigint"), "ts": F.expr(END)}).select(parts[0].columns)
    detectors.use_rocksdb(spark)
    path, seen = scratch_path(df, "out"), []
    query = (
        detectors.suppress_repeats(as_stream(spark, [*parts, end], 1), ["n", "k"]).writeStream
        .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"))
        .option("checkpointLocation", scratch_path(df, "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(totals) <= 2 * 512, totals
    got = spark.read.parquet(path).filter("seq >= 0").select("seq", "n", "k").collect()
    want = thinning.suppress_repeats(df, ["n", "k"]).select("seq", "n", "k").collect()
    assert sorted(got, key=lambda r: r.seq) == sorted(want, key=lambda r: r.seq)


def test_counting_in_runs_equals_row_by_row():
    rng = random.Random(5)
    width, threshold, cooldown = 1000, 12, 700
    ts = sorted(rng.randrange(1, 20_000) for _ in range(400))
    rows = [(t, i, rng.randrange(1, 4), f"ip{i}") for i, t in enumerate(ts)]
    want, inside, fired = [], [], 0
    for t, seq, weight, label in rows:
        inside = [(a, w) for a, w in inside + [(t, weight)] if t - a < width]
        counted = sum(w for _, w in inside)
        if counted >= threshold and t - fired >= cooldown:
            fired = t
            want.append((seq, t, counted, label))
    detector, state, got = CountingDetector("k", width, threshold, cooldown), None, []
    for low, high in [(0, 0), (1, 150), (151, 152), (153, 399)]:
        frame = pd.DataFrame(rows[low : high + 1], columns=["ts_us", "seq", "weight", "label"])
        state, found = detector.fold(state, frame, rows[high][0])
        got += found
    assert got == want and len(got) > 5
    assert len(state[0]) == 8 * len(inside) and state[2] == fired

"""All six rules on a stream, micro-batch by micro-batch, with the operators of the batch form.

Each micro-batch takes the rows that have become final (older than the newest row seen by ``delay``) together with what
earlier batches left behind, and runs the batch operators over both. So the result is row by row that of the batch rules:
counts have the resolution of a microsecond, alerts name their address, and hot addresses, networks and the global count
are split by the same ranges as in a batch (``SkewPolicy``); no task follows one key. What is left behind is

* ``recent``: rows still inside the network or global window,
* ``context``: per address not idle, the rows that later counts and thresholds reach back to (those inside the longest
  window, and the last ``baseline_max_history`` - 1 with the time window before them), each with the score after it; the
  first of them opens the address's score, so older rows are not needed,
* ``fired``: the last alert of every key whose cooldown runs,
* ``waiting``: rows that are not final yet,

all bounded by the windows and the rows of a batch, never by the length of the stream. Versions are written under the
batch id; the one before is kept, so a repeated batch finds the same past and overwrites its own output.

Rows that arrive after their time was closed go to a side table ``late`` and are counted, as rows without a time are:
rows in = rows taken + late + waiting, in every version's ``marks``.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostguard.config import DetectionConfig
from hostguard.operators.rules import RULE_COLUMNS, address_candidates, cool_down, global_candidates, subnet_candidates
from hostguard.operators.skew import SkewPolicy
from hostguard.operators.windows import address_metrics
from hostguard.session import Scratch

ATTEMPT = "seq bigint, ts_us bigint, ip string"
ALERT = (
    "rule string, rule_order int, key string, seq bigint, ts_us bigint, ip string, metric double, threshold double, message string"
)
STATE = {
    "recent": ATTEMPT,
    "context": f"{ATTEMPT}, opening bigint",
    "fired": ALERT,
    "waiting": ATTEMPT,
    "marks": "mark_us bigint, seen_us bigint, rows bigint, taken bigint, late bigint",
}
RULES = ("baseline", "burst", "risk", "global", "escalation", "subnet")
BY_ADDRESS = ("baseline", "burst", "risk", "escalation")
ENDED = -1


class IncrementalDetector:
    """A ``foreachBatch`` sink for attempts (ts_us or ts, seq, ip) that keeps alerts and state below ``folder``."""

    def __init__(
        self,
        folder: str,
        cfg: DetectionConfig = DetectionConfig(),
        policy: SkewPolicy = SkewPolicy(),
        delay_s: float = 10.0,
        rules: tuple[str, ...] = RULES,
    ) -> None:
        self.folder, self.cfg, self.policy, self.rules = folder.rstrip("/"), cfg, policy, rules
        self.delay_us = round(delay_s * 1_000_000)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._step(batch.sparkSession, batch, batch_id, ended=False)

    def finish(self, spark: SparkSession) -> None:
        """Take the rows that still wait, once the stream has ended. The state stays as it is."""
        self._step(spark, spark.createDataFrame([], ATTEMPT), ENDED, ended=True)

    def alerts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{ALERT}, batch bigint").parquet(f"{self.folder}/alerts").drop("batch")

    def late_rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{ATTEMPT}, batch bigint").parquet(f"{self.folder}/late").drop("batch")

    def marks(self, spark: SparkSession) -> DataFrame:
        """The counters after the newest micro-batch."""
        versions = self._versions(spark)
        return self._read(spark, max(versions) if versions else None, "marks")

    def _step(self, spark: SparkSession, batch: DataFrame, batch_id: int, ended: bool) -> None:
        scratch, versions = Scratch(spark), self._versions(spark)
        past = max((v for v in versions if ended or v < batch_id), default=None)
        before = self._read(spark, past, "marks").first()
        mark, seen, n_rows, n_taken, n_late = tuple(before) if before else (None, None, 0, 0, 0)
        at = F.col("ts_us") if "ts_us" in batch.columns else F.unix_micros("ts")
        closed = F.lit(False) if mark is None else F.col("ts_us") <= mark
        rows = batch.select(F.col("seq").cast("bigint").alias("seq"), at.cast("bigint").alias("ts_us"), F.col("ip").cast("string").alias("ip"))
        rows = scratch.keep(rows.withColumn("late", F.col("ts_us").isNull() | closed))
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"), F.max("ts_us").alias("seen")).first()
        newest = max((t for t in (seen, facts.seen) if t is not None), default=None)
        bound = newest if ended or newest is None else newest - self.delay_us
        bound = max((t for t in (mark, bound) if t is not None), default=None)
        arrived = rows.filter("NOT late").drop("late").unionByName(self._read(spark, past, "waiting"))
        final = F.lit(False) if bound is None else F.col("ts_us") <= bound
        taken, waiting = scratch.keep(arrived.filter(final)), arrived.filter(~final)
        n = taken.count()
        if n:
            fired, left = self._detect(spark, taken, past, mark, bound, scratch)
        else:
            fired = spark.createDataFrame([], ALERT)
            left = {name: self._read(spark, past, name) for name in ("recent", "context", "fired")}
        fired.write.mode("overwrite").parquet(f"{self.folder}/alerts/batch={batch_id}")
        rows.filter("late").drop("late").write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")
        if not ended:
            marks = spark.createDataFrame([(bound, newest, n_rows + facts.n, n_taken + n, n_late + facts.late)], STATE["marks"])
            for name, table in [*left.items(), ("waiting", waiting), ("marks", marks)]:
                # The marks come last: a version that has them is whole.
                table.write.mode("overwrite").parquet(f"{self.folder}/state/version={batch_id}/{name}")
            for old in sorted(v for v in versions if v < batch_id)[:-1]:
                scratch.drop_folder(f"{self.folder}/state/version={old}")
        scratch.close()

    def _detect(self, spark, taken: DataFrame, past: int | None, mark: int | None, bound: int, scratch: Scratch):
        """(alerts among ``taken``, the tables left for the next batch)."""
        cfg, new = self.cfg, F.col("ts_us") > (mark if mark is not None else -(2**62))
        parts, left = [], {}
        recent = scratch.keep(self._read(spark, past, "recent").unionByName(taken))
        context = scratch.keep(self._read(spark, past, "context").unionByName(taken, allowMissingColumns=True))
        few = max(context.count(), recent.count()) <= self.policy.hot_rows
        policy = replace(self.policy, hot_rows=math.inf) if few else self.policy
        by_address = [rule for rule in self.rules if rule in BY_ADDRESS]
        left["context"] = context.limit(0)
        if by_address:
            metrics = scratch.keep(address_metrics(context, cfg, policy))
            parts.append(address_candidates(metrics, cfg, policy, by_address, measured=True).filter(new))
            left["context"] = self._context(metrics, bound)
        if "global" in self.rules:
            parts.append(global_candidates(recent, cfg, policy).filter(new))
        if "subnet" in self.rules:
            parts.append(subnet_candidates(recent, cfg, policy).filter(new))
        width = max(cfg.us("global_time_window"), cfg.us("subnet_window"))
        left["recent"] = recent.filter(F.col("ts_us") > bound - width)
        # Alerts whose cooldown runs go first on their key, so what follows is thinned as if there were no batches.
        earlier = self._read(spark, past, "fired")
        seeds = earlier.withColumn("_seed", F.lit(True))
        candidates = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, seeds])
        candidates = scratch.keep(candidates.withColumn("_seed", F.coalesce("_seed", F.lit(False))).select(*RULE_COLUMNS, "_seed"))
        fired = scratch.keep(cool_down(candidates, cfg, policy))
        last = fired.groupBy("key").agg(F.max_by(F.struct(*[c for c in RULE_COLUMNS if c != "key"]), F.struct("ts_us", "seq")).alias("_last"))
        running = last.select("key", "_last.*").select(*RULE_COLUMNS).filter(F.col("ts_us") > bound - cfg.us("alert_cooldown"))
        left["fired"] = running
        return fired.filter("NOT _seed").drop("_seed"), left

    def _context(self, metrics: DataFrame, bound: int) -> DataFrame:
        """The rows of addresses that are not idle which later rows reach back to, with the score after each."""
        cfg = self.cfg
        longest = max(cfg.us("time_window"), cfg.us("burst_window") + 1, cfg.us("escalation_window"))
        newest = metrics.groupBy("ip").agg(F.max("n").alias("_n"), F.max("session").alias("_session"), F.max("ts_us").alias("_ts"))
        newest = newest.filter(F.col("_ts") >= bound + 1 - cfg.us("ip_ttl")).withColumnRenamed("ip", "_ip")
        rows = metrics.select("seq", "ts_us", "ip", "n", "session", "score_units")
        rows = rows.join(_checked(newest, self.policy), F.col("ip").eqNullSafe(F.col("_ip"))).filter(F.col("session") == F.col("_session"))
        history = F.min(F.when(F.col("n") > F.col("_n") - (cfg.baseline_max_history - 1), F.col("ts_us")))
        reach = rows.groupBy(F.col("ip").alias("_reach_ip")).agg(
            F.least(F.coalesce(history, F.lit(bound)) - cfg.us("time_window"), F.lit(bound + 1 - longest)).alias("_from")
        )
        # The newest row stays whatever the windows: it carries the score and the time of the last attempt.
        kept = rows.join(_checked(reach, self.policy), F.col("ip").eqNullSafe(F.col("_reach_ip")))
        kept = kept.filter((F.col("ts_us") > F.col("_from")) | (F.col("n") == F.col("_n")))
        return kept.select("seq", "ts_us", "ip", F.col("score_units").alias("opening"))

    def _read(self, spark: SparkSession, version: int | None, name: str) -> DataFrame:
        if version is None:
            return spark.createDataFrame([], STATE[name])
        return spark.read.schema(STATE[name]).parquet(f"{self.folder}/state/version={version}/{name}")

    def _versions(self, spark: SparkSession) -> list[int]:
        """Whole versions: those whose marks are written."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [status.getPath().getName() for status in files.listStatus(path)]
        whole = [n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state/{n}/marks/_SUCCESS"))]
        return [int(n.partition("=")[2]) for n in whole]


def _checked(df: DataFrame, policy: SkewPolicy) -> DataFrame:
    return F.broadcast(df) if df.count() <= policy.broadcast_keys else df

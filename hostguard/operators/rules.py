"""The six brute-force rules, their cooldowns and the combined alert set."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostguard.config import DetectionConfig
from hostguard.operators.skew import SkewPolicy, heavy_keys
from hostguard.operators.thinning import thin
from hostguard.operators.windows import address_metrics, global_counts, subnet_counts

RULE_COLUMNS = ["rule", "rule_order", "key", "seq", "ts_us", "ip", "metric", "threshold", "message"]


@dataclass(frozen=True)
class Rule:
    """When an attempt is a candidate, on what key its cooldown runs, and what the alert says.

    All but ``name`` and ``order`` are SQL expressions over the metric columns; ``message`` is a format string
    and its arguments.
    """

    name: str
    order: int
    fires: str
    key: str
    metric: str
    threshold: str
    message: tuple[str, ...]

    @property
    def struct(self) -> str:
        template, *arguments = self.message
        return (
            f"named_struct('rule', '{self.name}', 'rule_order', {self.order}, 'key', {self.key}, "
            f"'metric', CAST({self.metric} AS DOUBLE), 'threshold', CAST({self.threshold} AS DOUBLE), "
            f"'message', format_string('{template}', {', '.join(arguments)}))"
        )


def _seconds(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else str(value)


def score_text(cfg: DetectionConfig) -> str:
    """The score in points, without trailing zeros."""
    points = f"CAST(CAST(score_units AS DECIMAL(20,0)) / CAST({cfg.units_per_point}L AS DECIMAL(18,0)) AS DECIMAL(27,6))"
    return rf"regexp_replace(CAST({points} AS STRING), r'(\.\d+?)0+$', '$1')"


# The messages of the six rules, with the window in seconds where there are braces.
BASELINE_TEXT = "Behavioural anomaly detected from IP %s (count=%d, threshold=%.2f)"
BURST_TEXT = "Burst attack detected from IP %s (burst_count=%d)"
RISK_TEXT = "High risk intrusion detected from IP %s (score=%s)"
GLOBAL_TEXT = "Distributed brute force attack detected (attempts=%d in last {}s)"
ESCALATION_TEXT = "Slow progressive attack detected from IP %s (attempts=%d in last {}s)"
SUBNET_TEXT = "Subnet attack detected from %s (attempts=%d in last {}s)"


def address_rules(cfg: DetectionConfig) -> list[Rule]:
    return [
        Rule(
            "baseline", 1, "above_threshold", "concat('baseline_', ip)", "failed_count", "threshold",
            (BASELINE_TEXT, "ip", "failed_count", "threshold"),
        ),
        Rule(
            "burst", 2, f"burst_count >= {cfg.burst_threshold}", "concat('burst_', ip)", "burst_count",
            str(cfg.burst_threshold), (BURST_TEXT, "ip", "burst_count"),
        ),
        Rule(
            "risk", 3, f"score_units >= {cfg.risk_threshold * cfg.units_per_point}L", "concat('risk_', ip)", "score",
            str(cfg.risk_threshold), (RISK_TEXT, "ip", score_text(cfg)),
        ),
        Rule(
            "escalation", 5, f"escalation_count >= {cfg.escalation_threshold}", "concat('escalation_', ip)",
            "escalation_count", str(cfg.escalation_threshold),
            (ESCALATION_TEXT.format(_seconds(cfg.escalation_window)), "ip", "escalation_count"),
        ),
    ]


def global_rule(cfg: DetectionConfig) -> Rule:
    return Rule(
        "global", 4, f"global_count >= {cfg.global_threshold}", "'global_bruteforce'", "global_count",
        str(cfg.global_threshold),
        (GLOBAL_TEXT.format(_seconds(cfg.global_time_window)), "global_count"),
    )


def subnet_rule(cfg: DetectionConfig) -> Rule:
    return Rule(
        "subnet", 6, f"subnet_count >= {cfg.subnet_threshold}", "concat('subnet_', subnet)", "subnet_count",
        str(cfg.subnet_threshold),
        (SUBNET_TEXT.format(_seconds(cfg.subnet_window)), "subnet", "subnet_count"),
    )


def _candidates(metrics: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per attempt and rule that it meets, all rules read off one pass over the metrics."""
    any_fires = " OR ".join(rule.fires for rule in rules)
    fired = ", ".join(f"CASE WHEN {rule.fires} THEN {rule.struct} END" for rule in rules)
    flag = [c for c in metrics.columns if c == "_hot"]
    rows = metrics.filter(any_fires).selectExpr("seq", "ts_us", "ip", *flag, f"inline(array_compact(array({fired})))")
    return rows.select(*RULE_COLUMNS, *flag)


def address_candidates(
    attempts: DataFrame,
    cfg: DetectionConfig = DetectionConfig(),
    policy: SkewPolicy = SkewPolicy(),
    rules: list[str] | None = None,
    measured: bool = False,
) -> DataFrame:
    """``measured`` says that ``attempts`` has the columns of ``address_metrics`` already."""
    chosen = [rule for rule in address_rules(cfg) if rules is None or rule.name in rules]
    return _candidates(attempts if measured else address_metrics(attempts, cfg, policy), chosen)


def global_candidates(
    attempts: DataFrame, cfg: DetectionConfig = DetectionConfig(), policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    counted = global_counts(attempts, cfg, policy)
    # All candidates share one cooldown key, so it is hot as soon as there are many attempts at all.
    everything = attempts.select(F.lit("global_bruteforce").alias("key"))
    if heavy_keys(everything, ["key"], policy) is not None:
        counted = counted.withColumn("_hot", F.lit(True))
    return _candidates(counted, [global_rule(cfg)])


def subnet_candidates(
    attempts: DataFrame, cfg: DetectionConfig = DetectionConfig(), policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    return _candidates(subnet_counts(attempts, cfg, policy), [subnet_rule(cfg)])


def cool_down(
    candidates: DataFrame,
    cfg: DetectionConfig = DetectionConfig(),
    policy: SkewPolicy = SkewPolicy(),
    flagged: bool = False,
) -> DataFrame:
    """Candidates that fire: per key, the last alert must be at least ``alert_cooldown`` old.

    ``flagged`` candidates come straight from this module, where hot keys were found by their attempts; other
    candidates have their keys counted first.
    """
    gap = cfg.us("alert_cooldown")
    # A key that never fired counts as fired at the epoch.
    candidates = candidates.filter(F.col("ts_us") >= gap)
    return thin(candidates, ["key"], gap, policy, hot_flag="_hot" if flagged else None)


def rule_alerts(
    attempts: DataFrame,
    cfg: DetectionConfig = DetectionConfig(),
    policy: SkewPolicy = SkewPolicy(),
    rules: list[str] | None = None,
) -> DataFrame:
    """Alerts of the chosen rules (all six by default) in the order they are raised."""
    attempts, policy = policy.prepare(attempts.select("seq", "ts_us", "ip"))
    wanted = {"baseline", "burst", "risk", "global", "escalation", "subnet"} if rules is None else set(rules)
    parts = []
    by_address = wanted & {"baseline", "burst", "risk", "escalation"}
    if by_address:
        parts.append(address_candidates(attempts, cfg, policy, sorted(by_address)))
    if "global" in wanted:
        parts.append(global_candidates(attempts, cfg, policy))
    if "subnet" in wanted:
        parts.append(subnet_candidates(attempts, cfg, policy))
    candidates = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    fired = cool_down(candidates, cfg, policy, flagged=True)
    return fired.select(*RULE_COLUMNS).orderBy("ts_us", "seq", "rule_order")

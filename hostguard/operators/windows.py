"""Sliding counts, idle sessions, rolling thresholds and decayed scores over login attempts.

Input everywhere: attempts (seq, ts_us, ip), ordered by (ts_us, seq). A trailing count is kept as a running
total of +1 for each attempt and -1 at the moment that attempt leaves the window. This counts exactly the
attempts processed so far (equal timestamps included), costs the same for sparse and dense windows, and needs
only totals that ``keyed_scan`` can split for hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostguard.config import DetectionConfig, as_fraction
from hostguard.functions.ip import subnet_of
from hostguard.operators.skew import Running, Scan, SkewPolicy, keyed_scan

ATTEMPT_ORDER = ["ts_us", "seq"]
MOMENT_ORDER = ["_at", "_entering", "seq"]


def with_moments(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One row per attempt (``_entering`` = 1) and one row per window it leaves (``_entering`` = 0).

    ``widths`` maps a counter column to its strict width in microseconds: an attempt is counted while
    ``now - ts_us < width``.
    """

    def moment(at: str, entering: int, changes: dict[str, int]) -> str:
        deltas = [f"'{name}', {changes.get(name, 0)}L" for name in widths]
        return f"named_struct('_at', {at}, '_entering', {entering}, {', '.join(deltas)})"

    moments = [moment("ts_us", 1, dict.fromkeys(widths, 1))]
    moments += [moment(f"ts_us + {width}L", 0, {name: -1}) for name, width in widths.items()]
    return df.selectExpr("*", f"inline(array({', '.join(moments)}))")


def sessions(scan: Scan, ttl_us: int) -> Scan:
    """Number the attempts of a key and mark where an idle gap longer than ``ttl_us`` starts a new session."""
    scan = scan.running(
        prev_ts=Running("max", F.col("ts_us"), before=True),
        n=Running("sum", F.lit(1).cast("bigint")),
    )
    scan = scan.derive(_opens=F.expr(f"prev_ts IS NULL OR ts_us - prev_ts > {ttl_us}L"))
    scan = scan.running(
        session=Running("sum", F.col("_opens").cast("bigint")),
        _first_n=Running("max", F.expr("CASE WHEN _opens THEN n END")),
        _began=Running("max", F.expr("CASE WHEN _opens THEN ts_us END")),
    )
    return scan.derive(position=F.expr("n - _first_n + 1"))


def scores(scan: Scan, cfg: DetectionConfig) -> Scan:
    """Score added by each attempt and the decayed score after it, in whole units of ``cfg.units_per_point``.

    With a = added, A = running sum of a and D = decay up to the attempt, the fold
    ``score = max(0, score - decay) + a`` equals ``A - D + max(D_k - A_k + a_k)`` over the attempts k of the
    session. The maximum is taken of (session, level), which starts it afresh in every session.
    """
    recent = f"NOT _opens AND ts_us - prev_ts < {cfg.us('time_window')}L"
    rapid = f"{recent} AND ts_us - prev_ts < {cfg.us('rapid_window')}L"
    points = F.expr(
        f"CAST({cfg.failed_login_score} + CASE WHEN {recent} THEN {cfg.repeat_penalty} ELSE 0 END"
        f" + CASE WHEN {rapid} THEN {cfg.rapid_attempt_bonus} ELSE 0 END AS BIGINT)"
    )
    added = f"increment * {cfg.units_per_point}L"
    if "opening" in scan.df.columns:
        # The first row of a key that was cut off from its past starts with the score it had.
        added = f"CASE WHEN _opens AND opening IS NOT NULL THEN opening ELSE {added} END"
    scan = scan.derive(increment=points).derive(_added=F.expr(added)).running(_added_sum=Running("sum", F.col("_added")))
    # Time since the session's first attempt, so that the product stays small whatever the epoch.
    decay = f"(ts_us - _began) * {cfg.decay_units}L"
    level = F.expr(f"named_struct('session', session, 'level', {decay} - _added_sum + _added)")
    scan = scan.derive(_level=level).running(_top=Running("max", F.col("_level")))
    return scan.derive(score_units=F.expr(f"_added_sum - {decay} + _top.level"))


def history_totals(scan: Scan, cfg: DetectionConfig) -> Scan:
    """Size, sum and sum of squares of the last ``baseline_max_history`` counts of the session."""
    steps = cfg.baseline_max_history
    square = "CAST(CAST(failed_count AS DECIMAL(19,0)) * CAST(failed_count AS DECIMAL(19,0)) AS DECIMAL(28,0))"
    scan = scan.derive(_square=F.expr(square)).running(
        _sum=Running("sum", F.col("failed_count")),
        _squares=Running("sum", F.col("_square")),
    )
    scan = scan.running(
        _sum_open=Running("max", F.expr("CASE WHEN position = 1 THEN _sum - failed_count END")),
        _squares_open=Running("max", F.expr("CASE WHEN position = 1 THEN _squares - _square END")),
    ).lagged("n", steps, _sum_old="_sum", _squares_old="_squares")
    # Both running totals only grow, so the later of the two starting points is the larger one.
    return scan.derive(
        history_n=F.expr(f"least(position, {steps}L)"),
        history_sum=F.expr("_sum - greatest(_sum_old, _sum_open)"),
        history_squares=F.expr("CAST(_squares - greatest(_squares_old, _squares_open) AS DECIMAL(38,0))"),
    )


def with_threshold(df: DataFrame, cfg: DetectionConfig, value: str) -> DataFrame:
    """Add ``threshold`` (double, for reports) and ``above_threshold`` (exact, in whole numbers)."""
    multiplier = float(cfg.baseline_std_multiplier)
    factor = as_fraction(cfg.baseline_std_multiplier) ** 2
    total = "CAST(history_sum AS DECIMAL(19,0))"
    n = "CAST(history_n AS DECIMAL(9,0))"
    spread = f"CAST({n} * history_squares - {total} * {total} AS DECIMAL(38,0))"
    stdev = f"CASE WHEN history_n = 1 THEN 1.0D ELSE sqrt(CAST({spread} AS DOUBLE) / (history_n * (history_n - 1))) END"
    lead = f"CAST({n} * CAST({value} AS DECIMAL(19,0)) - {total} AS DECIMAL(19,0))"
    # The factors as whole numbers: nine digits for an ordinary multiplier, 19 for one with many decimals.
    largest = max(factor.denominator, factor.numerator) * cfg.baseline_max_history
    if largest >= 10**19:
        raise ValueError(f"baseline_std_multiplier {multiplier} has too many digits to be compared exactly")
    wide = f"DECIMAL({9 if largest < 10**9 else 19},0)"
    over = f"""{lead} > 0 AND {lead} * {lead} * CAST(CAST(history_n - 1 AS DECIMAL(9,0)) * {factor.denominator} AS {wide})
               > {spread} * CAST({n} * {factor.numerator} AS {wide})"""
    return df.selectExpr(
        "*",
        f"""CASE WHEN history_n >= {cfg.baseline_min_samples} THEN history_sum / history_n + {multiplier}D * {stdev}
            ELSE {float(cfg.baseline_default_threshold)}D END AS threshold""",
        f"""CASE WHEN history_n < {cfg.baseline_min_samples} THEN {value} > {cfg.baseline_default_threshold}
            WHEN history_n = 1 THEN {value} > history_sum + {multiplier}D
            ELSE {over} END AS above_threshold""",
    )


def _address_body(cfg: DetectionConfig):
    widths = {
        "failed_count": cfg.us("time_window"),
        # The burst window includes its far edge; it looks only at attempts still inside the time window.
        "burst_count": min(cfg.us("burst_window") + 1, cfg.us("time_window")),
        "escalation_count": cfg.us("escalation_window"),
    }
    kept = ["seq", "ts_us", "ip", "n", "session", "position", "increment", "score_units"]

    def body(scan: Scan) -> DataFrame:
        scan = scores(sessions(scan, cfg.us("ip_ttl")), cfg)
        scan = scan.reordered(with_moments(scan.df.select(*kept), widths), MOMENT_ORDER)
        scan = scan.running(**{name: Running("sum", F.col(name)) for name in widths})
        scan = scan.filter(F.col("_entering") == 1)
        # A session never reaches back past its first attempt.
        scan = scan.derive(**{name: F.expr(f"least({name}, position)") for name in widths})
        scan = history_totals(scan, cfg)
        outputs = [*kept, *widths, "history_n", "history_sum", "history_squares"]
        result = with_threshold(scan.df.select(*outputs), cfg, "failed_count")
        return result.selectExpr("*", f"score_units / {cfg.units_per_point}L AS score")

    return body


def address_metrics(
    attempts: DataFrame, cfg: DetectionConfig = DetectionConfig(), policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """Session, counts, rolling threshold and risk score of every attempt, all per address.

    Where ``attempts`` has a column ``opening``, it is the score after a row whose earlier rows are not there.
    """
    columns = attempts.select("seq", "ts_us", "ip", *[c for c in attempts.columns if c == "opening"])
    return keyed_scan(columns, ["ip"], ATTEMPT_ORDER, _address_body(cfg), policy, hot_flag="_hot")


def idle_sessions(
    attempts: DataFrame, cfg: DetectionConfig = DetectionConfig(), policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    def body(scan: Scan) -> DataFrame:
        return sessions(scan, cfg.us("ip_ttl")).df.select("seq", "ts_us", "ip", "session", "position")

    return keyed_scan(attempts.select("seq", "ts_us", "ip"), ["ip"], ATTEMPT_ORDER, body, policy)


def risk_scores(
    attempts: DataFrame, cfg: DetectionConfig = DetectionConfig(), policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    def body(scan: Scan) -> DataFrame:
        scored = scores(sessions(scan, cfg.us("ip_ttl")), cfg).df
        score = f"score_units / {cfg.units_per_point}L AS score"
        return scored.selectExpr("seq", "ts_us", "ip", "session", "increment", "score_units", score)

    return keyed_scan(
        attempts.select("seq", "ts_us", "ip"), ["ip"], ATTEMPT_ORDER, body, policy, hot_flag="_hot"
    )


def trailing_count(
    df: DataFrame,
    keys: list[str],
    width_us: int,
    name: str,
    policy: SkewPolicy = SkewPolicy(),
    hot_flag: str | None = None,
) -> DataFrame:
    """Rows of the same key with ``now - ts_us < width_us``, the row itself included, rows up to now only."""

    def body(scan: Scan) -> DataFrame:
        scan = scan.reordered(with_moments(scan.df, {name: width_us}), MOMENT_ORDER)
        scan = scan.running(**{name: Running("sum", F.col(name))}).filter(F.col("_entering") == 1)
        return scan.df.drop("_at", "_entering")

    return keyed_scan(df, keys, ATTEMPT_ORDER, body, policy, hot_flag)


def subnet_counts(
    attempts: DataFrame, cfg: DetectionConfig = DetectionConfig(), policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """Attempts per network in the trailing window; attempts without a valid address have no row."""
    rows = attempts.select("seq", "ts_us", "ip", subnet_of(F.col("ip"), cfg.subnet_prefixlen).alias("subnet"))
    rows = rows.filter(F.col("subnet").isNotNull())
    return trailing_count(rows, ["subnet"], cfg.us("subnet_window"), "subnet_count", policy, hot_flag="_hot")


def global_counts(
    attempts: DataFrame, cfg: DetectionConfig = DetectionConfig(), policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """Attempts of all addresses in the trailing window.

    Time is cut in buckets as wide as the window. What is in the window at the start of a bucket is the whole
    bucket before it, a small grouped count; inside the bucket the +1 / -1 total runs on. No task sees more
    than one bucket, and a hot bucket is cut in ranges.
    """
    width = cfg.us("global_time_window")
    rows = attempts.select("seq", "ts_us", "ip")
    bucket = F.expr(f"(ts_us - pmod(ts_us, {width}L)) div {width}L")
    moments = with_moments(rows, {"global_count": width})
    moments = moments.withColumn("_bucket", F.expr(f"(_at - pmod(_at, {width}L)) div {width}L"))
    # One opening row per bucket, before all others, adds what the bucket before has left in the window.
    opening = rows.groupBy((bucket + 1).alias("_bucket")).agg(F.count(F.lit(1)).alias("global_count"))
    opening = opening.withColumns({"_at": F.col("_bucket") * width, "_entering": F.lit(-1)})

    def body(scan: Scan) -> DataFrame:
        scan = scan.running(global_count=Running("sum", F.col("global_count"))).filter(F.col("_entering") == 1)
        return scan.df.drop("_at", "_entering")

    counted = keyed_scan(moments.unionByName(opening, allowMissingColumns=True), ["_bucket"], MOMENT_ORDER, body, policy)
    return counted.select("seq", "ts_us", "ip", "global_count")

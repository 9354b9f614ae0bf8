"""Per-key stream state: rows wait until the watermark has passed them and are then taken in time order.

Because of the wait, rows that arrive out of order but not late give the same result as the batch operators.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hostguard.config import DetectionConfig, as_fraction

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[DetectionConfig.__module__])


def packed(frame: pd.DataFrame) -> bytes:
    """Rows as the bytes of one Arrow stream: state then holds a value per run of rows, not one per row."""
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_pandas()


class OrderedProcessor(StatefulProcessor):
    """Hold rows back until they are final. Subclasses keep ``state_schema`` state and fold runs of rows.

    The state of a key goes when the watermark passes ``forgets_at``, the time from which on a new row would find the
    same as a key without state.
    """

    state_schema: str
    # Rows that wait, one value per call that brought some.
    pending_schema = "rows binary"
    waits = ["ts_us", "seq", "weight", "label"]
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.pending_schema)
        self.kept = handle.getValueState("kept", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            if len(batch):
                first = int(batch["ts_us"].min())
                earliest = first if earliest is None else min(earliest, first)
                self.pending.appendValue((packed(batch[[c for c in self.waits if c in batch]]),))
        # One timer for the earliest row: when it fires, all final rows are taken and the next one is set.
        if earliest is not None:
            self.handle.registerTimer(earliest // 1000 + 1)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [unpacked(row[0]) for row in self.pending.get()]
        rows = pd.concat(waiting, ignore_index=True) if waiting else None
        is_final = rows["ts_us"].to_numpy() <= final if waiting else np.zeros(0, bool)
        if not is_final.any():
            # An earlier timer of this batch has taken the rows already, or the key has been idle.
            if not waiting and self.kept.exists():
                self._forget(self.kept.get(), final)
            yield pd.DataFrame(columns=self.columns)
            return
        self.pending.clear()
        later = rows[~is_final]
        if len(later):
            self.pending.appendValue((packed(later),))
            self.handle.registerTimer(int(later["ts_us"].min()) // 1000 + 1)
        ready = rows[is_final].sort_values(["ts_us", "seq"], kind="stable", ignore_index=True)
        state, found = self.fold(self.kept.get() if self.kept.exists() else None, ready, final)
        self.kept.update(state)
        if not len(later):
            self._forget(state, final)
        yield self.output(key, found)

    def output(self, key, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *row) for row in found], columns=self.columns)

    def _forget(self, state, final: int) -> None:
        """Drop the state if it is due, or come back when it is."""
        due = self.forgets_at(state)
        if due <= final:
            self.kept.clear()
        else:
            self.handle.registerTimer(due // 1000 + 1)

    def forgets_at(self, state) -> int:
        raise NotImplementedError

    def fold(self, state, ready: pd.DataFrame, final: int):
        """(new state, output rows without the key) for rows (ts_us, seq, weight, label) in time order.

        Rows up to ``final`` have all come.
        """
        raise NotImplementedError

    def close(self) -> None:
        pass


class AddressDetector(OrderedProcessor):
    """Baseline, burst, risk and escalation rules of one address, with their cooldowns.

    The idle test on arrival resets an address exactly when the eviction of the batch rules does.
    """

    state_schema = "last bigint, score bigint, attempts array<bigint>, history array<bigint>, fired array<bigint>"
    columns = [
        "ip", "rule_order", "seq", "ts_us", "failed_count", "burst_count", "escalation_count", "score_units",
        "history_n", "history_sum", "history_squares",
    ]
    output_schema = "ip string, rule_order int, " + ", ".join(f"{c} bigint" for c in columns[2:])

    def __init__(self, cfg: DetectionConfig):
        self.cfg = cfg
        self.spread_factor = as_fraction(cfg.baseline_std_multiplier) ** 2

    def forgets_at(self, state):
        return max(state[0] + self.cfg.us("ip_ttl") + 1, max(state[4]) + self.cfg.us("alert_cooldown"))

    def fold(self, state, ready, final):
        cfg, us = self.cfg, self.cfg.us
        window, burst_window, slow_window = us("time_window"), us("burst_window"), us("escalation_window")
        last, score, attempts, history, fired = state or (None, 0, [], [], [0, 0, 0, 0])
        attempts, fired = list(attempts), list(fired)
        history = deque(history)
        total, squares = sum(history), sum(x * x for x in history)
        # First attempt still inside each window; they only move forward, so a dense window costs no more.
        in_window = in_burst = in_slow = 0
        rows = []
        for ts, seq in zip(ready["ts_us"].tolist(), ready["seq"].tolist()):
            if last is not None and ts - last > us("ip_ttl"):
                last, score, attempts, in_window, in_burst, in_slow = None, 0, [], 0, 0, 0
                history.clear()
                total = squares = 0
            added = cfg.failed_login_score
            if last is not None:
                score = max(0, score - (ts - last) * cfg.decay_units)
                if ts - last < window:
                    added += cfg.repeat_penalty + (cfg.rapid_attempt_bonus if ts - last < us("rapid_window") else 0)
            score += added * cfg.units_per_point
            attempts.append(ts)
            while ts - attempts[in_window] >= window:
                in_window += 1
            while ts - attempts[in_burst] > burst_window:
                in_burst += 1
            while ts - attempts[in_slow] >= slow_window:
                in_slow += 1
            failed, slow = len(attempts) - in_window, len(attempts) - in_slow
            burst = len(attempts) - max(in_window, in_burst)
            history.append(failed)
            total, squares = total + failed, squares + failed * failed
            if len(history) > cfg.baseline_max_history:
                oldest = history.popleft()
                total, squares = total - oldest, squares - oldest * oldest
            n, last = len(history), ts
            meets = [
                (1, self._above(failed, n, total, squares)),
                (2, burst >= cfg.burst_threshold),
                (3, score >= cfg.risk_threshold * cfg.units_per_point),
                (5, slow >= cfg.escalation_threshold),
            ]
            for slot, (order, met) in enumerate(meets):
                if met and ts - fired[slot] >= us("alert_cooldown"):
                    fired[slot] = ts
                    rows.append((order, seq, ts, failed, burst, slow, score, n, total, squares))
        return (last, score, attempts[min(in_window, in_slow) :], list(history), fired), rows

    def _above(self, count: int, n: int, total: int, squares: int) -> bool:
        if n < self.cfg.baseline_min_samples:
            return count > self.cfg.baseline_default_threshold
        if n == 1:
            return count > total + self.cfg.baseline_std_multiplier
        lead = n * count - total
        return lead > 0 and lead * lead * (n - 1) > self.spread_factor * n * (n * squares - total * total)


class CountingDetector(OrderedProcessor):
    """Trailing weighted count of one key against a threshold, with its cooldown."""

    state_schema = "moments binary, weights binary, fired bigint"

    def __init__(self, key: str, width_us: int, threshold: int, cooldown_us: int):
        self.columns = [key, "seq", "ts_us", "counted", "label"]
        self.width_us, self.threshold, self.cooldown_us = width_us, threshold, cooldown_us

    def forgets_at(self, state):
        moments, _, fired = state
        return max((int(_numbers(moments)[-1]) if moments else 0) + self.width_us, fired + self.cooldown_us)

    def fold(self, state, ready, final):
        moments, weights, fired = state or (b"", b"", 0)
        before = len(_numbers(moments))
        ts = np.concatenate([_numbers(moments), ready["ts_us"].to_numpy(np.int64)])
        weight = np.concatenate([_numbers(weights), ready["weight"].to_numpy(np.int64)])
        total = np.concatenate([[0], np.cumsum(weight)])
        # First moment still inside the window of each row.
        start = np.searchsorted(ts, ts[before:] - self.width_us, side="right")
        counted = total[before + 1 :] - total[start]
        reached = np.flatnonzero(counted >= self.threshold)
        times = ts[before:][reached]
        labels = ready["label"] if "label" in ready else None
        rows, at = [], int(np.searchsorted(times, fired + self.cooldown_us))
        while at < len(times):
            row = int(reached[at])
            fired = int(times[at])
            label = labels.iat[row] if labels is not None else None
            rows.append((int(ready["seq"].iat[row]), fired, int(counted[row]), label or ""))
            at = max(at + 1, int(np.searchsorted(times, fired + self.cooldown_us)))
        return (ts[start[-1] :].tobytes(), weight[start[-1] :].tobytes(), fired), rows


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(bytes(data), np.int64)


class RepeatFilter(OrderedProcessor):
    """Lets a row through unless its key was let through within the time to live.

    Keys share buckets, so a call handles the rows of many; the state is what was let through lately, per key.
    """

    state_schema = "latest bigint, passed binary"

    def __init__(self, bucket: str, keys: list[str], ttl_us: int):
        self.columns = [bucket, *keys, "seq", "ts_us"]
        self.waits = [*keys, "ts_us", "seq"]
        self.keys, self.ttl_us = keys, ttl_us

    def forgets_at(self, state):
        return state[0] + self.ttl_us + 1

    def fold(self, state, ready, final):
        passed: dict[tuple, int] = {}
        if state:
            held = unpacked(state[1])
            passed = dict(zip(self._keys_of(held), held["ts_us"].tolist()))
        latest, rows = state[0] if state else None, []
        for key, ts, seq in zip(self._keys_of(ready), ready["ts_us"].tolist(), ready["seq"].tolist()):
            before = passed.get(key)
            if before is None or ts - before > self.ttl_us:
                passed[key] = latest = ts
                rows.append((*key, seq, ts))
        # Rows that are still to come are after ``final``.
        held = [(*key, ts) for key, ts in passed.items() if ts + self.ttl_us >= final]
        frame = pd.DataFrame(held, columns=[*self.keys, "ts_us"]).astype({"ts_us": "int64"})
        return (latest, packed(frame)), rows

    def _keys_of(self, frame: pd.DataFrame) -> list[tuple]:
        columns = [[None if k is None or k != k else k for k in frame[name].tolist()] for name in self.keys]
        return list(zip(*columns))

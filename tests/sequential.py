"""A plain sequential fold over attempts, the yardstick for the windowed detectors."""

import ipaddress
from collections import defaultdict


class Fold:
    def __init__(self, cfg):
        self.cfg = cfg
        self.last_seen, self.score, self.updated = {}, {}, {}
        self.recent, self.history, self.slow = {}, {}, {}
        self.everyone, self.networks = [], defaultdict(list)
        self.fired = {}
        self.rows, self.alerts = [], []

    def us(self, name):
        return self.cfg.us(name)

    def step(self, seq, now, ip):
        cfg = self.cfg
        for other in [o for o, seen in self.last_seen.items() if now - seen > self.us("ip_ttl")]:
            for state in (self.last_seen, self.score, self.updated, self.recent, self.history, self.slow):
                state.pop(other, None)
        new = ip not in self.last_seen
        points = cfg.units_per_point
        score = 0 if new else max(0, self.score[ip] - (now - self.updated[ip]) * cfg.decay_units)
        recent = [] if new else [t for t in self.recent[ip] if now - t < self.us("time_window")]
        added = cfg.failed_login_score
        if recent:
            added += cfg.repeat_penalty
            if now - recent[-1] < self.us("rapid_window"):
                added += cfg.rapid_attempt_bonus
        score += added * points
        recent = recent + [now]
        count = len(recent)
        history = ([] if new else self.history[ip]) + [count]
        history = history[-cfg.baseline_max_history :]
        n, total, squares = len(history), sum(history), sum(x * x for x in history)
        if n < cfg.baseline_min_samples:
            above = count > cfg.baseline_default_threshold
        else:
            lead = n * count - total
            above = lead > 0 and lead * lead * (n - 1) > cfg.baseline_std_multiplier**2 * n * (n * squares - total**2)
        burst = sum(now - t <= self.us("burst_window") for t in recent)
        slow = [t for t in ([] if new else self.slow[ip]) + [now] if now - t < self.us("escalation_window")]
        self.everyone = [t for t in self.everyone + [now] if now - t < self.us("global_time_window")]
        try:
            subnet = str(ipaddress.ip_network(f"{ip}/{cfg.subnet_prefixlen}", strict=False))
        except ValueError:
            subnet = None
        network = []
        if subnet:
            network = [t for t in self.networks[subnet] + [now] if now - t < self.us("subnet_window")]
            self.networks[subnet] = network
        self.last_seen[ip] = self.updated[ip] = now
        self.score[ip], self.recent[ip], self.history[ip], self.slow[ip] = score, recent, history, slow
        self.rows.append((seq, count, burst, len(slow), n, total, squares, added, score, len(self.everyone), len(network)))
        for order, meets, key in [
            (1, above, f"baseline_{ip}"),
            (2, burst >= cfg.burst_threshold, f"burst_{ip}"),
            (3, score >= cfg.risk_threshold * points, f"risk_{ip}"),
            (4, len(self.everyone) >= cfg.global_threshold, "global_bruteforce"),
            (5, len(slow) >= cfg.escalation_threshold, f"escalation_{ip}"),
            (6, len(network) >= cfg.subnet_threshold, f"subnet_{subnet}"),
        ]:
            if meets and now - self.fired.get(key, 0) >= self.us("alert_cooldown"):
                self.fired[key] = now
                self.alerts.append((order, key, seq))

    @classmethod
    def run(cls, attempts, cfg):
        fold = cls(cfg)
        for seq, now, ip in sorted(attempts, key=lambda row: (row[1], row[0])):
            fold.step(seq, now, ip)
        return fold


def greedy(rows, gap):
    """(key, ts, seq) rows kept when ``gap`` has passed since the last kept row of the key."""
    last, kept = {}, []
    for key, ts, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or ts - last[key] >= gap:
            last[key] = ts
            kept.append((key, ts, seq))
    return sorted(kept)

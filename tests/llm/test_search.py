import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hostguard.llm import licenses, ranked, vafile

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def copies(found, template, width, slack):
    """Votes by diagonal, merged and verified, straight from the definition."""
    votes = {}
    grams = len(template) - width + 1
    for j in range(grams):
        for i in range(len(found) - width + 1):
            if found[i : i + width] == template[j : j + width]:
                votes.setdefault(i - j, set()).add(j)
    groups, last = [], None
    for diagonal in sorted(d for d, v in votes.items() if len(v) * 4 >= grams):
        if last is None or diagonal - last > slack:
            groups.append([])
        groups[-1].append(diagonal)
        last = diagonal
    for group in groups:
        covered = {j + k for d in group for j in votes[d] for k in range(width)}
        if len(covered) * 100 >= len(template) * 80:
            places = [d + j + k for d in group for j in votes[d] for k in range(width)]
            yield min(places), max(places), len(covered) / len(template)


def brute_licenses(text):
    found = LICENSE_WORD.findall(lower(text))
    spans, base = [], []
    for n, (label, template) in enumerate([*licenses.BASE, *licenses.TEMPLATES]):
        words = LICENSE_WORD.findall(lower(template))
        width = 4 if len(words) >= 8 else min(2, len(words))
        here = list(copies(found, words, width, len(words) // 5))
        spans += [(label, share) for _, _, share in here]
        base += [(label, start) for start, _, _ in here if n < len(licenses.BASE)]
    starts = [s for _, s in base]
    return (
        len(found), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for b, _ in base})),
        ",".join(sorted({label for label, _ in spans})), max([s for _, s in spans], default=0.0),
    )


def test_licenses_equal_brute_force(spark, documents):
    rnd = random.Random(11)
    texts = ["", None, "MIT-license", "mit license mit license. MIT\nLicense", "Émit license", "general public general public license", "... !!", "license"]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            words = rnd.choice([*licenses.BASE, *licenses.TEMPLATES])[1].split()
            for _ in range(rnd.randint(0, 3)):
                at, kind = rnd.randrange(len(words)), rnd.random()
                words[at : at + (kind < 0.6)] = [] if kind < 0.3 else [rnd.choice(["software", "the", "own"])]
                words = words or ["x"]
            parts.append(" ".join(words if rnd.random() < 0.8 else words[: len(words) // 2]))
            parts.append(" ".join(rnd.choice("a the license mit public general b".split()) for _ in range(rnd.randint(0, 12))))
        texts.append("\n".join(parts))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3]), (None, None), (7, "word " * 50_000 + "MIT License")]
    got = licenses.find_licenses(documents(rows)).collect()
    names = "n_words n_base first_word last_word base_labels labels score".split()
    want = Counter((i, *brute_licenses(t)) for i, t in rows)
    assert Counter((r.doc_id, *[r[n] for n in names]) for r in got) == want
    assert sum(r.n_base for r in got) > 20 and any("," in r.labels for r in got) and any(0.8 <= r.score < 1 for r in got)
    assert licenses.find_licenses(documents([])).count() == 0
    assert [r.labels for r in licenses.find_licenses(documents([(1, "MIT License")]), [("x", "!!")], []).collect()] == [""]


def test_one_word_templates(spark, documents):
    found = licenses.find_licenses(documents([(1, "copyleft, unlicense"), (2, "x")]), [("u", "Unlicense")], [("c", "copyleft")]).collect()
    assert {r.doc_id: (r.n_base, r.first_word, r.labels) for r in found} == {1: (1, 0, "c,u"), 2: (0, None, "")}


def kept(v):
    whole = v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x * 1024) <= 2**27 for x in v)
    return [math.floor(1024 * x) for x in v] if whole else None


def lloyd(rows):
    points = [(i, kept(v)) for i, v in rows if kept(v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in points if i is not None)[:8]
    centres = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(10):
        groups = [[] for _ in centres]
        for _, v in points:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    found = [(i, *near(v)) for i, v in points] if centres else []
    inertia = Counter()
    for _, d, n in found:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in found)


VECTORS = "vec_id long, embedding array<float>, row string, cluster string, v string"


@pytest.mark.parametrize("spread", [0.01, 0.3, 40.0])
def test_clusters_equal_lloyd(spark, spread):
    rnd = random.Random(12)
    middles = [[rnd.uniform(-0.5, 0.5) for _ in range(64)] for _ in range(6)]

    def vector():
        return [float(int((m + rnd.gauss(0, spread)) * 4096)) / 4096 for m in rnd.choice(middles)]

    rows = [(i, vector()) for i in range(150)]
    same = vector()
    rows += [(200 + i, same) for i in range(60)] + [(5, rows[5][1]), (5, vector()), (None, vector()), (None, same)]
    rows += [(900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 63 + [float("nan")]), (904, [0.0] * 63 + [None])]
    rows += [(905, [float("inf")] * 64), (906, [1e30] * 64), (907, [-0.0] * 64)]
    table = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], VECTORS)
    got = vafile.cluster(table).collect()
    assert Counter(tuple(r) for r in got) == lloyd(rows)
    few = vafile.cluster(table.filter("vec_id < 3 OR vec_id IS NULL AND embedding[0] IS NOT NULL")).collect()
    assert Counter(tuple(r) for r in few) == lloyd([(i, v) for i, v in rows if i is None or i < 3])
    if spread == 0.01:
        assert vafile.cluster(table.limit(0)).count() == 0 and vafile.cluster(table.filter("vec_id IS NULL")).count() == 0


def test_intervals_hold_the_distance():
    import numpy as np

    rnd = np.random.default_rng(1)
    values = rnd.integers(-3000, 3000, (500, 64))
    marks = np.quantile(values, np.linspace(0, 1, 17), axis=0).T.astype(np.int64)
    marks[:, 0], marks[:, -1] = values.min(axis=0), values.max(axis=0)
    centres = rnd.integers(-5000, 5000, (5, 64))
    least, most = vafile.lookup_tables(marks, centres)
    cells = np.stack([np.searchsorted(marks[d, 1:-1], values[:, d], side="right") for d in range(64)], axis=1)
    exact = ((values[:, None] - centres[None]) ** 2).sum(axis=2)
    d = np.arange(64)
    for c in range(5):
        assert (least[c, d, cells].sum(axis=1) <= exact[:, c]).all() and (exact[:, c] <= most[c, d, cells].sum(axis=1)).all()


def brute_ranking(docs, items):
    counted = [(i, Counter(ranked.TERM.findall(lower(t)))) for i, t in docs]
    N = sum(1 for _, c in counted if c)
    L = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(ranked.TERM.findall(lower(t)))
    out = []
    for item, q in asked.items():
        scores = []
        for n, (doc_id, c) in enumerate(counted):
            m = 25 + (75 * c.total() * N) // L if c else 0
            s = sum(k * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in q.items() if c[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id, s))
        out += [(item, rank, s[3], s[4]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:10], 1)]
    return Counter(out)


def test_ranking_equals_brute_force(spark, documents, monkeypatch):
    rnd = random.Random(13)
    words = [f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(words[min(int(rnd.expovariate(1 / 25)), 299)] for _ in range(n))

    docs = [(i, text(rnd.randint(0, 60))) for i in range(400)] + [(i, "w1 w2 w3 W299") for i in range(500, 540)]
    docs += [(None, "w1 w2 w299"), (None, None), (600, None), (601, "..."), (602, text(30_000)), (3, docs[3][1]), (3, "w299 Été")]
    items = [(i, text(rnd.randint(1, 30))) for i in range(30)] + [(40, None), (41, "!"), (42, "no such term"), (43, "W299 été w299"), (43, "w5")]
    items += [(None, "w299"), (None, "w7"), (44, "w0"), (45, "w0 w1 w2 w3")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit("clash"), "row": F.lit("clash"), "n": F.lit("clash")})
    want = brute_ranking(docs, items)
    for block, bundle in ((4096, 256), (50, 7)):
        monkeypatch.setattr(ranked, "BLOCK", block)
        monkeypatch.setattr(ranked, "BUNDLE", bundle)
        got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked.search(documents(docs), table).collect())
        assert got == want
    assert ranked.search(documents([]), table).count() == 0 and ranked.search(documents(docs), table.limit(0)).count() == 0
    assert ranked.search(documents([(1, None)]), table).count() == 0

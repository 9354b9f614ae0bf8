import hashlib
import random

import numpy as np
import pytest

from hostguard.llm import exact_dedup, jaccard_join
from hostguard.llm.common import fold
from hostguard.llm.components import components
from hostguard.llm.textarrays import word_hashes
from hostguard.session import Scratch


def test_exact_duplicates_with_nulls_ties_and_repeats(documents):
    docs = documents([(1, "Ab É"), (5, "aB É"), (3, "ab é"), (7, None), (8, ""), (9, "x"), (9, "x"), (None, "X")])
    rows = exact_dedup.exact_duplicates(docs).collect()
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in rows)
    assert got == [
        (-1, 9, 3, False), (1, 5, 2, False), (3, 3, 1, True), (5, 5, 2, True), (7, 8, 2, False), (8, 8, 2, True),
        (9, 9, 3, False), (9, 9, 3, True),
    ]
    assert {bytes(r.digest) for r in rows if r.doc_id == 5} == {hashlib.sha256("ab É".encode()).digest()}
    assert exact_dedup.exact_duplicates(documents([])).count() == 0


def test_index_persists_and_wins_over_new_rows(spark, documents):
    scratch = Scratch(spark)
    path = scratch.folder()
    first = exact_dedup.DigestIndex(spark, path, buckets=4)
    exact_dedup.deduplicate(documents([(1, "a"), (2, "b")]), scratch, first).collect()
    first.close()
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    rows = exact_dedup.deduplicate(documents([(9, "a"), (10, "c")]), scratch, again).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in rows) == [(9, 1, False), (10, 10, True)]
    assert again.rows().count() == 3
    again.close()


def test_hot_texts_take_the_other_way(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    docs = documents([(i, "same") for i in range(20)] + [(i, f"own {i // 2}") for i in range(20, 30)])
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == 30 and {r.keep_id for r in rows if r.doc_id < 20} == {19}
    assert sum(r.kept for r in rows) == 6


def test_word_hashes_split_as_bytes_do(monkeypatch):
    from hostguard.llm import textarrays

    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abAB \t\n\x0b\x1c\x85é漢") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    one = {}
    for text in texts:
        data = text.encode()
        words = data.lower().split()
        hashes = word_hashes(data)
        monkeypatch.setattr(textarrays, "PIECE", 7)
        assert word_hashes(data).tolist() == hashes.tolist()
        monkeypatch.undo()
        assert len(words) == len(hashes)
        for word, value in zip(words, hashes.tolist()):
            assert one.setdefault(word, value) == value
    assert len(set(one.values())) == len(one)


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        sets.append({tuple(words[i : i + n]) + (len(words) < width,) for i in range(len(words) - n + 1)} if n else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[find(i)] if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize("width,percent,pivots", [(3, 90, 16), (5, 80, 2)])
def test_jaccard_join_equals_brute_force(documents, monkeypatch, width, percent, pivots):
    monkeypatch.setattr(jaccard_join, "FIRST_PIVOTS", pivots)
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows = []
    for base in range(12):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 90))]
        for _ in range(rnd.choice([1, 2, 3, 25])):
            copy = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(words[:10]) + " " + passage))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "One two"), (len(rows) + 3, "one  TWO"), (len(rows) + 4, "one"), (len(rows) + 5, " \n")]
    rnd.shuffle(rows)
    found = jaccard_join.near_duplicates(documents(rows), width, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, width, percent)


def test_pairs_of_a_large_group_of_near_copies_grow_with_the_group(documents, monkeypatch):
    """Copies changed in one to four places: those of many changes link with few, which takes no pair of every two."""
    measured = []
    measure = jaccard_join.measure

    def counted(pairs, sets):
        measured.append(pairs.count())
        return measure(pairs, sets)

    monkeypatch.setattr(jaccard_join, "measure", counted)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(words))]
    for i in range(1, 300):
        copy = list(words)
        for j in rnd.sample(range(150), rnd.randint(1, 4)):
            copy[j] = f"own{i}x{j}"
        rows.append((i, " ".join(copy)))
    found = jaccard_join.near_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, 3, 90)
    assert sum(measured) < 10 * len(rows), measured


def test_small_regions_are_joined_where_they_lie(spark, monkeypatch):
    """Turns over few rows broadcast nothing: each broadcast costs the driver memory, however small it is."""
    sets = [np.sort(np.array([*set(range(100)) - {i}, 1000 + i], dtype=np.uint64)) for i in range(12)]
    sets += [s + np.uint64(5000) for s in sets[:3]]
    points = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "point long, shingles binary")
    rows = [(region, i, 100, 100) for region in (7, 8) for i in range(15)]
    members = spark.createDataFrame(rows, "region long, point long, n long, rest long")
    plans, keep = [], Scratch.keep

    def kept(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df)

    monkeypatch.setattr(Scratch, "keep", kept)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        roots = jaccard_join.join_regions(members, points, 80, Scratch(spark))
        assert {r.node: r.root for r in roots.collect()} == {i: 0 if i < 12 else 12 for i in range(15)}
    finally:
        spark.conf.set(threshold, before)
    assert len(plans) > 5 and not any("BroadcastExchange" in plan for plan in plans)


def test_jaccard_join_of_little(documents):
    assert jaccard_join.near_duplicates(documents([])).count() == 0
    rows = jaccard_join.near_duplicates(documents([(4, "a b c d"), (4, "x y z"), (None, "A b c d"), (2, "a  b C d")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 2), (2, 2), (4, 2), (4, 4)]


@pytest.mark.parametrize("one_task", [200_000, 3])
def test_components_of_paths_and_stars(spark, monkeypatch, one_task):
    monkeypatch.setattr("hostguard.llm.components.ONE_TASK", one_task)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(200, 200), (300, 299)]
    rnd = random.Random(1)
    rnd.shuffle(links)
    links = [rnd.sample(x, 2) for x in links]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 5 for i in range(5, 40))
    assert found[200] == 200 and found[300] == 299


def test_fold_is_crc32_of_the_text(spark):
    import zlib

    rows = spark.range(50).select("id", fold("id", 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in rows)

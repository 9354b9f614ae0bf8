import os
from collections import Counter

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from check import compare, connect
from hostguard.llm import decontaminate, exact_dedup, jaccard_join, quality
from hostguard.llm.common import table
from hostguard.llm.queries import ORACLES, QUERIES
from hostguard.session import Scratch

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "op1_language_id", "op2_exact_dedup", "op3_lm_score", "op4_decontamination", "op5_chat_format", "op6_quality",
    "op7_jaccard_join", "op8_secret_scan", "op9_byte_bpe", "op10_warc", "op11_license_scan", "op12_centroid_clusters", "op13_ranked_search",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES.get(name)) is None


def test_everything_is_registered():
    assert set(NAMES) == set(QUERIES) and {*NAMES, "pipeline"} <= set(entry_points.queries())
    assert not [n for n in entry_points.oracle_sql() if n not in entry_points.queries()]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture
def folder(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        os.symlink(f"{FOLDER}/{name}.parquet", tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_stages_keep_rows_and_columns(spark, folder):
    docs = table(spark, folder, "documents")
    item = table(spark, folder, "benchmark").filter("item_id = 1").first().text
    clean = docs.filter("text <> ''").orderBy("doc_id").first()
    loud = clean.text.translate({c: c - 32 for c in range(ord("a"), ord("a") + 20)})
    planted = [
        (90_000, clean.text, "en", "x", 1), (90_001, loud, "en", "x", 1), (90_001, loud, "en", "x", 1),
        (90_002, f"Own words come first, then {item} and more words follow.", "en", "x", 1),
        (90_003, "!! $$$ " * 400, "en", "x", 1), (90_004, None, "en", "x", 1), (90_005, "", "en", "x", 1), (None, "A text without a number.", "en", "x", 1),
        (90_006, " ".join(f"word{i}" for i in range(200)), "en", "x", 1), (90_007, " ".join(f"word{i}" for i in range(199)), "en", "x", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema)).cache()
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rest = stage(spark, seen, folder)
        assert rest.columns == docs.columns, name
        before, after = ids(seen.fillna(-1, ["doc_id"])), ids(rest.fillna(-1, ["doc_id"]))
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "quality classifier":
            model = quality.train(seen, table(spark, folder, "labels"), Scratch(spark))
            scored = quality.predict(seen, model).collect()
            assert gone == {r.doc_id for r in scored if not r.predicted} and 90_003 in gone and -1 in after
        if name == "exact dedup":
            assert len(after) == len(set(after)) and 90_001 in after and {90_000, clean.doc_id, 90_004} <= gone
        if name == "n-gram Jaccard join":
            near = jaccard_join.near_duplicates(seen, 5, 80).collect()
            assert gone == {r.doc_id for r in near if r.doc_id is not None and r.doc_id != r.component_id} and 90_007 in gone
        if name == "benchmark decontamination":
            leaks = decontaminate.leaks(seen, table(spark, folder, "benchmark")).collect()
            assert gone == {r.doc_id for r in leaks} and 90_002 in gone
        seen = rest.cache()
    tokens = corpus_pipeline.STAGES[-1][1](spark, seen, folder).collect()
    assert len(tokens) == seen.count()
    digests = {r.doc_id: r.text for r in seen.collect()}
    import hashlib

    assert all(t.decoded_sha256 == hashlib.sha256((digests[t.doc_id] or "").encode()).hexdigest() for t in tokens)


def test_pipeline_runs_on_an_empty_table(spark, folder, tmp_path):
    os.unlink(tmp_path / "documents.parquet")
    table(spark, FOLDER, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_repeated_rows_stay_once(spark, folder):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (1, "c")], "doc_id long, text string")
    rest = corpus_pipeline.without_copies(spark, docs, folder)
    assert sorted(rest.collect()) == [(1, "a"), (1, "c"), (2, "b")]
    assert exact_dedup.exact_duplicates(docs).filter("kept").count() == 3
    clash = docs.selectExpr("*", *[f"'own' AS {c}" for c in ("_digest", "_id", "_key", "_again_id", "_listed_doc_id", "digest", "text_key")])
    found = corpus_pipeline.without_copies(spark, clash, folder)
    assert found.columns == clash.columns and sorted((r.doc_id, r.text) for r in found.collect()) == [(1, "a"), (1, "c"), (2, "b")]


def test_a_leak_takes_no_other_rows(spark, folder):
    item = table(spark, folder, "benchmark").filter("item_id = 1").first().text
    words = item.split()
    start, end = " ".join(words[: len(words) * 6 // 10]), " ".join(words[len(words) * 4 // 10 :])
    stay = [(None, "clean"), (None, start), (None, end), (5, "clean"), (6, start), (6, end)]
    docs = spark.createDataFrame([*stay, (None, f"own words {item}"), (5, f"more words {item}")], "doc_id long, text string")
    rest = corpus_pipeline.without_leaks(spark, docs, folder).collect()
    assert Counter((r.doc_id, r.text) for r in rest) == Counter(stay)

"""From raw documents to token ids: quality, exact copies, near copies, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return the rows that stay,
with the columns as they came. Decisions are narrow tables of (doc_id, key of the text), written out, and take the rows
away by an anti-join that moves no text while the list is small by count.

Edge cases are the operators' own. Rows that share a doc_id are judged one by one. Rows without a doc_id stay unless
their own text is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostguard.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from hostguard.llm.common import lean_batches, small, table, text_key, without_rows
from hostguard.session import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones of these, does not reject."""
    lean_batches(spark)
    scratch = Scratch(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), scratch)
    keyed = docs.select("doc_id", text_key(docs).alias("text_key"), "text")
    rejected = quality.predict(keyed, model, ("doc_id", "text_key")).filter("predicted = 0")
    return without_rows(docs, scratch.keep(rejected.select("doc_id", "text_key")), text_key(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    scratch = Scratch(spark)
    judged = exact_dedup.exact_duplicates(docs).filter("NOT kept")
    copies = judged.filter("NOT (doc_id <=> keep_id)").select("doc_id", F.col("digest").alias("text_key"))
    digest = exact_dedup.digest(docs["text"])
    rest = without_rows(docs, scratch.keep(copies), digest)
    # Repeated rows: the same id and text as the row that stays.
    repeated = judged.filter("doc_id <=> keep_id").select("doc_id", F.col("digest").alias("text_key")).distinct()
    if repeated.isEmpty():
        return rest
    again = scratch.keep(repeated)
    listed = small(again.withColumnsRenamed({"doc_id": "_again_id", "text_key": "_again_key"}))
    same = docs["doc_id"].eqNullSafe(listed["_again_id"]) & (digest == listed["_again_key"])
    once = docs.join(listed, same, "left_semi")
    name = "_digest"
    while name in docs.columns:
        name += "_"
    once = once.withColumn(name, exact_dedup.digest(once["text"])).dropDuplicates(["doc_id", name]).drop(name)
    return without_rows(rest, again, exact_dedup.digest(rest["text"])).unionByName(once)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    lean_batches(spark)
    scratch = Scratch(spark)
    near = jaccard_join.near_duplicates(docs, *NEAR).filter("component IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    stays = scratch.keep(near.groupBy("component").agg(F.min(order).alias("first")))
    dropped = near.join(small(stays), "component").filter(order != F.col("first")).select("doc_id", "text_key")
    return without_rows(docs, scratch.keep(dropped), text_key(docs))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    keyed = docs.select("doc_id", text_key(docs).alias("text_key"), "text")
    found = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), keys=("doc_id", "text_key"))
    return without_rows(docs, Scratch(spark).keep(found.select("doc_id", "text_key").distinct()), text_key(docs))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256): token ids, and the digest of what they decode to."""
    lean_batches(spark)
    ranks, pattern = bpe.default_vocabulary()
    # Written in between: encoding and decoding in one stage would keep two Python workers in each task.
    tokens = Scratch(spark).keep(bpe.encode(docs, ranks, pattern, ("doc_id", "lang", "source")))
    return bpe.decode(tokens, ranks).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


# Near copies: shingles of five words, similarity of 0.8 or more.
NEAR = (5, 80)

STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_leaks),
    ("byte-level BPE", to_tokens),
]

# The classifier is not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        found = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = found
    return docs

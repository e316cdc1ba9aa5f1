"""From raw documents to packed training sequences: language ID, near-dedup, secret scans, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parzelle.llm import common, langid, nearcopies, packing, queries, secrets
from parzelle.llm.common import durable, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: all but null texts, texts without a letter, and those whose best language
    has a posterior under langid.LEAST. A null lang becomes the predicted one. The model learns from the labelled
    documents of this stage's input; without any, or on an empty table, all rows stay as they are. Repeated rows are
    judged alike, very long texts whole; columns of any other name are kept."""
    if not {"doc_id", "lang"} <= set(docs.columns):
        return docs
    model = langid.fit(docs.where(langid.remainder(F.col("doc_id")) != 1))
    return langid.keep_known(docs, model) if model.langs else docs


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five words, similarity 0.8): the smallest id with its own text; of
    a class without ids one row. So each text is in a class that has exactly one kept text. An id with several texts
    stays once for each class that it heads. Null, empty and blank texts are one class. Of equal rows one is kept; rows
    of one id and text that differ elsewhere are told apart by a hash of all columns. An empty table stays empty."""
    which, nth = common.fresh(docs, "which"), common.fresh(docs, "nth")
    heads = nearcopies.heads(docs).select(F.col("which").alias(which))
    kept = docs.withColumn(which, nearcopies.row_key(F.col("doc_id"), F.col("text"))).join(heads, which, "left_semi")
    order = Window.partitionBy(which).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each secret is replaced by a mark that names its kind, and the count of characters set anew. Null and
    empty texts stay as they are; very long ones are searched whole; repeated rows are treated alike."""
    return secrets.redact(docs, queries.RANKS, queries.PATTERN)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Null and empty texts are the end token alone; an empty table gives no rows."""
    return packing.pack_documents(docs, queries.RANKS, queries.PATTERN)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("packing", pack)]

#: Fingerprints, learned languages and packing can't be said in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs

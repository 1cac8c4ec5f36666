"""From raw documents to packed training sequences, as five stages.

Each stage works on everything its predecessor kept and returns the columns of ``documents``; the
last returns the pieces of the packed sequences. The stages that drop documents decide by row: a
row goes by a 64-bit digest of its doc_id, text, lang and source, so rows that share a doc_id, or
have none, are documents of their own, and only rows that are equal share their fate (the
near-duplicate stage leaves one of them). Null texts have no words and go in the first stage. Empty
tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lares.llm import langid, packing, quality, secrets, sigtree
from lares.llm.common import table
from lares.session import cut

#: The digest of a row; a name that no column of documents has.
_ROW = "_row_of_stage"


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_ROW, F.xxhash64("doc_id", "text", "lang", "source"))


def _as_documents(docs: DataFrame) -> DataFrame:
    return _named(docs).select(F.col(_ROW).alias("doc_id"), "text", "lang", "source")


def _kept(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return _named(docs).join(rows.toDF(_ROW).distinct(), _ROW, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a fence of their language and source go."""
    return _kept(docs, quality.judged(_as_documents(docs)).where("kept").select("doc_id")).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or out of reach of every language's centroids, go."""
    return _kept(docs, langid.predicted(_named(docs), row=_ROW).where("NOT rejected").select("doc_id")).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays (null last)."""
    found = cut(sigtree.joined(_as_documents(docs)).groupBy(F.col("doc_id").alias(_ROW)).agg(F.min("component_id").alias("component_id"), F.count("*").alias("_n")))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", _ROW)
    first = _named(docs).select(_ROW, "doc_id").join(found, _ROW).groupBy("component_id").agg(F.min_by(_ROW, place).alias(_ROW))
    kept = _kept(docs, first.select(_ROW))
    if not found.where("_n > 1").isEmpty():  # of equal rows one stays
        kept = kept.dropDuplicates([_ROW])
    return kept.select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; all documents stay."""
    return secrets.without_secrets(docs, secrets.new_ledger(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of at most 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Packing and centroids can't be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, n-gram Jaccard join, decontamination, secret scan, SentencePiece.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm._common import stage, table
from quadrille.llm.decontamination import find_contamination
from quadrille.llm.ngram_join import ngram_jaccard_components
from quadrille.llm.piece_bpe import encode_pieces
from quadrille.llm.quality import count_features, judge_quality
from quadrille.llm.queries import tokenizer_path
from quadrille.llm.secret_scan import find_secrets, redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and rid, the same for rows with equal doc_id (null or not) and text only."""
    return docs.select(F.xxhash64("doc_id", "text", F.col("doc_id").isNull()).alias("rid"), *COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision posterior keeps; those with nothing to read (null, empty, blank) go.

    Rows are judged one by one: repeated rows, and rows without a doc_id, stay or go alike. Other columns than those of
    documents are left out; an empty table gives an empty table.
    """
    return judge_quality(count_features(docs.select(*COLUMNS))).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id: five words, similarity 0.8 or more.

    Rows without a doc_id count as the largest; among rows with one doc_id and different texts of a group, that with the
    smallest hash stays, and of equal rows one. Texts without words form no group: they stay, each once for each doc_id.
    Other columns than those of documents are left out; an empty table gives an empty table.
    """
    keyed = _keyed(docs)
    groups = ngram_jaccard_components(keyed.select(F.col("rid").alias("doc_id"), "text"), k=5, num=4, den=5).select(F.col("doc_id").alias("rid"), "component_id").distinct()
    own = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    first = keyed.select("rid", own.alias("own")).join(groups, "rid").groupBy("component_id").agg(F.min("own").alias("own")).select("own.rid")
    met = keyed.join(stage(first, "first"), "rid", "left_semi")
    again = met.groupBy("rid").agg(F.count("*").alias("times")).where("times > 1").select("rid")
    if again.isEmpty():
        return met.select(*COLUMNS)
    return met.dropDuplicates(["rid"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go.

    Rows are told apart by doc_id and text, so a clean row that shares its doc_id with a contaminated one stays, and a
    contaminated row without a doc_id goes. Repeated rows stay or go alike. Null, empty and blank texts stay. Other columns than those
    of documents are left out; an empty table gives an empty table.
    """
    keyed = _keyed(docs)
    found = find_contamination(keyed.select(F.col("rid").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("rid")).distinct()
    return keyed.join(bad, "rid", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced by a mark, and n_chars follows.

    A null text becomes empty with n_chars 0. Repeated rows, and rows without a doc_id, are treated alike. Other columns than
    those of documents are left out; an empty table gives an empty table.
    """
    found = find_secrets(docs.select(*COLUMNS))
    clean = found.withColumn("text", redact(F.col("text"), F.col("secrets")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the ids of every document, one row for each row; a null or empty text is the end id alone."""
    return encode_pieces(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: The posterior, the forest and the encoder cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

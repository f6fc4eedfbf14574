"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .chat_format import format_chats, loss_texts, message_log, read_back
from .decontamination import find_contamination
from .filter_audit import audit_documents
from .ngram_join import ngram_jaccard_components
from .oracles import ORACLE_SQL as ORACLE_SQL
from .paragraph_dedup import repeated_passages
from .piece_bpe import encode_pieces
from .quality import count_features, judge_quality
from .secret_scan import find_secrets
from .sharding import shard_documents
from .slack_packing import pack_documents
from .spelling_variants import spelling_variants
from .toxicity import score_toxicity
from .url_reputation import filter_urls

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select conv_id, turn, role, '{tricky}' as text from values (-7L, 0L, 'user'), (-7L, 1L, 'assistant') as t(conv_id, turn, role)")
    chats = format_chats(message_log(rows.union(extra)))
    chats = chats.withColumns({"turns": read_back(F.col("formatted")), "loss": loss_texts(F.col("formatted"), F.col("loss_mask"))})
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(turns).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge_quality(count_features(docs).drop("text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    each = found.select("doc_id", F.explode("secrets").alias("s"))
    return each.select("doc_id", "s.start", "s.length", F.sha2(F.col("s.found").cast("binary"), 256).alias("found_sha256"), "s.probability", "s.is_secret")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.drop("filter")


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_ngram_jaccard_join, op3_url_filters, op4_decontamination, op5_substring_dedup, op6_chat_format, op7_quality_rules, op8_secret_scan, op9_sentencepiece, op10_sharding, op11_spelling_variants, op12_best_fit_packing, op13_filter_audit)
}

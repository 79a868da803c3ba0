"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bitsliced, bpe, divergence, fill_middle, host_rules, licenses, mixing, ngram_join, quality_gam, sentence_spans, token_count, token_io, warc
from heddle.llm.common import read
from heddle.llm.sql import ORACLE_SQL  # noqa: F401

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return bitsliced.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10, scale=1024)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.remove_repeats(docs)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged = host_rules.judge(docs, keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), BYTE_BPE)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.write_and_read(read(spark, sf_dir, "documents"), BYTE_BPE)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read(spark, sf_dir, "documents"), PIECES, limit=4096)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    arranged = fill_middle.arrange(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return arranged.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(read(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk_search,
        op2_substring_dedup,
        op3_mix_sources,
        op4_ngram_join,
        op5_license_scan,
        op6_quality_classifier,
        op7_quality_rules,
        op8_bpe_round_trip,
        op9_token_files,
        op10_token_counts,
        op11_source_divergence,
        op12_fill_in_middle,
        op13_warc,
    )
}

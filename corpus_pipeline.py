"""The corpus pipeline: quality rules, near-duplicate removal, substring de-duplication, mixing, BPE.

A stage's result may read tables that it has staged; they stay until run() has written that result, or release() is called.
An empty table passes through all stages; rows without doc_id are documents like others; columns beside those of documents
are left out.

STAGES run one after the other over documents; each returns the columns of documents but the last, which returns the
token ids of the documents that are left, as often as the mix takes them.
"""

from __future__ import annotations

from itertools import count

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bpe, host_rules, mixing, ngram_join, sentence_spans
from heddle.llm.common import marked
from heddle.sources.staging import delete, stage, staged_by

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor come from a rejected host."""
    return host_rules.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def _row_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with _key, a hash of the row, and (_key, doc_id, n) of the distinct rows; a key that two rows share is hashed anew."""
    row = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    for seed in count():
        keyed = docs.withColumn("_key", F.xxhash64(F.lit(2 * seed), *row))
        other = F.xxhash64(F.lit(2 * seed + 1), *row)
        keys = keyed.groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.min(other).alias("_a"), F.max(other).alias("_b"))
        keys = stage(keys, "row-keys")
        if keys.filter("_a <> _b").isEmpty():
            return keyed, keys.select("_key", "doc_id", "n")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group linked by Jaccard similarity 0.8 or more on 5-word shingles.

    Every row is a document, also without doc_id (last in the order) or with a doc_id that others have; of a group's rows
    with the smallest id the one with the least row hash stays.  Equal rows, blank ones too, are one document and stay once.
    """
    keyed, keys = _row_keys(docs.select(*COLUMNS))
    groups = ngram_join.join_components(keyed, id_col="_key", n=5, num=80, den=100, sample=1.6)
    members = stage(groups.select("_key", "component_id").distinct().join(keys, "_key"), "near-members")
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))["_key"].alias("_best"))
    copies = members.join(best, "component_id").filter("_key <> _best").select("_key")
    touched = stage(copies.unionByName(keys.filter("n > 1").select("_key")).distinct().withColumnRenamed("_key", "key"), "near-touched")
    rows = marked(keyed.withColumn("key", F.col("_key")), touched)  # the other texts are not shuffled
    once = rows.filter("_maybe").join(copies, "_key", "left_anti").dropDuplicates(["_key"])
    return rows.filter("not _maybe").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences of repeated spans; documents of which nothing is left go."""
    out = sentence_spans.remove_repeats(docs.select(*COLUMNS))
    out = out.filter("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times."""
    mixed = mixing.placed_mix(docs)
    taken = mixed.filter("taken > 0").select(F.col("place").alias("_at"), F.col("source").alias("_source"), (F.col("taken") / F.col("size")).cast("int").alias("_n")).distinct()
    placed = docs.select(*COLUMNS).withColumn("_place", mixing.places(docs))
    out = placed.join(taken, (F.col("_place") == F.col("_at")) & F.col("source").eqNullSafe(F.col("_source")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*COLUMNS)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, digests of the ids and of the decoded text, ids."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "source"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", byte_pairs),
]

#: The span hashes and the encoder are beyond SQL; tests hold every stage's rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again before the next one starts; what a stage has staged goes once they are."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, step in STAGES[:-1]:
        made: list[str] = []
        with staged_by(made):
            out = step(spark, docs, sf_dir)
        docs = stage(out, "pipeline")
        delete(spark, before + made)
        before = [docs.staged_at]
    return STAGES[-1][1](spark, docs, sf_dir)

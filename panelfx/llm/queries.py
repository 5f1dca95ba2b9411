"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (compact_windows, context_tree, fill_in_middle, fingerprints, license_scan, mixing, ngram_join, oracles, packing, quality_rules, sharding,
               token_counts, warc, whitening)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document among near duplicates."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive round trip of every page."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("archive")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in an earlier document too."""
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree and unigram scores of every document, trained on nine tenths of them."""
    return context_tree.scores(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text counts, base rule and learned verdict of every document."""
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fingerprints of every document, its edited text and its next document."""
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and accepted templates of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jump-hash shard, grown shard and slot of every document."""
    return sharding.assignment(table(spark, sf_dir, "documents"), shards=24)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and which have more than 2048."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's fill-in-the-middle output and of the text restored from it."""
    done = fill_in_middle.transformed(table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored, 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding on the first four components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_warc, op3_substring_dedup, op4_context_tree, op5_packing, op6_mixing, op7_quality_rules, op8_fingerprints, op9_license_scan,
                                   op10_sharding, op11_token_counts, op12_fill_in_middle, op13_whitening)}
ORACLES = {"op2_warc": oracles.OP2, "op6_mixing": oracles.OP6, "op12_fill_in_middle": oracles.OP12}

"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, divergence, licenses, lines, mixing, pii, quality, resampling, rules, secrets, sharding, simhash
from .common import materialize, table

#: For the registered query only; a production run passes its own secret.
PII_KEY = "registered-query"
VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *base, "base_failed", "kept", "quality")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.anonymize(docs, PII_KEY).select("doc_id", "text", "n_entities", F.to_json("entities").alias("entities"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.stored(sharding.shard(sharding.measured(docs), 24))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(audio.store(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    keys = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    keep = ("doc_id", "n_bytes", "media_bytes", "media_sha256")
    found = materialize(audio.audio_features(keys, keep=keep).drop("feature"))
    return audio.digests(found, (*keep, "payload_bytes", "payload_sha256", "tail_crc32")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, least_tokens=1).select("doc_id", "n_lines", "n_dropped", "text")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents"), keep=("doc_id",)), ("doc_id",))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_sharding": op5_sharding,
    "op6_cotraining": op6_cotraining,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_media": op8_media,
    "op9_lines": op9_lines,
    "op10_licenses": op10_licenses,
    "op11_divergence": op11_divergence,
    "op12_resampling": op12_resampling,
    "op13_secrets": op13_secrets,
}

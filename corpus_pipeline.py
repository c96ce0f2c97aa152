"""The corpus pipeline: documents in, a deduplicated, mixed and encoded corpus out.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``; other columns of the input, whatever their names, are not passed on.

Nulls, empty texts, repeated rows and ties follow the operators' rules: the classifier scores an empty text like any other; line dedup leaves null and empty texts as they are;
near-dedup takes texts without words as one group and keeps one row of them; the mix takes documents without words never or as the integer boundaries fall; encoding gives them no ids. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, lines, mixing, quality, simhash
from lodestrata.llm.common import materialize, table
from lodestrata.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a text that was cut."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), keep=tuple(COLUMNS)).filter("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring templates are cut out; a document of which nothing is left goes."""
    cut = lines.dedup_lines(docs, least_tokens=1)
    return _sized(cut.filter((F.col("n_dropped") == 0) | (F.trim("text") != ""))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays; of its rows, if there are more, the one of least text hash."""
    marked = docs.withColumns({"_th": F.xxhash64(F.coalesce("text", F.lit(""))), "_k": F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))})
    found = simhash.near_duplicates(marked, keep=("_th", "_k"))
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = materialize(first.groupBy("root").agg(F.min(F.struct("_k", "_th")).alias("b"), F.count("*").alias("n")).select("b._k", "b._th", "n"))
    kept = marked.join(best.select("_k", "_th"), ["_k", "_th"], "left_semi")
    if not best.filter("n > 1").isEmpty():  # repeated ids: rows of one text are still there, of which the least stays
        order = ["lang", "source", "n_chars", "doc_id", "text"]
        kept = kept.groupBy("_k", "_th").agg(F.min(F.struct(*order)).alias("row")).select("row.*")
    return kept.select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs.select(COLUMNS)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every document taken, their number, and the hash of the text that they decode to."""
    path = public_tokenizers.path(VOCABULARY)
    ids = bpe.encode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN)
    decoded = bpe.decode(ids.select("doc_id", "source", "ids"), path)
    n_tokens = F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens")
    return decoded.select("doc_id", "source", n_tokens, "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Fits, components over rounds and the merges of a vocabulary aren't expressible in SQL; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Target-distribution importance resampling (operator 12): documents are drawn that look like a target's texts.

A text's features are its runs of one to ``longest`` words (A-Z lower-cased; a word is a run of ASCII letters and digits and any characters outside ASCII), hashed to ``BUCKETS``
buckets by CRC32. Two passes over Arrow batches:

1. Each partition adds up ``np.bincount`` vectors of its batches and gives one vector of ``BUCKETS`` sums (80 kB), whatever its size; ``treeReduce`` merges them. The target's texts are counted alike.
   The gain of a bucket is the logarithm of the smoothed ratio of its shares in the target and in the corpus, in thousandths, rounded down.
2. The gains are broadcast (80 kB, a fixed size); a document's weight is their sum over its features, by ``np.bincount`` over a batch with the gains as weights. Sums of whole numbers in doubles
   are exact, in any order.

A Gumbel number drawn from the document's id by hash is added to the weight, and the documents of most points are drawn: sampling without replacement in proportion to exp(weight / 1000).
The ranking is a range partitioning by points, dealt out by a sample of them and split among equals by place, so that no task sorts all; only partitions that reach into the drawn part are ranked.

Defined results: a null text has no features and weight 0; a null id is hashed as the word "null" and comes last among equal points; of rows that are equal in id and points the one with more features, then
more weight, comes first, and wholly equal rows share their ranks in any way; columns ``n_features weight score rank`` of the input are replaced; an empty table gives no rows; with an empty target all gains are those of no occurrence.
Very long texts are read in pieces.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import runs
from ..session import ship
from .common import materialize

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Words whose buckets a task remembers, and features whose buckets are held at once.
REMEMBERED, HELD = 500_000, 1 << 20


class _Buckets(dict):
    """Buckets of features seen before; forgotten all at once when there are too many."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = found = crc32(feature) % BUCKETS
        return found


def _features(text: bytes, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """For each piece of a text: how many words it adds, and the features that end in it."""
    tail: list[bytes] = []
    for part in runs.words(text, runs.ALPHANUMERIC):
        if longest == 1:
            yield len(part), part
            continue
        held = tail + part
        yield len(part), [b" ".join(held[end - n : end]) for end in range(len(tail) + 1, len(held) + 1) for n in range(1, min(longest, end) + 1)]
        tail = held[max(0, len(held) - longest + 1) :]


def _bucket_lists(texts: pa.Array, longest: int, known: _Buckets) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch -> (document of each feature, bucket of each feature, words of each document), at most about ``HELD`` features at a time."""
    owner, bucket, held = [], [], 0
    words = np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        for n, part in _features(runs.utf8(texts.slice(i, 1))[0] or b"", longest):
            words[i] += n
            owner.append(np.full(len(part), i, np.int64))
            bucket.append(np.fromiter(map(known.__getitem__, part), np.int64, len(part)))
            held += len(part)
            if held >= HELD:
                yield np.concatenate(owner), np.concatenate(bucket), words
                owner, bucket, held, words = [], [], 0, np.zeros(len(texts), np.int64)
    none = [np.zeros(0, np.int64)]
    yield np.concatenate(owner or none), np.concatenate(bucket or none), words


def bucket_sums(docs: DataFrame, text: str = "text", longest: int = LONGEST) -> np.ndarray:
    """How often each bucket's features occur in all texts."""
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, known = np.zeros(BUCKETS, np.int64), _Buckets()
        for batch in batches:
            for _, buckets, _ in _bucket_lists(batch.column(0), longest, known):
                sums += np.bincount(buckets, minlength=BUCKETS)
        yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    vectors = docs.select(F.col(text).cast("string")).mapInArrow(counted, "sums binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, np.int64)
    return vectors.treeReduce(np.add)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of every bucket, as whole thousandths."""
    s, t = int(corpus.sum()), int(target.sum())
    ratio = lambda a, b: ((b + 1) * (s + BUCKETS)) / ((a + 1) * (t + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(int(a), int(b)))) for a, b in zip(corpus, target, strict=True)], np.float64)


def luck(id_: str, seed: int = SEED) -> int:
    """The Gumbel number of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{id_}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, text: str, key: str, keep: tuple[str, ...], longest: int, seed: int) -> DataFrame:
    """The columns ``keep`` with ``n_features``, ``weight``, ``score`` and ``_words``."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col(text).cast("string").alias("_text"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_id"), *keep)
    longs = ("n_features", "weight", "score", "_words")
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in longs)])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = _Buckets(), sent.value
        for batch in batches:
            n = batch.num_rows
            features, words, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.float64)
            for owner, bucket, more in _bucket_lists(batch.column(0), longest, known):
                features += np.bincount(owner, minlength=n)
                weight += np.bincount(owner, weights=gain[bucket], minlength=n)
                words += more
            weight = weight.astype(np.int64)
            score = weight + np.array([luck(x, seed) for x in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *map(pa.array, (features, weight, score, words))], schema=target)

    return rows.mapInArrow(run, schema)


def _ranked(rows: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` rows of most points with ``rank``; ties go to the smaller key."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_last(key), F.desc("n_features"), F.desc("weight"), F.asc("_place")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))  # as many rows as partitions
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialize(sizes.withColumn("_before", before).filter(F.col("_before") < n).drop("n"))
    inside = dealt.join(F.broadcast(sizes), "_part")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return inside.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n).drop("_part", "_before")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), target_text: str = "text", longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document's ``key``, ``keep``, ``n_features``, ``weight``, ``score`` and ``rank``: 1, 2, 3 and so on for the drawn ones, null for others.

    Drawn are ``percent`` of a hundred of the documents with ``least_words`` words.
    """
    added = ("n_features", "weight", "score", "rank")
    names = [key, *(c for c in keep if c not in (key, *added))]
    gain = gains(bucket_sums(docs, text, longest), bucket_sums(target, target_text, longest))
    rows = weighed(docs, gain, text, key, tuple(names), longest, seed)
    rows = materialize(rows.withColumn("_place", F.monotonically_increasing_id()))
    able = F.col("_words") >= least_words
    drawn = materialize(_ranked(rows.filter(able), rows.filter(able).count() * percent // 100, key).select("_place", "rank"))
    return rows.join(drawn, "_place", "left").select(*names, *added)


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The drawn documents themselves, with ``rank``: rows of ``docs`` whose key is drawn (a repeated key: all its rows, with its first rank)."""
    ranks = resample(docs.drop("rank"), target, key=key, **options).filter("rank is not null").groupBy(key).agg(F.min("rank").alias("rank"))
    picked = ranks.select(F.col(key).alias("_drawn"), "rank")
    return docs.drop("rank").join(picked, F.col(key).eqNullSafe(F.col("_drawn"))).drop("_drawn")

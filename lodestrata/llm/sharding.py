"""Sharding by a two-pass external shuffle (operator 5, DataFrame functions only).

Pass one scatters the records: a rendezvous hash of ``doc_id`` names the shard,
and a seeded hash one of the shard's buckets, whose number is set so that
a bucket fits in memory (``BUCKET_BYTES`` and ``BUCKET_ROWS``). Pass two holds one
bucket at a time, puts its records into a fixed order, shuffles them by
Fisher-Yates with draws from a seeded hash, numbers them on from the buckets before, and writes them.
The texts are shuffled once; buckets are counted on rows of (shard, hash, size).

The law is ``key``: ``doc_id`` and the number of shards alone decide. With one more
shard, rendezvous hashing moves rows only into the new one (``grown_shard``).

Fisher-Yates runs inside the engine: the permutation is a binary of four bytes
per entry and a swap is two overlays, so a step copies a few kB and no row leaves
the JVM. The result depends only on the rows, never on partitions or reruns.

Rows that are equal in every column are counted first and scattered by their
copy number, so that a repeated row fills no bucket. Defined results: a null text has
8 bytes of size and the CRC of no bytes; null ids hash like any value (all to one
shard, as the law demands); an empty table gives no rows; columns called ``shard``,
``slot``, ``grown_shard``, ``law``, ``size`` or ``text_crc32`` in the input are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, power_of_two, shared_folder

LAW = "key"
SEED = 20_011
BUCKET_BYTES = 4 << 20
BUCKET_ROWS = 1 << 10
#: Rows that a repeated row is unrolled to at once.
COPIES = 1 << 10
#: What a record costs besides its text.
OVERHEAD = 8
_NEW = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of the highest hash of (key, shard); ties go to the higher shard."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s"))))
    return best["s"].cast("int")


def fisher_yates(rows: str, *salt: str, seed: int = SEED) -> Column:
    """The array column ``rows`` in an order drawn by Fisher-Yates; ``salt``: columns that vary the draws."""
    draw = f"cast(pmod(xxhash64({seed}, {', '.join([*salt, 'i'])}), i + 1) as int)"
    identity = f"unhex(array_join(transform(sequence(0, size({rows}) - 1), i -> lpad(hex(i), 8, '0')), ''))"
    swap = f"overlay(overlay(p PLACING substring(p, 4 * {draw} + 1, 4) FROM 4 * i + 1 FOR 4) PLACING substring(p, 4 * i + 1, 4) FROM 4 * {draw} + 1 FOR 4)"
    order = f"aggregate(sequence(size({rows}) - 1, 1, -1), {identity}, (p, i) -> {swap})"
    picked = f"transform(sequence(0, size({rows}) - 1), k -> cast(conv(hex(substring(p, 4 * k + 1, 4)), 16, 10) as int))"
    return F.expr(f"case when size({rows}) < 2 then {rows} else transform(flatten(transform(array({order}), p -> {picked})), k -> {rows}[k]) end")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size`` in bytes and ``text_crc32``."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.drop("size", "text_crc32").withColumns({"size": F.octet_length(body).cast("long") + OVERHEAD, "text_crc32": F.crc32(body)})


def shard(records: DataFrame, shards: int, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``records`` (with ``size`` and ``text_crc32``, see ``measured``) with ``law shard slot grown_shard``.

    Write the result with ``write_shards``, or sort by ``slot`` within a shard.
    """
    keep = [c for c in records.columns if c not in _NEW]
    copy = F.lit(1).cast("long")
    rows = records.select(*keep, "size", "text_crc32")
    # rows are counted by a hash first; with none repeated, no text is shuffled for it
    hashed = records.select(F.xxhash64(*keep, "size", "text_crc32").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    if not hashed.filter("n > 1").isEmpty():
        rows = _copies(rows.groupBy(*keep, "size", "text_crc32").agg(F.count("*").alias("_m")))
        copy = F.col("_copy")
    rows = rows.withColumns({"shard": rendezvous(F.col(key), shards, seed), "grown_shard": rendezvous(F.col(key), shards + 1, seed), "_h": F.xxhash64(F.lit(seed + 1), key, "text_crc32", copy)})
    places = materialize(rows.select("shard", "_h", "size"))  # a few bytes a row; the texts are shuffled once, into their buckets
    full = places.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).agg(F.max("b"), F.max("n")).first()
    buckets = power_of_two(max((full[0] or 0) / BUCKET_BYTES, (full[1] or 0) / BUCKET_ROWS))
    bucket = F.pmod("_h", F.lit(buckets)).cast("int").alias("_bucket")
    counts = places.groupBy("shard", bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    fields = [*keep, "size", "text_crc32", "grown_shard"]
    order = F.struct(F.col(key).alias("k"), F.col("text_crc32").alias("c"), F.struct(*fields).alias("row"))
    held = rows.groupBy("shard", bucket).agg(F.collect_list(order).alias("_rows")).withColumn("_rows", F.array_sort("_rows"))
    mixed = held.select("shard", "_bucket", fisher_yates("_rows", "shard", "_bucket", seed=seed + 2).alias("_rows"))
    return (
        mixed.join(starts, ["shard", "_bucket"])
        .select("shard", "_start", F.posexplode("_rows").alias("_at", "_r"))
        .select(*[F.col("_r.row")[c].alias(c) for c in fields if c != "grown_shard"], F.lit(LAW).alias("law"), "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot"), F.col("_r.row.grown_shard").alias("grown_shard"))
    )


def _copies(counted: DataFrame) -> DataFrame:
    """Rows counted in ``_m`` -> each so often, with ``_copy`` from 1; no array is longer than ``COPIES``."""
    blocks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / (COPIES * COPIES))))).withColumn("_from", F.col("_from") * COPIES * COPIES)
    most = lambda step: F.least(F.col("_m") - 1, F.col("_from") + step)
    blocks = blocks.withColumn("_from", F.explode(F.sequence(F.col("_from"), most(COPIES * COPIES - 1), F.lit(COPIES).cast("long"))))
    return blocks.withColumn("_copy", F.explode(F.sequence(F.col("_from") + 1, most(COPIES - 1) + 1))).drop("_from", "_m")


def stored(placed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``placed`` records with their texts, written as shards into the shared folder; size and CRC are of the texts as read back."""
    path = f"{shared_folder(placed.sparkSession)}/shards/{uuid.uuid4().hex}"
    write_shards(placed, path)
    back = placed.sparkSession.read.schema(placed.schema).parquet(path)
    return measured(back, text).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder a shard. The rows lie in their buckets already: a task writes those that it has shuffled, in the order of ``slot``."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Mixing sources to target weights by systematic sampling (operator 1, DataFrame functions only).

Within each source the documents are put into one fixed order; their expected
copies (target over source size, alike for all documents of a source) are
prefix-summed, one random offset per source is added, and a document is emitted
once for each integer that its step crosses. The order runs through the
documents by size, so that the sample is spread evenly over sizes, and by a
seeded hash among similar sizes.

No task holds a source: a prefix sum is taken in three levels (size class,
hash bucket, row), the upper two over counted buckets, and only the rows of one
bucket meet in a window. The number of buckets grows with the number of rows
and doesn't change the order, hence not the result either.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a null ``doc_id`` is hashed as the word "null"; a source without
words gets target 0 and no copies; equal rows may share copies in any way; an
empty table gives no rows. Other columns pass through unless ``mix`` adds
one of the same name (``size source_size target copies taken``), which wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, power_of_two, rows_of, word_count

#: A source is repeated at most so often.
MOST = 3
SEED = "mix-1"
#: Mean rows of a hash bucket if all rows fell into one size class of one source.
BUCKET_ROWS = 1 << 16
LEAST_BUCKETS = 64


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """One row per source (``_k``, ``source_size``) -> with ``target``.

    Weights 1, 2, 3 repeat over the sources in code-point order. Targets are the
    water-filling solution: ``min(most * size, weight * level)`` summing up to all
    sizes. Sorted by limit over weight, the sources that hit their limit form a
    prefix, so the level follows from running sums over this one-row-per-source table.
    """
    by_name, by_ratio = Window.orderBy("_k"), Window.orderBy("_ratio", "_k")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = (
        sizes.withColumn("_w", (F.row_number().over(by_name) - 1) % 3 + 1)
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("_w").over(everything))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    )
    level = (F.col("_total") - F.col("_cap_before")) / (F.col("_weights") - F.col("_w_before"))
    w = w.withColumn("_full", F.col("_cap") <= F.col("_w") * level)
    rest = F.sum(F.when(F.col("_full"), F.lit(0)).otherwise(F.col("_w"))).over(everything)
    capped = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(
        F.col("_w") * ((F.col("_total") - capped) / F.when(rest > 0, rest))
    )
    return w.select("_k", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    seed: str = SEED,
    most: int = MOST,
) -> DataFrame:
    """``docs`` with ``size source_size target copies taken``; a row for every document, also those not taken."""
    n = rows_of(docs)
    buckets = max(LEAST_BUCKETS, power_of_two(n / BUCKET_ROWS))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    size = F.col("size").cast("string")
    base = (
        docs.drop("source_size", "target", "copies", "taken")
        .withColumn("size", word_count(F.col(text)))
        .withColumn("_k", F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))))
        .withColumn("_c", F.length(size) * 100 + F.substring(size, 1, 2).cast("int"))
        .withColumn("_h", digest)
        .withColumn("_b", (F.conv(F.substring(F.col("_h"), 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long"))
        .withColumn("_tie", F.crc32(F.coalesce(F.col(text), F.lit(""))))
    )
    cells = materialize(base.groupBy("_k", "_c", "_b").agg(F.count("*").alias("_n"), F.sum("size").alias("_s")))
    classes = cells.groupBy("_k", "_c").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    sources = source_targets(classes.groupBy("_k").agg(F.sum("_s").alias("source_size")), most)
    up_to = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = (
        cells.withColumn("_in_class", up_to(Window.partitionBy("_k", "_c").orderBy("_b")))
        .join(classes.select("_k", "_c", up_to(Window.partitionBy("_k").orderBy("_c")).alias("_in_source")), ["_k", "_c"])
        .join(sources, "_k")
        .select("_k", "_c", "_b", (F.col("_in_class") + F.col("_in_source")).alias("_before"), "source_size", "target")
    )
    place = Window.partitionBy("_k", "_c", "_b").orderBy("_h", "size", "_tie")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|offset|"), F.col("_k"))), 1, 8), 16, 10).cast("long") / (1 << 32)
    step = lambda k: F.floor(F.col("_rate") * k + F.col("_start"))
    return (
        base.join(offsets, ["_k", "_c", "_b"])
        .withColumn("_i", F.col("_before") + F.row_number().over(place))
        .withColumn("_rate", rate)
        .withColumn("_start", start)
        .withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(most), step(F.col("_i")) - step(F.col("_i") - 1))).cast("int"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop("_k", "_c", "_b", "_h", "_tie", "_before", "_i", "_rate", "_start")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each repeated as often as it is taken, with ``copy`` from 1."""
    keep = [c for c in docs.columns if c != "copy"]
    out = mix(docs, **options).filter("copies > 0")
    return out.select(*keep, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))

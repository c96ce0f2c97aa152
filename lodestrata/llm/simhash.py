"""SimHash near-deduplication (operator 2).

Fingerprints: a text's words (A-Z lower-cased), their three-word shingles with repeats, XXH64 with seed 42 of each;
a bit is set if it is set in over half the hashes. Equal fingerprints are one node from here on.

Candidates: the fingerprint is mapped to the number of set bits in each of 32 two-bit segments. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints. The 32 counts are dealt to six axes of a grid, five or six counts an axis; vectors
within Manhattan distance 2 differ on at most two axes, so they share the cell of at least one of the fifteen fours of axes (about 32 bits, the likeliest value 2 ** -20). Points of
a shared cell are joined, the Manhattan bound is applied to the whole vectors, and the Hamming distance decides.

A cell with more than ``CROWD`` points is not joined with itself: its points are linked over midpoints instead, which is as exact.
Two fingerprints are within 2 bits if and only if one of the 65 values within 1 bit of the one is
also within 1 bit of the other; so each point takes its 65 values, and the points of a value are linked to their least.
That is linear in the points, whatever the size of a group of near copies.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; a null ``doc_id``
is ignored in ``component_id`` unless all ids of the component are null; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import flat_map
from .common import materialize
from .components import components

SHINGLE, SEED, BITS = 3, 42, 2
CROWD = 64
#: Bits of each axis, whole segments each.
AXES = [((1 << n) - 1) << at for at, n in ((0, 12), (12, 12), (24, 10), (34, 10), (44, 10), (54, 10))]
#: Axes that vectors within the distance share.
SHARED = len(AXES) - BITS
_CHUNK = 1 << 15
_EACH_BYTE = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: eight bits at a time, as the bytes of a word, 255 hashes a sum."""
    out = np.zeros(64, np.int64)
    starts = np.arange(0, len(hashes), 255)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _EACH_BYTE, starts)
        out[k::8] += sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    hash_, join, n, counts = xxhash.xxh64_intdigest, b" ".join, len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + width - 1]
        counts += _bit_counts(np.array([hash_(join(s), seed) for s in zip(*(part[k:] for k in range(width)), strict=False)], np.uint64))
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``fp``, the fingerprint as a signed long."""
    rows = docs.select(*keep, text)

    def make():
        def work(batch):
            for row in zip(*(batch[c] for c in keep), batch[text], strict=True):
                fp = fingerprint(row[-1])
                yield (*row[:-1], fp - (1 << 64) if fp >> 63 else fp)

        return work

    return flat_map(rows, T.StructType([*(rows.schema[c] for c in keep), T.StructField("fp", T.LongType())]), make)


def segment_counts(fp: Column) -> Column:
    """Set bits of each two-bit segment, packed in two bits each."""
    low, other = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    both = fp.bitwiseAND(other).bitwiseAND(low)
    return fp.bitwiseXOR(other).bitwiseAND(low).bitwiseOR(F.shiftleft(both, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed vectors of counts 0, 1 and 2.

    With a count written in unary (0: 00, 1: 01, 2: 11) the distance is the number of differing bits.
    """
    low = F.lit(0x5555555555555555)
    unary = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1).bitwiseAND(low))
    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def links(points: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links (u, v) whose transitive closure joins all within ``BITS`` bits."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    vector = segment_counts(F.col("fp"))
    faces = [F.struct(F.lit(i).alias("face"), vector.bitwiseAND(F.lit(signed(sum(axes)))).alias("cell")) for i, axes in enumerate(combinations(AXES, SHARED))]
    placed = points.select("fp", F.explode(F.array(*faces)).alias("c")).select("fp", "c.face", "c.cell")
    shared = materialize(placed.groupBy("face", "cell").agg(F.count("*").alias("n")).filter("n > 1"))
    members = materialize(placed.join(shared, ["face", "cell"]))
    few = members.filter(F.col("n") <= crowd)
    a, b = few.select("face", "cell", F.col("fp").alias("u")), few.select("face", "cell", F.col("fp").alias("v"))
    close = (
        a.join(b, ["face", "cell"])
        .filter(F.col("u") < F.col("v"))
        .filter(manhattan(segment_counts(F.col("u")), segment_counts(F.col("v"))) <= BITS)
        .filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS)
        .select("u", "v")
    )
    crowded = members.filter(F.col("n") > crowd).select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << k)) for k in range(64)])
    around = crowded.select("fp", F.explode(near).alias("_x")).select("fp", F.col("fp").bitwiseXOR(F.col("_x")).alias("mid"))
    hubs = around.groupBy("mid").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1")
    stars = around.join(hubs, "mid").select(F.col("fp").alias("u"), "v").filter("u <> v")
    return close.union(stars)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep``, ``fp``, ``root`` (the component's least fingerprint) and ``component_id``: the least key of all reachable over links, itself included."""
    marked = materialize(fingerprints(docs, text, (key, *keep)))
    points = materialize(marked.groupBy("fp").agg(F.min(key).alias("_first")))
    roots = components(links(points.select("fp")))
    grouped = points.join(roots, points["fp"] == roots["node"], "left").select(points["fp"], "_first", F.coalesce("root", points["fp"]).alias("root"))
    grouped = materialize(grouped)
    lowest = grouped.groupBy("root").agg(F.min("_first").alias("component_id"))
    return marked.join(grouped.join(lowest, "root").select("fp", "root", "component_id"), "fp")

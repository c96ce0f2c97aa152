"""Source divergence audit (operator 11): how far a language's sources are apart, and which terms set a source off.

Terms are runs of letters (A-Z lower-cased; every character outside ASCII counts as a letter). A language keeps the terms that
``LEAST_DOCS`` of its documents hold. A group, one source of one language, gives each kept term the share
``p = 1 + floor(10^9 * (count + 5) / (N + 5 V))``; so does the language as a whole.

* **Counting.** Each task counts the terms of its documents, with how many hold them, and passes the counts on whenever it holds ``HELD`` of them; only counts are shuffled.
* **Term blocks.** A language's kept terms are dealt to blocks by hash, so many that a dense tile of groups by terms has about ``CELLS`` cells. A tile
  has a row for every group of the language, those without any of its terms too, and is a numpy int64 matrix.
* **Pairs.** All pairs of a tile's rows are broadcast against each other, some rows at a time (``CELLS`` differences at most, one row at least), and summed over the tile's terms: a partial
  pair matrix. Its rows are sums, added up over blocks by the engine with partial sums in each task.
* **Terms.** Each group keeps a heap of its ``TOP`` terms of a tile; the heaps of a group are merged by rank, first within tasks, then over all.

Integers only: the division is carried out in three steps of three digits, which is exact up to 9 * 10^15 terms in a group.
No task needs more than a tile, whose number of terms shrinks with the number of sources; the pair matrix, which is the result, is all that grows with their square.

Defined results: null text, language and source count as empty strings; every row is a document, repeated rows too; a group without terms has p = 1 + floor(10^9 / V) throughout; in a language
without kept terms all pairs have the value 0 and there are no term rows; equal values are ranked by the item's bytes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runs
from ..session import ship
from .common import materialize

LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 10**9, 50
#: Counts that a task holds before it passes them on, and the rows that it passes on at once.
HELD, ROWS = 300_000, 50_000
#: Cells of a tile, and the least number of its terms.
CELLS, LEAST_TERMS = 1 << 20, 64


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held: int = HELD) -> DataFrame:
    """Documents -> (lang, source, term, count, docs), one row for each that occurs. A group has a row with a null term too, with the number of its documents."""
    ship(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])

    def passed_on(groups: dict) -> Iterator[pa.RecordBatch]:
        flat = [(*g, term, *n) for g, terms in groups.items() for term, n in terms.items()]
        for at in range(0, len(flat), ROWS):
            lang, source, term, count, n = zip(*flat[at : at + ROWS], strict=True)
            yield pa.record_batch([pa.array(lang), pa.array(source), pa.array(term, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        size = 0
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, g in enumerate(zip(langs, sources, strict=True)):
                terms = groups.setdefault(g, {None: [0, 0]})
                terms[None][1] += 1
                own: dict = {}
                for part in runs.words(runs.utf8(texts.slice(i, 1))[0], runs.LETTERS):
                    for w in part:
                        own[w] = own.get(w, 0) + 1
                before = len(terms)
                for w, n in own.items():
                    if (sums := terms.get(w)) is None:
                        terms[w] = [n, 1]
                    else:
                        sums[0] += n
                        sums[1] += 1
                size += len(terms) - before
                if size >= held:
                    yield from passed_on(groups)
                    groups, size = {}, 0
        yield from passed_on(groups)

    partial = rows.mapInArrow(counted, "lang string, source string, term string, count long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Counts -> (lang, term, count) of the terms that enough documents of a language hold."""
    by_term = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return by_term.filter(F.col("docs") >= least_docs).select("lang", "term", "count")


def shares(count: np.ndarray, total: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * n_terms)), three digits of the quotient at a time."""
    rest, by, quotient = count + SMOOTHING, total + SMOOTHING * n_terms, np.int64(0)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, by)
        quotient = quotient * 1000 + digits
    return 1 + quotient


def _tiles(counts: DataFrame, kept: DataFrame, cells: int) -> DataFrame:
    """A row for each block and group: (lang, block, source, total, n_terms, cols, counts), and one of the language itself: null source, with ``terms``."""
    groups = counts.filter("term is null").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups")).join(kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("count").alias("total")), "lang", "left")
    wide = F.greatest(F.lit(LEAST_TERMS), F.floor(F.lit(cells) / F.col("n_groups")))
    langs = langs.fillna(0, ["n_terms", "total"]).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n_terms") / wide)).cast("long"))
    langs = materialize(langs)
    # a column of a block is the place of its term in the order of bytes
    placed = kept.join(langs.select("lang", "n_blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("n_blocks"))).drop("n_blocks")
    placed = materialize(placed.withColumn("col", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).cast("int")))
    found = counts.join(placed.select("lang", "term", "block", "col"), ["lang", "term"]).select("lang", "source", "block", "col", "count")
    cellwise = materialize(found.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("col", "count")).alias("cells"), F.sum("count").alias("n")))
    totals = cellwise.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    rows = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs.select("lang", "n_terms", "n_blocks"), "lang")
    rows = rows.select("lang", "source", "total", "n_terms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    rows = rows.join(cellwise.select("lang", "source", "block", "cells"), ["lang", "source", "block"], "left")
    rows = rows.select("lang", "block", "source", "total", "n_terms", F.col("cells.col").alias("cols"), F.col("cells.count").alias("counts"), F.lit(None).cast("array<string>").alias("terms"))
    inside = F.array_sort(F.collect_list(F.struct("col", "term", "count")))
    own = placed.groupBy("lang", "block").agg(inside.alias("cells")).join(langs.select("lang", "total", "n_terms"), "lang")
    own = own.select("lang", "block", F.lit(None).cast("string").alias("source"), "total", "n_terms", F.col("cells.col").alias("cols"), F.col("cells.count").alias("counts"), F.col("cells.term").alias("terms"))
    return rows.unionByName(own)


def _compared(tile: pa.Table, cells: int, top: int) -> Iterator[pa.RecordBatch]:
    """One tile -> partial sums of pairs and the groups' heaps."""
    rows = {s: k for k, s in enumerate(tile.column("source").to_pylist())}
    lang, n_terms = tile.column("lang")[0].as_py(), tile.column("n_terms")[0].as_py()
    own = rows.pop(None, None)
    terms = [] if own is None else tile.column("terms")[own].as_py()
    names, where = list(rows), list(rows.values())
    total = np.array(tile.column("total").to_numpy(), np.int64)

    def counts_of(k: int) -> np.ndarray:
        out = np.zeros(len(terms), np.int64)
        if (cols := tile.column("cols")[k]).is_valid:
            out[cols.values.to_numpy()] = tile.column("counts")[k].values.to_numpy()
        return out

    def batch(source, part, item, value) -> pa.RecordBatch:
        n = len(source)
        return pa.record_batch({"lang": pa.array([lang] * n, pa.string()), "source": pa.array(source, pa.string()), "part": pa.array([part] * n, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    count = np.stack([counts_of(k) for k in where])
    p = shares(count, total[where][:, None], n_terms) if terms else count
    some = max(1, cells // max(1, p.size))
    for at in range(0, len(names), some):
        sums = np.abs(p[at : at + some, None, :] - p[None, :, :]).sum(2)
        for k, line in enumerate(sums, at):
            yield batch([names[k]] * (len(names) - 1), "pair", names[:k] + names[k + 1 :], np.delete(line, k))
    if not terms:
        return
    q = shares(counts_of(own), total[own], n_terms)
    for k, name in enumerate(names):
        ahead = np.flatnonzero((count[k] > 0) & (p[k] > q))
        heap = heapq.nsmallest(top, zip((q[ahead] - p[k, ahead]).tolist(), ahead.tolist(), strict=True))  # the order of columns is that of the terms' bytes
        if heap:
            yield batch([name] * len(heap), "term", [terms[c] for _, c in heap], [-v for v, _ in heap])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by distance (part ``pair``), and the ``top`` terms above the language's share (part ``term``)."""
    counts = materialize(term_counts(docs, text, lang, source))
    kept = materialize(kept_terms(counts, least_docs))
    schema = "lang string, source string, part string, item string, value long"

    def compared(tile: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _compared(pa.Table.from_batches(tile), cells, top)

    found = materialize(_tiles(counts, kept, cells).groupBy("lang", "block").applyInArrow(compared, schema))
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)

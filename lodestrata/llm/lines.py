"""Line deduplication by a log-template tree (operator 9, DataFrame functions only).

A line's blanks are squeezed, and a token with a digit becomes a variable field. The tree has a fixed depth: the number of tokens,
then the first ``DEPTH`` tokens. Below its leaf, a line is a vector of ``FIELDS`` fields: its tokens are dealt evenly over them
(a token a field in short lines) and each field is hashed, so that a line of any length has a vector of one size.

A leaf's general template has in each field what most of its lines have there; a line of the leaf that agrees with it on
``AGREE`` of the fields is an instance, so fields that vary (names, titles) are generalised. What is left of a leaf is split by the field in which one value is commonest: the lines of each value that could recur are a
leaf of their own, with a template of their own, and so are the lines of rarer values together, which disagree with any recurring template there and may do so on as many fields as ``AGREE`` lets vary.
No field is split twice, so the tree stays of fixed depth and takes at most ``FIELDS`` rounds more, however many templates a leaf holds. Lines that end in no template are templates of their own.
A template recurs if it occurs in at least ``LEAST_DOCS`` different documents; it stays in the first document that has it (least ``doc_id``)
and is dropped from all others. Exact and near copies of a document count as one (``representatives``): equal texts do, and texts
whose sketches, the ``SKETCH`` least hashes of all word pairs of the whole text, agree. A sketch joins the commonest one that has ``WINDOW`` of its ``LEADING`` least hashes in a row, if
they agree on ``ALIKE`` of the least hashes of both; documents that only share a passage don't. What joins what is closed over chains of any length (``components``). Otherwise every line of a group of copies would recur; such groups are left to near-deduplication.
So boilerplate goes, whether or not a group of copies has it too, and copied texts stay whole.

The texts are read three times and shuffled once (to cut the lines out); all counting is on narrow rows with
partial sums before each shuffle, so a line that a third of all documents share is a few rows a task.

Defined results: null and empty texts have no lines and stay as they are; blank lines, lines without a token that is fixed, and lines of fewer than ``least_tokens`` tokens are never dropped; equal rows (same id and
text) count as one document and are treated alike; ids may be of any type, a null id comes last; columns ``n_lines`` and ``n_dropped`` of the input are replaced, as would be columns called ``_line_id _line_text _line_cut``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components

DEPTH, FIELDS, AGREE = 3, 8, 0.75
LEAST_DOCS, LEAST_TOKENS = 5, 3
#: Hashes of a sketch, those of them that lead to other sketches, how many of these in a row, and the share that copies agree on.
SKETCH, LEADING, WINDOW, ALIKE = 32, 16, 2, 0.7
_NO_ID = (1 << 63) - 1
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _any(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def masked(text: Column, odd: Column, digits: Column) -> Column:
    """The text with each line's blanks squeezed and its tokens with a digit replaced by a variable field; the flags say whether the text has any of either."""
    text = F.when(odd, F.regexp_replace(F.regexp_replace(text, r"[\s&&[^\n]]+", " "), r"(?md)^ | $", "")).otherwise(text)
    return F.when(digits, F.regexp_replace(text, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "<*>")).otherwise(text)


def _variable(line: Column) -> Column:
    """Whether a masked line has no fixed token."""
    return F.replace(F.replace(line, F.lit("<*>"), F.lit("")), F.lit(" "), F.lit("")) == ""


def _key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with an id that sorts a null last, and the hash of the text."""
    whole = dict(docs.dtypes)[key] in _INTEGERS
    id_ = F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)) if whole else F.coalesce(F.col(key).cast("string"), F.lit("\U0010ffff"))
    return docs.withColumns({"_line_id": id_, "_line_text": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def occurrences(docs: DataFrame, text: str = "text", least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """Keyed documents -> (_line_id, _line_text, at, leaf, n, fields) of every line with enough tokens."""
    bound = lambda b: F.floor(b * F.col("n") / FIELDS).cast("int")
    field = lambda b: F.hash(F.slice("tokens", bound(F.lit(b)) + 1, bound(F.lit(b + 1)) - bound(F.lit(b))))
    body = F.col("body")
    odd = _any(body, "  ", "\t", "\r", "\f", "\x0b", " \n", "\n ") | body.startswith(" ") | body.endswith(" ")
    lines = (
        docs.filter(F.col(text).isNotNull()).select("_line_id", "_line_text", F.col(text).alias("body"))
        .select("_line_id", "_line_text", "body", odd.alias("odd"), body.rlike("[0-9]").alias("digits"))
        .select("_line_id", "_line_text", "digits", F.posexplode(F.split(masked(body, F.col("odd"), F.col("digits")), "\n")).alias("at", "line"))
        .filter((F.col("line") != "") & ~(F.col("digits") & _variable(F.col("line"))))
        .select("_line_id", "_line_text", "at", F.split("line", " ").alias("tokens"))
        .withColumn("n", F.size("tokens"))
    )
    lines = lines.filter(F.col("n") >= least_tokens) if least_tokens > 1 else lines
    return lines.select("_line_id", "_line_text", "at", F.xxhash64("n", F.slice("tokens", 1, DEPTH)).alias("leaf"), "n", F.array(*[field(b) for b in range(FIELDS)]).alias("fields"))


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """Keyed documents -> (_line_text, c, sketch): every distinct text, how often it occurs, and its sketch."""
    pairs = F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.xxhash64(a, b))
    rows = docs.filter(F.col(text).isNotNull()).select("_line_text", F.split(text, " ").alias("words"))
    rows = rows.select("_line_text", F.slice(F.sort_array(F.array_distinct(pairs)), 1, SKETCH).alias("sketch"))
    return rows.groupBy("_line_text").agg(F.count("*").alias("c"), F.max("sketch").alias("sketch"))


def representatives(texts: DataFrame) -> DataFrame:
    """Sketches -> (_line_text, rep) of the texts that count as copies of others: ``rep`` is alike in all texts of a group."""
    window = lambda i: F.xxhash64(F.slice("sketch", i, WINDOW))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("sketch"), F.lit(LEADING)) - (WINDOW - 1))), window)
    held = materialize(texts.select("_line_text", "c", F.explode(F.array_distinct(windows)).alias("k")))
    # a window leads to one sketch only, the commonest, so that many sketches with a window in common make no pairs
    leaders = held.groupBy("k").agg(F.count("*").alias("m"), F.max(F.struct("c", "_line_text")).alias("led")).filter(F.col("m") > 1)
    leaders = materialize(leaders.select("k", F.col("led.c").alias("rc"), F.col("led._line_text").alias("rep")))
    pairs = held.join(leaders, "k").filter((F.col("rc") > F.col("c")) | ((F.col("rc") == F.col("c")) & (F.col("rep") > F.col("_line_text")))).select("_line_text", "rep", "rc").distinct()
    pairs = materialize(pairs.join(texts.select("_line_text", "sketch"), "_line_text"))
    both = pairs.join(texts.select(F.col("_line_text").alias("rep"), F.col("sketch").alias("other")), "rep")
    least = F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH)
    alike = F.size(F.array_intersect(least, F.array_intersect("sketch", "other"))) >= ALIKE * F.size(least)
    found = materialize(both.filter(alike).groupBy("_line_text").agg(F.max(F.struct("rc", "rep"))["rep"].alias("rep")))
    # a representative may have one itself
    out = components(found, "_line_text", "rep").select(F.col("node").alias("_line_text"), F.col("root").alias("rep"))
    for table in (held, leaders, pairs, found):
        discard(table)
    return out


def _filled() -> Column:
    """Fields of a line that hold tokens."""
    return F.least("n", F.lit(FIELDS))


def _counted(lines: DataFrame, *by: str) -> DataFrame:
    """How often each value occurs in each field of a leaf."""
    return lines.select(*by, F.posexplode("fields").alias("f", "v")).groupBy(*by, "f", "v").agg(F.count("*").alias("c"))


def _majority(lines: DataFrame) -> DataFrame:
    """(node, fields) -> (node, general): in each field what most lines of the leaf have."""
    return _counted(lines, "node").groupBy("node", "f").agg(F.max(F.struct("c", "v"))["v"].alias("v")).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("general"))


def _split(lines: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Lines that have no template yet -> (those that go on, with the leaf that they fall into, and the rest).

    A leaf with enough lines is split by value in the field, not split before, of the commonest value among those that vary.
    """
    counted = materialize(_counted(lines, "node", "used").filter(F.expr("shiftright(used, f) & 1") == 0))
    fields = counted.groupBy("node", "f").agg(F.count("*").alias("kinds"), F.max("c").alias("c"), F.sum("c").alias("lines")).filter((F.col("kinds") > 1) & (F.col("lines") >= least_docs))
    # what a join looks up is written before it: both sides are then dealt out anew, and a leaf or template that very many lines share can be split
    best = materialize(fields.groupBy("node").agg(F.max(F.struct("c", "f"))["f"].alias("_f")))
    common = materialize(counted.filter(F.col("c") >= least_docs).join(best.withColumnRenamed("_f", "f"), ["node", "f"]).select("node", F.col("v").alias("_v"), F.lit(True).alias("often")))
    placed = lines.join(best, "node", "left").withColumn("_v", F.get("fields", F.col("_f"))).join(common, ["node", "_v"], "left")
    often, filled = F.coalesce("often", F.lit(False)), _filled()
    rare = F.col("rare") + F.when(often, 0).otherwise(1)
    placed = materialize(placed.select(
        "_line_id", "_line_text", "at", "leaf", "n", "fields", F.xxhash64("node", "_f", F.when(often, F.col("_v"))).alias("node"), F.col("used").bitwiseOR(F.coalesce(F.expr("shiftleft(1, _f)"), F.lit(0))).alias("used"),
        rare.alias("rare"), (F.col("_f").isNotNull() & (rare <= filled - F.ceil(AGREE * filled))).alias("able"),
    ))
    busy = materialize(placed.filter("able").groupBy("node").agg(F.count("*").alias("c")).filter(F.col("c") >= least_docs).select("node", F.lit(True).alias("busy")))
    marked = placed.join(busy, "node", "left")
    return marked.filter("able and busy").drop("able", "busy"), marked.filter("not able or busy is null").drop("able", "busy")


def templates(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Occurrences -> (_line_id, _line_text, at, leaf, own): the template of every line of a leaf that has enough lines."""
    filled = _filled()
    # fields without tokens hold none of the agreement
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(FIELDS - 1)), lambda f: F.col("fields")[f] == F.col("general")[f])) - (F.lit(FIELDS) - filled)
    plain, carried = ("_line_id", "_line_text", "at", "leaf"), ("n", "fields", "node", "used", "rare")
    busy = materialize(found.groupBy("leaf").agg(F.count("*").alias("c")).filter(F.col("c") >= least_docs).select("leaf"))
    rest, named = materialize(found.join(busy, "leaf")).withColumns({"node": F.col("leaf"), "used": F.lit(0), "rare": F.lit(0)}), []
    for depth in range(FIELDS + 1):
        general = materialize(_majority(rest))
        tried = materialize(rest.join(general, "node").select(*plain, *carried, (same >= F.ceil(AGREE * filled)).alias("mine")))
        named.append(tried.filter("mine").select(*plain, F.col("node").alias("own")))
        left = tried.filter(~F.col("mine"))
        rest, out = _split(left, least_docs) if depth < FIELDS else (None, left)
        named.append(out.select(*plain, F.xxhash64("fields").alias("own")))
        if rest is None or rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, named)


def recurring(found: DataFrame, texts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Occurrences and sketches -> the lines to be dropped (_line_id, _line_text, at)."""
    named = materialize(templates(found, least_docs))
    by_text = materialize(named.groupBy("leaf", "own", "_line_text").agg(F.min(F.struct("_line_id", "_line_text")).alias("first")))
    # only where enough different texts have a template does it matter which of them are copies
    often = materialize(by_text.groupBy("leaf", "own").agg(F.count("*").alias("c")).filter(F.col("c") >= least_docs).select("leaf", "own"))
    held = materialize(by_text.join(often, ["leaf", "own"]))
    copies = representatives(materialize(texts.join(held.select("_line_text").distinct(), "_line_text")))
    by_rep = held.join(copies, "_line_text", "left").groupBy("leaf", "own", F.coalesce("rep", "_line_text").alias("rep")).agg(F.min("first").alias("first"))
    often = by_rep.groupBy("leaf", "own").agg(F.count("*").alias("different"), F.min("first").alias("first"))
    often = materialize(often.filter(F.col("different") >= least_docs))
    return named.join(often, ["leaf", "own"]).filter(F.struct("_line_id", "_line_text") != F.col("first")).select("_line_id", "_line_text", "at")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_docs: int = LEAST_DOCS, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``docs`` with the text cut and ``n_lines`` (before) and ``n_dropped``."""
    keyed = _key(docs.drop("n_lines", "n_dropped"), key, text)
    rows = keyed.select("_line_id", "_line_text", text)
    found = materialize(occurrences(rows, text, least_tokens))
    cut = recurring(found, materialize(sketches(rows, text)), least_docs).groupBy("_line_id", "_line_text").agg(F.collect_set("at").alias("_line_cut"))
    lines = F.split(F.col(text), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_line_cut"), lambda i: lines[i])
    return (
        keyed.join(cut.hint("shuffle_hash"), ["_line_id", "_line_text"], "left")  # narrow rows are looked up, so the texts need no sort
        .withColumn("n_lines", F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_dropped", F.when(F.col("_line_cut").isNull(), F.lit(0)).otherwise(F.size("_line_cut")).cast("long"))
        .withColumn(text, F.when(F.col("_line_cut").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
        .select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
    )

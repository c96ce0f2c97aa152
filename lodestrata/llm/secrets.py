"""Secret scan with multipart credential linking (operator 13, DataFrame functions only).

**Strong parts** are reported wherever they occur (kinds ``assign``, ``access``, ``hex``): a value assigned to a word for secrets, a cloud access key identifier, a long run of hexadecimal digits.

**Weak parts** say little alone: a run of exactly 40 characters of a key's alphabet, in both cases and with digits (``key``), a user name (``user``) or a short or oddly written password (``pass``) that is assigned, the address of a service (``endpoint``).
A weak part is reported only with its complement: an identifier (``access``, ``user``) and a secret (``assign``, ``hex``, ``key``, ``pass``) that are in one scope, not
overlapping and at most ``REACH`` characters apart, are linked and both reported; an endpoint is linked and reported if it is as near to a part of such a pair. A scope ends at a blank line.

* Each text is matched where it lies, and only the lengths of matches and of what is between them leave it; positions are running sums over a document's pieces.
* Links come from an interval join: parts are dealt to bins of ``REACH`` characters of their document, identifiers look into the bins around them, and the distance decides. A bin holds
  few parts, whatever the document's length, so neither long documents nor many secrets give pairs in their square; hot documents are split by bin.

Positions are code points, ends exclusive. Matches of a kind are leftmost and don't overlap; those of different kinds may.

Defined results: null and empty texts have no parts; rows are told apart by place, so repeated rows and ids, and null ids, have results of their own; columns ``secrets`` and ``links`` of the input are replaced, as would be
columns called ``_row _pieces``; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

REACH = 240
_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
#: Patterns of the kinds in the order in which they are listed. ``assign`` is matched whole and dropped if its value is short, so that what it covers isn't matched again.
ASSIGN, LEAST_VALUE = rf"((?i:password|passwd|secret|token|api_?key)){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", 6
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "key": "[A-Za-z0-9+/=]{40,}",
    "user": rf"(?i:user(?:_?name|_?id)?|login|client_?id|account_?id|access_?key_?id){_ASSIGNED}[A-Za-z0-9._@-]{{3,}}",
    "pass": rf"(?i:pass|pwd|passphrase|credentials?|auth_?key|private_?key){_ASSIGNED}[^\x20\x09-\x0D\"',;<>]{{4,}}",
    "endpoint": rf"(?i:https?|wss?|s?ftps?|ssh|s3|jdbc:[a-z0-9]{{1,20}}|postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqps?|ldaps?)://[^\x20\x09-\x0D\"'<>]+|(?i:host(?:_?name)?|endpoint|server|base_?url){_ASSIGNED}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){{1,9}}(?::[0-9]{{1,5}})?",
}
STRONG, WEAK = ("assign", "access", "hex"), ("key", "user", "pass", "endpoint")
IDENTIFIERS, SECRETS = ("access", "user"), ("assign", "hex", "key", "pass")
#: A blank line.
BREAK = r"\n[\x20\x09-\x0D]*\n"
#: What a text, once lower-cased, must hold for a kind to occur in it: one of these strings, or a match of this pattern.
NEEDS = {
    "assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("akia",), "hex": "[0-9a-f]{24}", "key": "[a-z0-9+/=]{40}", "user": ("user", "login", "client", "account", "access"),
    "pass": ("pass", "pwd", "credential", "auth", "private"), "endpoint": ("://", "host", "endpoint", "server", "base"),
}
#: Parts a match out of its text; a text that has this noncharacter is handled by a slower way.
MARK = "﷐"
_SPAN = "struct<kind:string,start:long,end:long>"
SPANS, LINKS = f"array<{_SPAN}>", f"array<struct<a:{_SPAN},b:{_SPAN}>>"


def _pieces(text: Column, pattern: str) -> Column:
    """Text and matches in turn: the matches are at the odd places."""
    quick = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit(None).cast("string")))
    slow = F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda p, e: F.array(p, e)))
    return F.when(F.contains(text, F.lit(MARK)), F.slice(slow, F.lit(1), F.size(slow) - 1)).otherwise(quick)


def _held(kind: str, match: Column) -> Column:
    """Whether a match of the pattern counts."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= LEAST_VALUE
    if kind == "key":
        return (F.length(match) == 40) & ~F.contains(match, F.lit("=")) & match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def _hint(lowered: Column, kind: str) -> Column:
    need = NEEDS[kind]
    return lowered.rlike(need) if isinstance(need, str) else reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(p)) for p in need))


def pieces(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``_row`` (the row's number) and ``_pieces``: kind, place, length, and whether a match that counts, of all pieces of a text in which something may be found."""
    names = [c for c in keep if c not in ("secrets", "links", "_row", "_pieces")]
    rows = docs.select(*names, F.col(text).cast("string").alias("_text")).withColumn("_low", F.lower("_text"))
    rows = rows.select(*names, "_text", *[F.coalesce(_hint(F.col("_low"), k), F.lit(False)).alias(f"_{k}") for k in PATTERNS])
    any_of = lambda kinds: reduce(lambda a, b: a | b, (F.col(f"_{k}") for k in kinds))
    paired = any_of(IDENTIFIERS) & any_of(SECRETS)  # else no weak part can be linked
    none = F.array().cast("array<struct<kind:string,i:int,n:int,held:boolean>>")

    def cut(kind: str, pattern: str, may: Column) -> Column:
        piece = lambda p, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.length(p).cast("int").alias("n"), F.when(i % 2 == 1, _held(kind, p)).otherwise(False).alias("held"))
        return F.when(may, F.transform(_pieces(F.col("_text"), pattern), piece)).otherwise(none)

    parts = [cut(k, p, F.col(f"_{k}") if k in STRONG else paired & F.col(f"_{k}")) for k, p in PATTERNS.items()]
    parts.append(cut("break", BREAK, paired))
    return rows.select(*names, F.monotonically_increasing_id().alias("_row"), F.concat(*parts).alias("_pieces"))


def parts(cut: DataFrame) -> DataFrame:
    """Pieces -> (_row, kind, start, end) of the matches that count, blank lines too."""
    flat = cut.filter(F.size("_pieces") > 0).select("_row", F.explode("_pieces").alias("p")).select("_row", "p.*")
    upto = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = flat.withColumn("end", F.sum(F.col("n").cast("long")).over(upto))
    return placed.filter("held").select("_row", "kind", (F.col("end") - F.col("n")).alias("start"), "end")


def _near(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
    """Interval join: pairs of parts of one scope that don't overlap and are at most ``reach`` apart, as structs a and b."""
    span = F.struct("kind", "start", "end")
    at = lambda x: F.floor(x / reach)
    left = a.select("_row", "scope", span.alias("a"), F.explode(F.sequence(at(F.col("start") - reach), at(F.col("end") + reach))).alias("bin"))
    right = b.select("_row", "scope", span.alias("b"), F.explode(F.sequence(at(F.col("start")), at(F.col("end")))).alias("bin"))
    gap = F.greatest("a.start", "b.start") - F.least("a.end", "b.end")
    return left.join(right, ["_row", "scope", "bin"]).filter(gap.between(0, reach)).select("_row", "scope", "a", "b").distinct()


def links(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Parts -> (_row, a, b): identifiers with their secrets, and parts of such pairs with endpoints."""
    whole = Window.partitionBy("_row")
    is_a = lambda kinds: F.max(F.col("kind").isin(*kinds)).over(whole)
    rows = found.withColumn("_both", is_a(IDENTIFIERS) & is_a(SECRETS)).filter("_both")
    scope = F.count_if(F.col("kind") == "break").over(whole.orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    rows = materialize(rows.withColumn("scope", scope).filter("kind <> 'break'").select("_row", "scope", "kind", "start", "end"))
    of = lambda kinds: rows.filter(F.col("kind").isin(*kinds))
    pairs = materialize(_near(of(IDENTIFIERS), of(SECRETS), reach))
    linked = pairs.select("_row", "scope", "a.*").union(pairs.select("_row", "scope", "b.*")).distinct()
    return pairs.drop("scope").union(_near(linked, of(("endpoint",)), reach).drop("scope"))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), reach: int = REACH) -> DataFrame:
    """The columns ``keep`` with ``secrets``, the reported parts in order of start and kind, and ``links`` between them; a row for every document."""
    cut = materialize(pieces(docs, text, keep))
    found = materialize(parts(cut))
    tied = materialize(links(found, reach))
    ends = tied.select("_row", F.col("a").alias("x")).union(tied.select("_row", F.col("b").alias("x"))).select("_row", "x.*")
    told = found.filter(F.col("kind").isin(*STRONG)).union(ends.filter(F.col("kind").isin(*WEAK)).distinct())
    place = F.array_position(F.array(*map(F.lit, PATTERNS)), F.col("kind"))
    ordered = F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind")))
    spans = told.groupBy("_row").agg(F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).cast(SPANS).alias("secrets"))
    of_row = tied.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).cast(LINKS).alias("links"))
    names = [c for c in cut.columns if c not in ("_row", "_pieces")]
    nothing = [F.array().cast(SPANS).alias("secrets"), F.array().cast(LINKS).alias("links")]
    plain = cut.filter(F.size("_pieces") == 0).select(*names, *nothing)
    busy = cut.filter(F.size("_pieces") > 0).join(spans, "_row", "left").join(of_row, "_row", "left")
    return plain.unionByName(busy.select(*names, F.coalesce("secrets", nothing[0]).alias("secrets"), F.coalesce("links", nothing[1]).alias("links")))


def digests(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scanned documents -> counts of the strong kinds, the hash of the strong spans and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*STRONG))
    return scanned.select(*keep, *map(number, STRONG), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"), F.size("links").cast("long").alias("n_links"))

"""Text columns: cleanup, names, snippets, dates, amounts and written numbers."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that don't tell names apart (fixed values).
NOISE = ("llc", "lp", "inc", "corp", "the", "at", "property", "properties")
#: Number words (fixed values).
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
MONTHS = "january february march april may june july august september october november december".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()


def normal_name(name: Column) -> Column:
    """Lower-cased, without noise words and punctuation, blanks squeezed."""
    words = F.filter(F.split(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+"), lambda w: ~w.isin(*NOISE))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(words, " "), r"[^\w\s]", ""), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


#: What run-together words of scanned contracts are made of (fixed values).
FIRST = "of|and|or|in|to|by|at|on|the|for|is|as|be|if|day|not|due|all|sum"
SECOND = "the|this|that|all|any|such|said|each|of|in|on|which|not|land|April|May|June|July|August|September|October|November|December|January|February|March"


def clean_pdf(text: Column) -> Column:
    """A garbled ordinal mended, camel case and run-together words split, ordinals rejoined."""
    steps = ((r"\biA\b", "1st"), (r"(?<=[a-z])(?=[A-Z])", " "), (rf"(?i)\b({FIRST})({SECOND})\b", "$1 $2"), (r"(\d)\s*s\s*t\b", "$1st"), (r"(\d)\s*n\s*d\b", "$1nd"), (r"(\d)\s*r\s*d\b", "$1rd"), (r"(\d)\s*t\s*h\b", "$1th"))
    return reduce(lambda c, s: F.regexp_replace(c, *map(F.lit, s)), steps, text)


def snippet(text: Column, part: str, width: int = 60) -> Column:
    """A stretch around the first match, which is marked; the head of the text without one."""
    at = F.locate(part.lower(), F.lower(text))
    begin = F.greatest(F.lit(1), at - width)
    found = F.concat(
        F.when(begin > 1, "...").otherwise(""), F.substring(text, begin, at - begin), F.lit("<mark>"), F.substring(text, at, F.lit(len(part))), F.lit("</mark>"),
        F.substring(text, at + len(part), F.lit(width)), F.when(F.length(text) > at + len(part) + width - 1, "...").otherwise(""),
    )
    return F.when(at > 0, found).otherwise(F.substring(text, F.lit(1), F.lit(2 * width)))


def parse_date(text: Column) -> Column:
    """ISO, US with four-digit and US with two-digit years; else null."""
    tries = (F.when(text.rlike(p), F.try_to_date(text, f)) for p, f in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy")))
    return F.coalesce(*tries)


def month_year(text: Column, pivot: int = 80) -> Column:
    """MM/YY as the first of that month; two-digit years from the pivot on lie in the 1900s."""
    month, year = (F.regexp_extract(text, r"^(\d{1,2})/(\d{2})$", k).try_cast("int") for k in (1, 2))
    return F.when(month.between(1, 12), F.make_date(F.when(year >= pivot, 1900 + year).otherwise(2000 + year), month, F.lit(1)))


def legal_date(text: Column, pivot: int = 50) -> Column:
    """"first day of April, 2027", "April 15, 1996", "3/15/10" -> MM/DD/YYYY; else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    names = "|".join(MONTHS)
    day_of = rf"({'|'.join(ORDINALS)}|\d{{1,2}}(?:st|nd|rd|th)?)\s+day\s+of\s+({names}),?\s+(\d{{4}})"
    plain = rf"({names})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
    us = r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\b"
    number = lambda c, words: F.coalesce(F.regexp_extract(c, r"^(\d+)", 1).try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, words)), c), F.lit(0)).cast("int"))
    spell = lambda y, m, d: F.format_string("%02d/%02d/%04d", m, d, y)
    part = lambda p, k: F.regexp_extract(low, p, k)
    short = part(us, 3).try_cast("int")
    year = F.when(F.length(part(us, 3)) == 4, short).when(short >= pivot, 1900 + short).otherwise(2000 + short)
    return (
        F.when(low.rlike(day_of), spell(part(day_of, 3).try_cast("int"), number(part(day_of, 2), MONTHS), number(part(day_of, 1), ORDINALS)))
        .when(low.rlike(plain), spell(part(plain, 3).try_cast("int"), number(part(plain, 1), MONTHS), part(plain, 2).try_cast("int")))
        .when(low.rlike(us), spell(year, part(us, 1).try_cast("int"), part(us, 2).try_cast("int")))
    )


def number(text: Column) -> Column:
    """A number without $, commas, percent signs and blanks; (1,234) is negative; else null."""
    bare = F.regexp_replace(F.trim(text), r"[$,%\s]", "")
    inner = F.regexp_extract(bare, r"^\((.*)\)$", 1)
    return F.when(inner != "", -inner.try_cast("double")).otherwise(bare.try_cast("double"))


def written_number(text: Column) -> Column:
    """"THREE MILLION", "seven and 26/100" -> a number; null if a word is no number. A fold over the words."""
    low = F.lower(F.trim(text))
    cents = F.regexp_extract(low, r"(\d+)/100", 1).try_cast("double")
    body = F.regexp_replace(F.regexp_replace(low, r"(and\s+)?\d+/100.*$", ""), r"[,-]|\band\b|\bdollars?\b", " ")
    words = F.filter(F.split(F.trim(body), r"\s+"), lambda w: w != "")
    value = F.create_map(*[F.lit(x) for k, w in enumerate(UNITS) for x in (w, float(k))], *[F.lit(x) for k, w in enumerate(TENS) for x in (w, 20.0 + 10 * k)])
    scale = F.create_map(*[F.lit(x) for w, v in SCALES.items() for x in (w, float(v))])
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("now"), F.lit(True).alias("ok"))

    def add(s: Column, w: Column) -> Column:
        v, m = F.try_element_at(value, w), F.try_element_at(scale, w)
        grown = F.greatest(s["now"], F.lit(1.0)) * m
        return F.when(v.isNotNull(), F.struct(s["total"].alias("total"), (s["now"] + v).alias("now"), s["ok"].alias("ok"))).when(
            m == 100, F.struct(s["total"].alias("total"), grown.alias("now"), s["ok"].alias("ok"))
        ).when(m.isNotNull(), F.struct((s["total"] + grown).alias("total"), F.lit(0.0).alias("now"), s["ok"].alias("ok"))).otherwise(F.struct(s["total"].alias("total"), s["now"].alias("now"), F.lit(False).alias("ok")))

    return F.aggregate(words, start, add, lambda s: F.when(s["ok"] & (F.size(words) > 0), s["total"] + s["now"] + F.coalesce(cents / 100, F.lit(0.0))))


def loan_term(months: Column) -> Column:
    """Months as "X years, Y months"."""
    years, rest = F.floor(months / 12).cast("int"), (months % 12).cast("int")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s")))
    return F.concat_ws(", ", part(years, "year"), part(rest, "month"))


def garbled_dollars(text: Column) -> Column:
    """"$3000,.00000" -> 3000000: padding of four zeros or more means thousands; else the last point is the decimal one."""
    body = F.regexp_replace(text, r"[$\s]", "")
    padded = F.regexp_extract(body, r"^(\d+)[,.]+0{4,}$", 1)
    whole, tail = F.regexp_replace(F.regexp_extract(body, r"^(.*)\.(\d{1,2})$", 1), r"[,.]", ""), F.regexp_extract(body, r"^(.*)\.(\d{1,2})$", 2)
    return F.when(padded != "", padded.try_cast("double") * 1000).when(tail != "", F.concat(whole, F.lit("."), tail).try_cast("double")).otherwise(F.regexp_replace(body, r"[,.]", "").try_cast("double"))


def percentage(text: Column, is_rate: bool = False) -> Column:
    """"72.6%", "5 1/2%": a number of percent; a rate over 20 without a point has lost it after its first digit."""
    fraction = r"(\d+)\s+(\d+)/(\d+)\s*%"
    a, b, c = (F.regexp_extract(text, fraction, k).try_cast("double") for k in (1, 2, 3))
    plain = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1)
    value = F.when(a.isNotNull() & (c > 0), a + b / c).otherwise(plain.try_cast("double"))
    if not is_rate:
        return value
    return F.when((value > 20) & plain.rlike(r"^\d{3}$"), value / 100).otherwise(value)


def bedrooms(unit_type: Column) -> Column:
    """The category that a unit type's name tells; the first that fits counts."""
    low = F.lower(F.coalesce(unit_type, F.lit("")))
    return (
        F.when(low.contains("studio"), "Studio").when(low.contains("alcove"), "Alcove").when(low.rlike("3[ -]bedroom|3br"), "3 Bedroom")
        .when(low.rlike("2 bedroom|2br"), "2 Bedroom").when(low.rlike("1 bedroom|1br"), "1 Bedroom").otherwise("Other")
    )


def affordability(unit_type: Column) -> Column:
    low = F.lower(F.coalesce(unit_type, F.lit("")))
    is_affordable = low.contains("affordable")
    return F.when(is_affordable & low.contains("vintage"), "affordable_vintage").when(low.contains("new affordable"), "new_affordable").when(is_affordable, "affordable_lihtc").otherwise("market")


def column_letter(index: Column) -> Column:
    """A sheet's column from 1 on as letters: numbers of base 26 without a zero. Three letters suffice for any sheet."""
    letter = lambda n: F.when(n > 0, F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (n - 1) % 26 + 1, F.lit(1))).otherwise("")
    second = F.floor((index - 1) / 26).cast("int")
    third = F.floor((second - 1) / 26).cast("int")
    return F.concat(letter(third), letter(second), letter(index.cast("int")))


@F.pandas_udf(T.StringType())
def json_part(texts: pd.Series) -> pd.Series:
    """The JSON in an answer with words around it: from the first bracket to its partner, a list before an object; null if that is none."""

    def balanced(text: str, opening: str, closing: str) -> str | None:
        depth, begin = 0, text.find(opening)
        for m in re.finditer(re.escape(opening) + "|" + re.escape(closing), text[begin:]) if begin >= 0 else ():
            depth += 1 if m[0] == opening else -1
            if not depth:
                return text[begin : begin + m.end()]
        return None

    def one(text: str | None) -> str | None:
        for pair in ("[]", "{}"):
            part = balanced(text or "", *pair)
            if part:
                try:
                    json.loads(part)
                    return part
                except ValueError:
                    continue
        return None

    return texts.map(one)

"""Personal data: keyed surrogates (operator 4, DataFrame functions only).

Entities are found by one pattern: e-mail addresses, access keys, hexadecimal secrets, bank account numbers (IBAN), card numbers,
social-security numbers, telephone numbers, IPv6 and IPv4 addresses, and names after a title.

A surrogate is drawn by a keyed permutation, not by a hash: the variable characters of an entity (digits, letters, vowels, and so
on, each in its own pool) are the digits of a number of mixed radix, and a Feistel network over its even and odd places maps the
numbers of one format onto each other. So two entities never have one surrogate, whatever their number, and no draw has to be repeated
or looked up: texts are rewritten in place, without a shuffle. The permutation is an inner one of a shift (encrypt, add, decrypt),
which has no fixed point: no entity stays as it is.

What stays: lengths, separators, letter case, scripts, country codes, top-level domains, prefixes of keys, the first digit of cards, the validity
or invalidity of check digits, titles. Names are mapped part by part, vowels to vowels and consonants to consonants of the script, so "Mr. Smith" and
"Mr. John Smith" share a family name; given names keep their last letter and Cyrillic family names their ending, which tell the gender. One number
has one surrogate however it is spaced, and mailboxes of one domain stay together.

Collision check: the distinct pairs of entity and surrogate of the whole table are counted, and a surrogate of two entities is an error.

Defined results: null and empty texts stay as they are with no entities; repeated rows are treated alike; columns ``n_entities`` and ``entities``
of the input are replaced, as would be columns called ``_pieces _found _made``.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Titles by gender (fixed values).
MALE = "Mr|Sir|Herr|Monsieur|Señor|Sr|Г-н|Господин"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Г-жа|Госпожа"
NEUTRAL = "Dr|Prof"
_TITLES = f"{MALE}|{FEMALE}|{NEUTRAL}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Patterns in the order in which they are tried; none starts within a run of ASCII letters and digits.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9-]{0,62}+(?:\.[A-Za-z0-9-]{1,63}+){0,125}\.[A-Za-z]{2,63}",
    "access": r"A(?:KIA|SIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?=(?:[A-Z ]{0,40}[0-9]){10})(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|\+(?=(?:[ .()-]*[0-9]){8})[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){2,5}(?![0-9A-Za-z])",
    "ipv6": rf"(?:{_HEX}:){{7}}{_HEX}(?![0-9A-Za-z:])|(?:{_HEX}:){{2,6}}:?(?:(?<=::){_HEX})(?::{_HEX}){{0,4}}(?![0-9A-Za-z:])",
    "ip": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
}
NAME = rf"(?<!\p{{L}})(?:{_TITLES})\.? [\p{{Lu}}\p{{Lo}}][\p{{L}}\p{{M}}'’-]+(?: [\p{{Lu}}\p{{Lo}}][\p{{L}}\p{{M}}'’-]+){{0,2}}"
#: What a text must hold for a kind to occur in it: one of these strings, or a match of this pattern. Each follows from the kind's own pattern.
NEEDS = {
    "email": ("@",), "access": ("AKIA", "ASIA"), "secret": "[0-9a-f]{32}", "iban": "[0-9]", "card": "[0-9]", "ssn": "[0-9]", "phone": "[0-9]", "ipv6": (":",), "ip": "[0-9]", "name": tuple(_TITLES.split("|")),
}
_START = "(?<![A-Za-z0-9])"
PATTERN = f"{_START}(?:{'|'.join(KINDS.values())})|{NAME}"
_PLAIN = (
    "0123456789", "bcdfghjklmnpqrstvwxz", "aeiouy", "бвгджзйклмнпрстфхцчшщґ", "аеёиоуыэюяіїє", "βγδζθκλμνξπρστφχψ", "αεηιουω", "άέήίόύώ",
    "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "कखगघचछजझटठडढणतथदधनपफबभमयरलवशसह",
    "かきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ", "カキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
)


def _letters_of(low: int, high: int, kind: str = "Ll", among=lambda c: True) -> str:
    """Letters of a range that are in no pool above: lower-case ones that come back from upper case (``Ll``), or caseless ones (``Lo``). A pool never has both."""
    fits = lambda c: c.upper() == c if kind == "Lo" else len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c
    return "".join(c for c in map(chr, range(low, high + 1)) if unicodedata.category(c) == kind and fits(c) and c not in "".join(_PLAIN) and among(c))


_VOWELS = lambda c: unicodedata.normalize("NFD", c)[0] in "aeiouyæø"
#: Letters and digits that replace each other: digits, Latin, Cyrillic, Greek, Hebrew, Arabic, Devanagari, kana (fixed values); then, by code charts, Latin vowels
#: and consonants with marks, other Cyrillic, Thai, and the consonants of Bengali, Gurmukhi, Gujarati, Oriya, Tamil, Telugu, Kannada and Malayalam.
POOLS = (
    *_PLAIN, _letters_of(0xC0, 0x17F, "Ll", _VOWELS) + _letters_of(0x1E00, 0x1EFF, "Ll", _VOWELS), _letters_of(0xC0, 0x24F, "Ll", lambda c: not _VOWELS(c)), _letters_of(0x430, 0x52F), _letters_of(0xE01, 0xE2E, "Lo"),
    *(_letters_of(block + 0x15, block + 0x39, "Lo") for block in range(0x980, 0xD80, 0x80)),
)
#: The sets of pools by number: for names; without vowels told apart, for other entities; for hexadecimal numbers.
POOL_SETS = (POOLS, ("0123456789", "abcdefghijklmnopqrstuvwxyz"), ("0123456789abcdef",))
NAMES, PLAIN, HEX = range(3)
#: Blocks of letters that are one pool each, first and last code point: Hangul syllables, Han characters, Georgian, Armenian.
BLOCKS = ((0xAC00, 0xD7A3), (0x4E00, 0x9FA5), (0x10D0, 0x10F0), (0x0561, 0x0586))
#: Letters of other scripts stay within their row of so many code points, where all of it is letters without case and none is in a pool or a block; any other letter is left as it is. So what
#: a letter may become is always in the same pool, block or row, and no two letters ever share one.
ROW = 16


def _rows() -> list[tuple[int, int]]:
    """Ranges of whole rows, first and last code point."""
    taken = {x for c in "".join(POOLS) for x in (c, c.upper())}
    free = lambda x: unicodedata.category(chr(x)) == "Lo" and chr(x) not in taken and not any(low <= x <= high for low, high in BLOCKS)
    out: list[tuple[int, int]] = []
    for first in range(0x100, 0x10000, ROW):
        if all(map(free, range(first, first + ROW))):
            out[-1:] = [(out[-1][0], first + ROW - 1)] if out and out[-1][1] == first - 1 else [*out[-1:], (first, first + ROW - 1)]
    return out


ROWS = _rows()


def _cases() -> tuple[str, str]:
    """Upper-case letters and their lower-case ones, of pools and blocks. No other letter has a case here: a Kelvin sign is no K."""
    every = "".join(POOLS) + "".join(chr(x) for low, high in BLOCKS for x in range(low, high + 1) if chr(x).upper() != chr(x))
    pairs = [(c.upper(), c) for c in every if c.upper() != c]
    return "".join(u for u, _ in pairs), "".join(c for _, c in pairs)


CASES = _cases()
ROUNDS = 4
#: Parts an entity out of its text; a text that has this noncharacter is handled by a slower way.
MARK = "﷐"


def kind(entity: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def hinted(text: Column) -> Column:
    """False only where no kind can occur; much cheaper than the pattern."""
    parts = dict.fromkeys(p for need in NEEDS.values() for p in ([need] if isinstance(need, str) else need))
    patterns = {need for need in NEEDS.values() if isinstance(need, str)}
    return reduce(lambda a, b: a | b, (text.rlike(p) if p in patterns else F.contains(text, F.lit(p)) for p in parts))


def pieces(text: Column) -> Column:
    """Text and entities in turn: the entities are at the odd places."""
    quick = F.split(F.regexp_replace(text, F.lit(PATTERN), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array(F.lit(None).cast("string")))
    slow = F.flatten(F.zip_with(F.split(text, PATTERN, -1), found, lambda p, e: F.array(p, e)))
    return F.when(~hinted(text), F.array(text)).when(F.contains(text, F.lit(MARK)), F.slice(slow, F.lit(1), F.size(slow) - 1)).otherwise(quick)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _code(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def _table(value) -> Column:
    """A list of integers of every set of pools, by the set's number."""
    return F.expr(f"array({', '.join(f'array({", ".join(map(str, value(pools)))})' for pools in POOL_SETS)})")


def _letters(pools: Column) -> Column:
    return F.get(F.array(*[F.lit("".join(p)) for p in POOL_SETS]), pools)


def _placed(c: Column, pools: Column) -> Column:
    """A lower-case character -> start of its pool, size, place in it; size 1 stays. A pool of the set numbered ``pools`` has the start -1 - its place in the set."""
    row = lambda start, size, place: F.struct(start.cast("int").alias("start"), size.cast("int").alias("n"), place.cast("int").alias("x"))

    def inside(at: Column) -> Column:
        begin = F.get(F.get(_table(lambda ps: [len("".join(ps[:k])) for k, p in enumerate(ps) for _ in p]), pools), at - 1)
        size = F.get(F.get(_table(lambda ps: [len(p) for p in ps for _ in p]), pools), at - 1)
        return row(-1 - begin, size, at - 1 - begin)

    def outside(code: Column) -> Column:
        in_row = F.exists(F.expr(f"array({', '.join(f'struct({low} as low, {high} as high)' for low, high in ROWS)})"), lambda r: code.between(r["low"], r["high"]))
        out = F.when(in_row, row(F.floor(code / ROW) * ROW, F.lit(ROW), code % ROW)).otherwise(row(F.lit(0), F.lit(1), F.lit(0)))
        for low, high in BLOCKS:
            out = F.when(code.between(low, high), row(F.lit(low), F.lit(high - low + 1), code - low)).otherwise(out)
        return out

    other = F.when(pools == NAMES, _let(_code(c), outside)).otherwise(row(F.lit(0), F.lit(1), F.lit(0)))
    return _let(F.instr(_letters(pools), c), lambda at: F.when((at > 0) & (F.length(c) == 1), inside(at)).otherwise(other))


def permuted(body: Column, secret: Column, pools: Column) -> Column:
    """``body`` with its characters mapped within their pools by the permutation that ``secret`` names; ``pools``: number of the set of pools."""
    low = lambda c: F.translate(c, *CASES)

    def turned(x: Column, n: Column, sign: int) -> Column:
        """The Feistel network (sign 1) or its inverse (-1) on the digits ``x`` of radices ``n``."""

        def one(digits: Column, r: Column) -> Column:
            other = F.array_join(F.filter(digits, lambda _, i: i % 2 != r % 2).cast("array<string>"), ",")
            stream = F.sha2(F.concat_ws("|", secret, r.cast("string"), F.array_join(n.cast("array<string>"), ","), other), 256)
            step = lambda d, i, key: F.when(i % 2 == r % 2, F.pmod(d + sign * F.pmod(F.xxhash64(key, i), F.get(n, i)).cast("int"), F.get(n, i))).otherwise(d)
            return _let(stream, lambda key: F.transform(digits, lambda d, i: step(d, i, key)))

        rounds = [F.lit(r) for r in (range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)))]
        return F.aggregate(F.array(*rounds), x, one)

    def drawn(places: Column) -> Column:
        """Places -> the new digits of those that vary."""
        free = F.filter(places, lambda p: p["n"] > 1)
        n = F.transform(free, lambda p: p["n"])
        shifted = lambda x: F.transform(x, lambda d, i: F.when(i == 0, F.pmod(d + 1 + F.pmod(F.xxhash64(secret), F.get(n, i) - 1).cast("int"), F.get(n, i))).otherwise(d))
        return _let(turned(F.transform(free, lambda p: p["x"]), n, 1), lambda e: turned(shifted(e), n, -1))

    def spelled(state: Column) -> Column:
        where = F.filter(F.sequence(F.lit(0), F.size(state["places"]) - 1), lambda i: F.get(state["places"], i)["n"] > 1)
        every = _letters(pools)

        def char(c: Column, i: Column, where: Column) -> Column:
            p = F.get(state["places"], i)
            new = _let(F.get(state["drawn"], (F.array_position(where, i) - 1).cast("int")), lambda d: F.when(p["start"] < 0, F.substr(every, d - p["start"], F.lit(1))).otherwise(_char(p["start"] + d)))
            return F.when(p["n"] == 1, c).when(low(c) != c, F.upper(new)).otherwise(new)

        return _let(where, lambda w: F.array_join(F.transform(state["chars"], lambda c, i: char(c, i, w)), ""))

    chars = F.filter(F.split(body, ""), lambda c: c != "")
    placed = _let(chars, lambda cs: F.struct(cs.alias("chars"), F.transform(cs, lambda c: _placed(low(c), pools)).alias("places")))
    done = _let(placed, lambda s: F.struct(s["chars"].alias("chars"), s["places"].alias("places"), drawn(s["places"]).alias("drawn")))
    varies = lambda s: F.exists(s["places"], lambda p: p["n"] > 1)
    return F.when(F.length(body) == 0, body).otherwise(_let(done, lambda s: F.when(varies(s), spelled(s)).otherwise(body)))


def luhn(digits: Column) -> Column:
    """The check digit that belongs after these digits; anything else among them is passed over."""
    plain = F.reverse(F.filter(F.split(digits, ""), lambda c: c.rlike("^[0-9]$")))
    value = lambda c, i: F.when(i % 2 == 1, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
    return F.pmod(-F.aggregate(F.transform(plain, value), F.lit(0), lambda a, x: a + x), F.lit(10))


def iban_check(country: Column, body: Column) -> Column:
    """The check number (2 to 98) that belongs to a country and an account."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    folded = lambda a, v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))
    signs = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c.rlike("^[0-9A-Z]$"))
    return 98 - F.aggregate(F.transform(signs, value), F.lit(0), folded)


def _part(label: Column, head: Column, body: Column, tail: Column) -> Column:
    return F.struct(label.alias("label"), head.alias("head"), body.alias("body"), tail.alias("tail"))


def _name_parts(value: Column) -> Column:
    """A title and up to three names -> the names; the last is the family name."""
    title, rest = F.regexp_extract(value, r"^(\S+) (.*)$", 1), F.regexp_extract(value, r"^(\S+) (.*)$", 2)
    gender = F.when(title.rlike(rf"^(?:{FEMALE})\.?$"), "f").when(title.rlike(rf"^(?:{MALE})\.?$"), "m").otherwise("")

    def part(p: Column, i: Column, last: Column, gender: Column) -> Column:
        family = i == last
        ending = F.when(~family, 1).when(~p.rlike(r"\p{IsCyrillic}"), 0).when(gender == "f", 3).when(gender == "m", 2).otherwise(0)
        ending = F.when(F.length(p) >= ending + 2, ending).otherwise(0)
        label = F.when(family, F.lit("family")).otherwise(F.concat(F.lit("given "), gender))
        head = F.when(i == 0, F.concat(title, F.lit(" "))).otherwise(F.lit(" "))
        return _let(ending, lambda n: _part(label, head, F.substr(p, F.lit(1), F.length(p) - n), F.substr(p, F.length(p) - n + 1, n)))

    return _let(gender, lambda g: _let(F.split(rest, " "), lambda names: F.transform(names, lambda p, i: part(p, i, F.size(names) - 1, g))))


def _parts(value: Column, what: Column) -> Column:
    """An entity of the kind ``what`` -> label, head, body, tail of each part: heads and tails stay, bodies are permuted under their labels."""
    none = F.lit("")
    upto = lambda pattern: F.regexp_extract(value, pattern, 1)
    whole = lambda label, head=none, tail=none: F.array(_part(label, head, F.substr(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail)), tail))
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda o: F.lower(F.lpad(F.hex(o.cast("long")), 2, "0"))), "")
    mail = F.array(_part(F.lit("mailbox"), none, upto("^(.*)@"), F.lit("@")), _part(F.lit("domain"), none, upto(r"@(.*)\.[A-Za-z]+$"), upto(r"(\.[A-Za-z]+)$")))
    return (
        F.when(what == "email", mail)
        .when(what == "name", _name_parts(value))
        .when(what == "ip", F.array(_part(what, none, octets, none)))
        .when(what.isin("access", "iban"), whole(what, F.substr(value, F.lit(1), F.lit(4))))
        .when(what == "card", whole(what, F.substr(value, F.lit(1), F.lit(1)), F.substr(value, F.length(value), F.lit(1))))
        .when(what == "phone", whole(what, upto(r"^(\+[0-9]{1,3}[ .-]?|)")))
        .otherwise(whole(what))
    )


def _checked(value: Column, what: Column, new: Column) -> Column:
    """The permuted entity ``new`` with check digits as right or wrong as those of ``value``; addresses get their dots again."""
    head = lambda x: F.substr(x, F.lit(1), F.length(x) - 1)
    digit = lambda x: F.substr(x, F.length(x), F.lit(1)).cast("int")
    card = F.concat(head(new), F.pmod(luhn(head(new)) + digit(value) - luhn(head(value)), F.lit(10)).cast("string"))
    country, given, account = F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(3), F.lit(2)).cast("int"), lambda x: F.substr(x, F.lit(5), F.length(x))
    check = 2 + F.pmod(iban_check(country, account(new)) - 2 + given - iban_check(country, account(value)), F.lit(97))
    iban = F.when(given.between(2, 98), F.concat(country, F.lpad(check.cast("string"), 2, "0"), account(new))).otherwise(new)
    ip = F.array_join(F.transform(F.array(*map(F.lit, (1, 3, 5, 7))), lambda i: F.conv(F.substr(new, i, F.lit(2)), 16, 10)), ".")
    return F.when(what == "card", card).when(what == "iban", iban).when(what == "ip", ip).otherwise(new)


def surrogate(value: Column, key: str) -> Column:
    """The surrogate of an entity."""
    pools = lambda what: F.when(what == "name", NAMES).when(what.isin("secret", "ipv6", "ip"), HEX).otherwise(PLAIN)
    one = lambda p, what: F.concat(p["head"], permuted(p["body"], F.concat(F.lit(f"{key}|"), p["label"]), pools(what)), p["tail"])
    joined = lambda what: F.array_join(F.transform(_parts(value, what), lambda p: one(p, what)), "")
    return _let(kind(value), lambda what: _let(joined(what), lambda new: _checked(value, what, new)))


def collisions(pairs: DataFrame) -> DataFrame:
    """Pairs ``value``, ``surrogate`` -> surrogates of more than one value."""
    return pairs.distinct().groupBy("surrogate").agg(F.count("*").alias("n")).filter("n > 1")


def anonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with entities replaced in ``text``, and ``n_entities`` and ``entities`` (how many of each kind)."""
    names = [c for c in docs.columns if c not in ("n_entities", "entities")]
    odd = lambda x: F.filter(x, lambda _, i: i % 2 == 1)
    none = F.array().cast("array<string>")
    parted = docs.select(*names, F.coalesce(pieces(F.col(text)), none).alias("_pieces")).withColumn("_found", odd(F.col("_pieces")))
    made = parted.withColumn("_made", F.transform("_found", lambda e: surrogate(e, key)))
    joined = F.array_join(F.transform("_pieces", lambda p, i: F.when(i % 2 == 1, F.get("_made", F.floor(i / 2).cast("int"))).otherwise(p)), "")
    kinds = F.transform("_found", kind)
    counts = F.filter(F.transform(F.array(*map(F.lit, [*KINDS, "name"])), lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("n"))), lambda x: x["n"] > 0)
    some = F.size("_found") > 0
    out = materialize(made.select(
        *[F.when(some, joined).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in names],
        F.size("_found").alias("n_entities"),
        F.when(some, counts).otherwise(F.array().cast("array<struct<kind:string,n:int>>")).alias("entities"),
        F.when(some, F.arrays_zip(F.col("_found").alias("value"), F.col("_made").alias("surrogate"))).alias("_pairs"),
    ))
    twice = collisions(out.select(F.explode("_pairs").alias("p")).select("p.value", "p.surrogate"))
    if not twice.isEmpty():  # can't be by construction
        discard(out)
        raise RuntimeError("two entities have one surrogate")
    return out.drop("_pairs")

"""Byte-level BPE encoding and decoding (operator 7).

The ranked merges are compiled into a finite-state transducer that is determinised
only as far as texts call for it. A state is the string of bytes read but not yet
emitted. On a byte, every *live* boundary of that string is considered: one
after which the rest could still grow into a longer token that the token before it doesn't break up. The tokens on which the encodings
up to all live boundaries agree are certain whatever follows, so they are emitted;
the rest is the next state. The rest stays below twice the longest token: that is the bounded lookahead.
This is exact because a stretch of a valid BPE encoding is itself the encoding of its bytes.
A transition merges nothing anew: the encoding up to the byte read is the one up to a live boundary and a last token, and that boundary is the one whose last token stays apart
from the new one. Which two tokens stay apart is found by their merges and kept.

Each match of the split pattern is encoded by itself, some ``MATCHES`` of them at a time, so a very long text is never a list of all its matches. Matches seen before are answered from a
bounded cache of two generations, and so is what is known of pairs of tokens; transitions are forgotten together when there are too many. All are trimmed within a text too, and what falls out is
built again when it is needed.

Decoding is a stream: ids are turned to bytes chunk by chunk and an incremental UTF-8 machine, whose state is
the begun character (at most three bytes), emits whole characters. What can't become a character turns into U+FFFD.

Defined results: a null or empty text has no ids and decodes to the empty text; other columns pass through
(``ids`` or ``decoded`` of the input are replaced).
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import flat_map

#: Entries of a generation of the cached matches and of the pairs of tokens; two generations are held of each, and as many transitions as two of theirs.
PIECES_HELD = 100_000
STEPS_HELD = 100_000
CHUNK = 4096
#: Characters of a text up to which its matches are listed at once, matches taken at once from a longer one, and bytes of a match after which transitions are trimmed.
LISTED, MATCHES, TRIMMED = 1 << 20, 1 << 16, 1 << 16
#: States are numbered by multiples of the one; the other marks a transition that emits.
STATE, EMITS = 512, 256
#: Above all ranks.
NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a line has the token in base64 and its rank."""
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def _bytes(data: bytes) -> list[bytes]:
    return [data[k : k + 1] for k in range(len(data))]


class _Generations(dict):
    """A bounded cache: what the present generation lacks is taken from the one before, else made anew."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def trim(self, most: int) -> None:
        if len(self) > most:
            self.before = dict(self)
            self.clear()


class _Made(dict):
    """Values that are made as they are asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        found = self[key] = self.make(key)
        return found


class Transducer:
    """Emits the ids of one match's bytes, as little-endian unsigned 32-bit integers.

    A state is named by its bytes and numbered by a multiple of ``STATE``. It has its live boundaries, its end among them, and where the last token before a
    boundary begins; the latter is right for the live boundaries and those that lead to them, and nothing else is asked for. A transition
    is kept under the state's number and the byte read. It is the next state's number, with ``EMITS`` added if something became certain.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.code = {t: r.to_bytes(4, "little") for t, r in ranks.items()}
        self.soonest = {}  # of what tokens begin with: the lowest rank at which one of these tokens merges its first byte
        for t in ranks:
            taken = next((rank for rank, k in self._merges(_bytes(t)) if not k), NEVER)
            for k in range(1, len(t)):
                self.soonest[t[:k]] = min(taken, self.soonest.get(t[:k], NEVER))
        self.fits, self.taken = _Generations(self._fits), _Generations(self._taken)
        self.steps, self.ends = _Made(self._step), _Made(self._end)
        self.numbers, self.states, self.emitted = {}, [], {}
        self._number(b"", (0,), (0,))

    def _merges(self, parts: list[bytes]) -> Iterator[tuple[int, int]]:
        """Merges the parts of a short string in place, lowest rank first, leftmost first; gives the rank and place of each merge."""
        rank = self.ranks.get
        pairs = [rank(a + b, NEVER) for a, b in pairwise(parts)]
        while pairs and (best := min(pairs)) < NEVER:
            k = pairs.index(best)
            yield best, k
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = rank(parts[k] + parts[k + 1], NEVER)
            if k:
                pairs[k - 1] = rank(parts[k - 1] + parts[k], NEVER)

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of a short string by its merges."""
        if data in self.ranks:  # a token's own merges always lead to it
            return [data]
        parts = _bytes(data)
        for _ in self._merges(parts):
            pass
        return parts

    def _fits(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether two tokens stay apart. Tokens of which all neighbours do are the encoding of their bytes: a first merge across a boundary would also be made in the two tokens alone."""
        return self.merged(pair[0] + pair[1]) == [*pair]

    def _taken(self, pair: tuple[bytes, int]) -> int:
        """The rank at which a token takes a byte that follows it, if all the merges before have lower ranks.

        A longer token that begins with this byte can't follow if it merges the byte at a higher rank only: the byte is gone by then.
        """
        parts, most = [*_bytes(pair[0]), pair[1].to_bytes()], -1
        for rank, k in self._merges(parts):
            if k == len(parts) - 2:
                return rank if rank > most else NEVER
            most = max(most, rank)
        return NEVER

    def _number(self, rest: bytes, live: tuple[int, ...], back: tuple[int, ...]) -> int:
        number = self.numbers.get(rest)
        if number is None:
            number = self.numbers[rest] = len(self.states) * STATE
            self.states.append((rest, live, back))
        return number

    def _step(self, key: int) -> int:
        rest, starts, back = self.states[key // STATE]
        grown, live, last, code, soonest = rest + (key % STATE).to_bytes(), [], None, self.code, self.soonest
        for cut in starts:
            token = grown[cut:]
            if cut:
                before = grown[back[cut] : cut]
                if last is None and token in code and self.fits[before, token]:
                    last = cut  # exactly one boundary has a token after it that fits
                if token in soonest and soonest[token] <= self.taken[before, token[0]]:
                    live.append(cut)
            else:
                if token in code:
                    last = cut
                if token in soonest:
                    live.append(cut)
        sure, back = len(grown), (*back, last)
        live.append(sure)
        for cut in live:  # back to where all live boundaries' encodings part
            while sure != cut:
                if sure > cut:
                    sure = back[sure]
                else:
                    cut = back[cut]
        if not sure:
            return self._number(grown, tuple(live), back)
        self.emitted[key] = self._codes(grown, back, sure)
        return EMITS + self._number(grown[sure:], tuple([k - sure for k in live]), (0, *[max(k - sure, 0) for k in back[sure + 1 :]]))

    def _codes(self, data: bytes, back: tuple[int, ...], end: int) -> bytes:
        """The ids of the tokens up to ``end``."""
        found = b""
        while end:
            found = self.code[data[back[end] : end]] + found
            end = back[end]
        return found

    def _end(self, state: int) -> bytes:
        rest, _, back = self.states[state // STATE]
        return self._codes(rest, back, len(rest))

    def run(self, data: bytes) -> bytes:
        if data in self.code:
            return self.code[data]
        out, state, steps, emitted = [], 0, self.steps, self.emitted
        for at in range(0, len(data), TRIMMED):
            if at:
                here = self.states[state // STATE]
                self.trim()
                state = self._number(*here)
            for byte in data[at : at + TRIMMED]:
                key = state + byte
                state = steps[key]
                if state & EMITS:
                    out.append(emitted[key])
                    state -= EMITS
        out.append(self.ends[state])
        return b"".join(out)

    def trim(self) -> None:
        self.fits.trim(STEPS_HELD)
        self.taken.trim(STEPS_HELD)
        if len(self.steps) > 2 * STEPS_HELD:
            for held in (self.steps, self.ends, self.emitted, self.numbers, self.states):
                held.clear()
            self._number(b"", (0,), (0,))


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.pieces = _Generations(lambda piece: self.transducer.run(piece.encode("utf-8", "surrogatepass")))

    def _encoded(self, matches: list[str]) -> bytes:
        self.pieces.trim(PIECES_HELD)
        self.transducer.trim()
        return b"".join(map(self.pieces.__getitem__, matches))

    def encode(self, text: str) -> bytes:
        if len(text) <= LISTED:
            return self._encoded(self.pattern.findall(text))
        matches = (m[0] for m in self.pattern.finditer(text))
        return b"".join(iter(lambda: self._encoded(list(islice(matches, MATCHES))), b""))


class Utf8Machine:
    """Incremental UTF-8: its state is the character that has begun."""

    def __init__(self):
        self.begun = b""

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                needs = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                if back < needs:
                    cut = len(data) - back
                break
            if lead < 0x80:
                break
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.begun = self.begun, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {r: t for t, r in ranks.items()}

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes certain, chunk by chunk."""
        machine, ids = Utf8Machine(), iter(ids)
        while part := list(islice(ids, CHUNK)):
            yield machine.feed(b"".join(map(self.bytes_of.__getitem__, part)))
        yield machine.end()

    def decode(self, ids: bytes) -> str:
        return "".join(self.stream(memoryview(ids).cast("I")))


_held: dict = {}


def _once(kind, data: bytes, *more):
    """One encoder or decoder for a Python worker and vocabulary."""
    key = (kind, hash(data), *more)
    if key not in _held:
        _held[key] = kind(parse_ranks(data), *more)
    return _held[key]


def _vocabulary(df: DataFrame, path: str):
    """The file's bytes, sent once to each executor; a vocabulary has a fixed size of about a MB."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: a binary of little-endian unsigned 32-bit integers."""
    vocabulary = _vocabulary(docs, path)
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType())])
    names = docs.columns

    def make():
        encoder = _once(Encoder, vocabulary.value, pattern)

        def work(rows):
            for row in zip(*(rows[c] for c in names), strict=True):
                yield (*row, encoder.encode(row[names.index(text)] or ""))

        return work

    return flat_map(docs, schema, make)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids (null: the empty text)."""
    vocabulary = _vocabulary(encoded, path)
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    names = encoded.columns

    def make():
        decoder = _once(Decoder, vocabulary.value)

        def work(rows):
            for row in zip(*(rows[c] for c in names), strict=True):
                yield (*row, decoder.decode(row[names.index(ids)] or b""))

        return work

    return flat_map(encoded, schema, make)

"""Words as runs of bytes: UTF-8 texts cut at ASCII characters, in pieces of bounded size."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a text whose words are held at once.
PIECE = 1 << 20


def table_of(letters: str) -> bytes:
    """A translation of bytes: A-Z to a-z, what isn't a word's (ASCII characters other than ``letters``, once lower-cased) to blanks, other bytes to themselves."""
    kept = set(letters.encode())
    return bytes(b if b >= 0x80 or b in kept else 0x20 for b in (c + 32 if 65 <= c <= 90 else c for c in range(256)))


#: Letters; letters and digits. Characters outside ASCII belong to words in both.
LETTERS = table_of(string.ascii_lowercase)
ALPHANUMERIC = table_of(string.ascii_lowercase + string.digits)


def words(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, a list for each piece; a word is never cut."""
    if len(text) <= PIECE:
        yield text.translate(table).split()
        return
    begin, rest = 0, b""
    while begin < len(text):
        part = rest + text[begin : begin + PIECE].translate(table)
        begin += PIECE
        cut = part.rfind(b" ") + 1 if begin < len(text) else len(part)
        rest = part[cut:]
        yield part[:cut].split()


def utf8(column: pa.Array) -> list[bytes | None]:
    """Strings as bytes, without decoding them."""
    return pc.cast(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()

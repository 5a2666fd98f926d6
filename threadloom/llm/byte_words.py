"""Words of UTF-8 texts by a 256-byte table: bytes of words stay, all others become blanks, and ``bytes.split``
does the rest. Every byte of a non-ASCII letter is 0x80 or more, so such letters are never cut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

# Bytes of a text that are split at once: a text of any length takes bounded memory.
PIECE = 1 << 20


def word_table(kept: bytes) -> bytes:
    """Lower-cases A-Z, keeps the ASCII bytes of ``kept`` and all above, and blanks the rest."""
    upper = bytes(range(ord("A"), ord("Z") + 1))
    stay = set(kept) | set(range(0x80, 0x100))
    return bytes(b | 0x20 if b in upper else b if b in stay else 0x20 for b in range(256))


LETTERS = bytes(range(ord("a"), ord("z") + 1))
DIGITS = bytes(range(ord("0"), ord("9") + 1))


def pieces(text: bytes, table: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, piece by piece; no word is cut."""
    low = 0
    while low < len(text):
        high = low + size
        if high < len(text):
            # On to the next byte that is no word's; a word longer than a piece stays whole.
            while high < len(text) and table[text[high]] != 0x20:
                high += 1
        if words := text[low:high].translate(table).split():
            yield words
        low = high


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()

"""Translate-table tokenizer: one ``bytes.translate`` lowers A-Z and blanks every separator, ``bytes.split`` cuts.

Works on UTF-8. Bytes above 127 belong to words, so no character is torn apart. ``split`` cuts at ASCII white
space only, and all of that is blanked before.
"""

from __future__ import annotations

import string
from collections.abc import Iterator


def table(kept: str) -> bytes:
    """Table for ``bytes.translate``: of ASCII, only ``kept`` (lower case) survives; A-Z are lowered first."""
    out = bytearray(range(256))
    for byte in range(128):
        char = chr(byte).lower()
        out[byte] = ord(char if char in kept else " ")
    return bytes(out)


LETTERS = table(string.ascii_lowercase)
ALPHANUMERIC = table(string.ascii_lowercase + string.digits)


def words(text: bytes, separators: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a whole text in lists of about ``piece`` bytes each, so that a very long text never becomes one list."""
    clean = text.translate(separators)
    at = 0
    while at < len(clean):
        blank = clean.find(b" ", at + piece)
        to = len(clean) if blank < 0 else blank
        yield clean[at:to].split()
        at = to

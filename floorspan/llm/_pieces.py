"""Words of byte buffers as Python bytes, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20


def to_spaces(is_word: Callable[[int], bool]) -> bytes:
    """A table for ``bytes.translate`` that lowers A-Z and turns all bytes but those of words into spaces."""
    lower = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]
    return bytes(b if is_word(b) else 0x20 for b in lower)


def pieces(raw: bytes, table: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The translated buffer in pieces of about ``size`` bytes that are cut at spaces; a longer word stays whole."""
    raw = raw.translate(table)
    lo, n = 0, len(raw)
    while lo < n:
        hi = n
        if n - lo > size:
            hi = raw.rfind(b" ", lo, lo + size) + 1
            if hi <= lo:
                hi = raw.find(b" ", lo + size) + 1 or n
        yield raw[lo:hi] if lo or hi < n else raw
        lo = hi

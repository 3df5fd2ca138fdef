"""Words of byte buffers as 64-bit hashes, without a Python step for each word."""

from __future__ import annotations

import functools

import numpy as np

CHUNK = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Bytes of words between ASCII white space, and of words of digits, a-z and all beyond ASCII.
NOT_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
#: Odd multipliers for the places in a window.
PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def words(buf: bytes, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a buffer, in order."""
    a = np.frombuffer(buf, dtype=np.uint8)
    n = len(a)
    starts, ends, hashes = [], [], []
    lo = 0
    while lo < n:
        hi = min(lo + CHUNK, n)
        if hi < n:
            back = np.flatnonzero(~table[a[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:  # one word longer than a chunk
                while hi < n and table[a[hi]]:
                    hi += 1
        part = a[lo:hi]
        inside = table[part]
        edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(max(CHUNK, 1 << int(hi - lo).bit_length()))
        run = np.empty(len(part) + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum(_BYTES[part] * power[: len(part)], out=run[1:])
        h = (run[e] - run[s]) * inverse[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * _BASE))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    if not starts:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.empty(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 words begin none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out += hashes[j : j + m] * PLACES[j % 64]
    return mix(out)


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """One buffer of texts ended by line feeds, and where each begins; one more entry at the end."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return b"\n".join(texts) + b"\n", offsets

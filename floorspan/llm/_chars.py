"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP_CHARS = 1 << 18
SPACE = 0x20


def groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about GROUP_CHARS characters, lower-cased, with one space between words and around them."""
    own: list[str] = []
    at = held = 0
    for i, text in enumerate(texts):
        own.append(f" {' '.join(text.lower().split())} " if text else " ")
        held += len(own[-1])
        if held >= GROUP_CHARS or i == len(texts) - 1:
            yield at, own
            at, held, own = i + 1, 0, []


def codes(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the joined texts, and where each text begins; one more entry at the end."""
    offsets = np.zeros(len(own) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in own], out=offsets[1:])
    return np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), offsets


def grams(c: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n characters from each place on) for each n; the last n - 1 places begin none."""
    h = c * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(c) < n:
                return
            h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in sizes:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield n, (x >> np.uint32(32 - bits)).astype(np.int32)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values from each offset to the next."""
    run = np.zeros(len(values) + 1)
    np.cumsum(values, dtype=np.float64, out=run[1:])
    at = np.minimum(offsets, len(values))
    return run[at[1:]] - run[at[:-1]]

"""Words of many texts at once: 64-bit hashes computed over one UTF-8 buffer with array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of plain words: ASCII letters and digits and all bytes of other characters.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BUFFER = 1 << 18

_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, BUFFER + (1 << 16))
        out = np.ones(size, np.uint64)
        with np.errstate(over="ignore"):
            out[1:] = np.uint64(base)
            np.multiply.accumulate(out, out=out)
        _powers[base] = out
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] the hash of the first i bytes; that of bytes a to b is (P[b] - P[a]) * INVERSE ** a."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def chunks(texts: list[str], limit: int = BUFFER) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of whole texts of about `limit` bytes: first, last + 1, their bytes. A longer text is a run of its own."""
    i = 0
    while i < len(texts):
        raw, size, j = [], 0, i
        while j < len(texts) and (j == i or size + len(texts[j]) < limit):
            raw.append(texts[j].encode("utf-8", "surrogatepass"))
            size += len(raw[-1]) + 1
            j += 1
        yield i, j, raw
        i = j


def words(raw: list[bytes], is_word: np.ndarray, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each run of `is_word` bytes, in order, and the number of words before each text and after the last.

    Texts are joined by a line feed, which must not be a word byte.
    """
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = is_word[data]
    turns = np.flatnonzero(np.diff(inside, prepend=0))
    start, end = turns[0::2], turns[1::2]
    p = prefix_hash(fold[data])
    h = mix((p[end] - p[start]) * powers(INVERSE, len(data) + 1)[start])
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    return h, start, end, np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))

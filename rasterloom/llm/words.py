"""Words of many texts as flat numpy arrays with 64-bit content hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .common import mix64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(1 << 16, dtype=np.uint64)
_POWERS[1:] = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(_POWERS)
#: Bytes of letters and digits of lower-cased texts: 0-9, a-z and all of non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of texts joined before one round of array work.
CHUNK = 1 << 19


@dataclass
class Words:
    lowered: np.ndarray  # bytes of the joined texts
    starts: np.ndarray  # of each word, in ``lowered``
    ends: np.ndarray
    hashes: np.ndarray  # uint64 of each word
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def texts(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def joined(self, first: int, n: int) -> bytes:
        """``n`` words from ``first`` on, space-joined."""
        return b" ".join(self.lowered[self.starts[i] : self.ends[i]].tobytes() for i in range(first, first + n))


def split_words(texts: list[bytes], is_word: np.ndarray = ALNUM) -> Words:
    """All words of ``texts``, ASCII-lower-cased. ``is_word`` marks the bytes of words; a line feed is none."""
    joined = b"\n".join(texts) + b"\n"
    lowered = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    inside = is_word[lowered]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    length = ends - starts
    if len(starts):
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        terms = (lowered[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[at & 0xFFFF]
        hashes = mix64(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64))
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    text_ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)]).astype(np.int64)
    return Words(lowered, starts, ends, hashes, bounds)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; runs across text ends, callers drop those."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + m]
    return mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes, with the index of the first."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= limit:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]

"""Hashes of the words and word shingles of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that one pass takes; a longer text is a pass of its own.
PASS_BYTES = 1 << 20
_rng = np.random.default_rng(20240501)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[np.uint64, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        _powers[base] = have = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n, PASS_BYTES + 4096), base))))
    return have[:n]


def passes(texts: list[str]) -> Iterator[tuple[int, int]]:
    """From and to of runs of texts of about PASS_BYTES."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) < PASS_BYTES:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words, one text after another, and where each text begins, with the end.

    Words are runs of other than the six ASCII white space characters; lower: A-Z count as a-z.
    """
    return measured_words(texts, lower)[:2]


def measured_words(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes, and each word's length in bytes."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    coded = [c.lower() for c in coded] if lower else coded
    raw = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[raw] * _power(_STEP, len(raw)))))
    words = mix((sums[ends] - sums[starts]) * _power(_BACK, len(raw))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(c) + 1 for c in coded])))
    return words, np.searchsorted(starts, bounds + 1), ends - starts


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` words in a row; of fewer words, the one of the whole sequence; of none, none."""
    n = min(size, len(words))
    if not n:
        return words
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _ODD[k]
    return mix(out + np.uint64(n))

"""Hashes of words, for all words of a slice of texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_VALUES = np.random.default_rng(20240229)
BYTE_VALUES = _VALUES.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_VALUES[np.arange(ord("A"), ord("Z") + 1)] = BYTE_VALUES[np.arange(ord("a"), ord("z") + 1)]
POWER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, POWER, np.uint64), np.full(size, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def forget() -> None:
    """Drop the powers kept for the next slice; those for long texts are large."""
    _powers.cache_clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end, between ASCII white space."""
    edge = np.diff(np.concatenate(([False], ~WHITE[data], [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of some bytes; A-Z count as a-z.

    The hash is a polynomial in the values of the bytes, taken as the difference of two
    prefix sums, so no span is looked at by itself.
    """
    up, down = _powers(1 << max(10, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

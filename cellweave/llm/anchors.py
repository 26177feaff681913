"""Anchors of texts: places that content alone chooses, so that equal stretches share them.

Every window of ``size`` bytes has one anchor: its gram of ``gram`` bytes of
smallest hash, the leftmost of equals. Equal windows have equal anchors at
equal places, wherever they stand, so only windows of equal anchor grams have
to be compared.
"""

from __future__ import annotations

import numpy as np

from .hashed import mix

GRAM = 64


def _grams(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of codes[i:i+gram] for every i; gram is a power of two."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    base, span = 0xC6BC279692B5C323, 1
    while span < gram:
        h = h[:-span] * np.uint64(base) + h[span:]
        base = base * base % (1 << 64)
        span *= 2
    return mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` hashes the place of its smallest, the leftmost of equals.

    The low bits of the hashes give way to their places, so that one sliding
    minimum finds both; where that has hidden a smaller hash, the window is
    looked through again. What is found thus depends on the window alone.
    """
    bits = np.uint64(int(len(h)).bit_length())
    at = (_sliding_min((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    for i in np.flatnonzero(h[at] != _sliding_min(h, width)):
        at[i] = i + np.argmin(h[i : i + width])
    return at


def anchors(texts: list[bytes], size: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window start, last window start, place and hash of the anchor) of every stretch of windows with one anchor.

    Places count bytes from the start of the text. Texts shorter than a
    window have none.
    """
    none = (*(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint64))
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(joined) < size:
        return none
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    h = _grams(joined, gram)
    at = _smallest(h, size - gram + 1)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + size <= ends[of])
    if not len(inside):
        return none
    at, of = at[inside], of[inside]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (of[1:] != of[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    t = of[new]
    return t, inside[new] - starts[t], inside[last] - starts[t], at[new] - starts[t], h[at[new]]

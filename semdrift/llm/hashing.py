"""Vectorised hashing of words and shingles in whole UTF-8 texts."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
# Texts are hashed in pieces of this many bytes, so scratch arrays stay small.
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _P, np.uint64)
    up[0] = 1
    inverse = pow(int(_P), -1, 2**64)
    down = np.full(n + 1, np.uint64(inverse), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(PIECE)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * _UP[: len(raw)], out=total[1:])
    words = (total[ends] - total[starts]) * _DOWN[starts]
    return mix(words ^ (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words ``[^ \\t-\\r]+``, A-Z lower-cased, in order. A word over ``PIECE`` bytes is
    hashed by its pieces."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= PIECE:
        return _piece_hashes(raw)[0]
    parts, at = [], 0
    carry: np.uint64 | None = None
    while at < len(raw):
        stop = min(len(raw), at + PIECE)
        if stop < len(raw) and not _SPACE[raw[stop]]:
            gaps = np.flatnonzero(_SPACE[raw[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
        hashes, starts, ends = _piece_hashes(raw[at:stop])
        if carry is not None and len(hashes) and starts[0] == 0:
            hashes[0] = mix(np.array([carry * np.uint64(3) + hashes[0]]))[0]
            carry = None
        elif carry is not None:
            parts.append(np.array([carry], np.uint64))
            carry = None
        if stop < len(raw) and len(hashes) and ends[-1] == stop - at and not _SPACE[raw[stop]]:
            carry, hashes = hashes[-1], hashes[:-1]
        parts.append(hashes)
        at = stop
    return np.concatenate(parts)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted; the whole sequence if it has fewer words; empty without words."""
    if not text:
        return np.empty(0, np.uint64)
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(width, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _MULT[i]
    return np.unique(mix(total + np.uint64(k)))

"""Words of UTF-8 texts as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes that are handled at once; a piece ends at a space, unless one word is longer.
PIECE = 1 << 19
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, PIECE) - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _of_piece(data: np.ndarray) -> np.ndarray:
    word = ~_IS_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    return spans_hashed(data, edges[::2], edges[1::2])


def spans_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash (uint64) for the bytes of each span; it depends on the bytes alone."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash (uint64) for each word, in order; words are runs without the six ASCII space characters."""
    if len(data) <= PIECE:
        return _of_piece(np.frombuffer(data, np.uint8))
    out, at = [], 0
    whole = np.frombuffer(data, np.uint8)
    while at < len(data):
        stop = min(at + PIECE, len(data))
        if stop < len(data):
            near = np.flatnonzero(_IS_SPACE[whole[at:stop]])
            if len(near):
                stop = at + int(near[-1]) + 1
            else:
                later = next((k for k in range(stop, len(data)) if data[k] in SPACES), len(data))
                stop = min(later + 1, len(data))
        out.append(_of_piece(whole[at:stop]))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)

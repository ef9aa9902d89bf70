"""Sets of word shingles as sorted arrays of 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Lower-cases A-Z; white space of the word definition.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_STEPS = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) | 1 for i in range(SHINGLE)], dtype=_U)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, step in enumerate((_BASE, _INVERSE)):
            t = np.full(n, step, dtype=_U)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its SHINGLE-word shingles; a text of fewer
    words has one, of its whole sequence; one without words has none."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]).translate(LOWER) or b" ", dtype=np.uint8)
    edge = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, int)
    word = ~BLANK[data]
    step = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = _power_tables(len(data))
    total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * power, dtype=_U)])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U) * _U(0xA24BAED4963EE407))
    doc = np.searchsorted(edge, start, side="right")
    n = np.bincount(doc, minlength=len(raw))
    first = np.cumsum(n) - n
    out = []
    long_ = np.zeros(0, _U)
    if len(h) >= SHINGLE:
        long_ = h[: len(h) - SHINGLE + 1] * _STEPS[0]
        for i in range(1, SHINGLE):
            long_ = long_ + h[i : len(h) - SHINGLE + 1 + i] * _STEPS[i]
        long_ = mix(long_ + _U(SHINGLE))
    for at, k in zip(first.tolist(), n.tolist(), strict=True):
        if k >= SHINGLE:
            s = np.sort(long_[at : at + k - SHINGLE + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif k:
            out.append(mix((h[at : at + k] * _STEPS[:k]).sum(dtype=_U, keepdims=True) + _U(k)))
        else:
            out.append(np.zeros(0, _U))
    return out

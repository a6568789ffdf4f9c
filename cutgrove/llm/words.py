"""Vectorised word hashing: 64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased.

A word's hash is a polynomial over random 64-bit values of its bytes, taken from one running sum over the piece, then
mixed. Pieces are cut at white space, so that memory stays bounded for texts of any length. Words over LONG bytes
are hashed on their own with BLAKE2b, because long polynomials modulo 2**64 are weak.
"""

from __future__ import annotations

import hashlib

import numpy as np

PIECE = 1 << 20
LONG = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


_cache: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n - 1).bit_length())
    if size > PIECE:
        return _powers(_R, n), _powers(_INVERSE, n)
    if "p" not in _cache:
        _cache["p"] = _powers(_R, PIECE), _powers(_INVERSE, PIECE)
    return _cache["p"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of raw (already lower-cased) and where each begins."""
    b = np.frombuffer(raw, np.uint8)
    word = b != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    if word[-1]:
        edge = np.concatenate((edge, [len(b)]))
    start, stop = edge[::2], edge[1::2]
    up, down = powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * up[: len(b)], out=total[1:])
    h = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    for i in np.flatnonzero(stop - start > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : stop[i]], digest_size=8).digest(), "little")
    return h, start


def hash_texts(texts: list[str]) -> list[np.ndarray]:
    """One array of word hashes for each text, in order; short texts share one pass."""
    out: list = [np.empty(0, np.uint64)] * len(texts)
    group, size = [], 0

    def flush():
        nonlocal group, size
        if group:
            h, start = _piece(b" ".join(raw for _, raw in group) + b" ")
            ends = np.cumsum([len(raw) + 1 for _, raw in group])
            cuts = np.searchsorted(start, ends[:-1])
            for (i, _), part in zip(group, np.split(h, cuts)):
                out[i] = part
        group, size = [], 0

    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "replace").translate(_LOWER)
        if not raw:
            continue
        if len(raw) >= PIECE // 2:
            parts, at = [], 0
            while at < len(raw):
                end = len(raw) if len(raw) - at <= PIECE // 2 else raw.find(b" ", at + PIECE // 2)
                end = len(raw) if end < 0 else end
                parts.append(_piece(raw[at:end] + b" ")[0])
                at = end
            out[i] = np.concatenate(parts)
            continue
        if size + len(raw) + 2 > PIECE:
            flush()
        group.append((i, raw))
        size += len(raw) + 1
    flush()
    return out


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; of the whole sequence where it is shorter; none without words."""
    if not len(words):
        return words
    w = min(n, len(words))
    h = np.full(len(words) - w + 1, w, np.uint64)
    for j in range(w):
        h = h * _C + words[j : len(words) - w + 1 + j]
    return np.unique(mix(h))

"""Vectorised word hashing shared by the Arrow-based operators.

A batch of texts becomes one byte buffer; words, their 64-bit hashes and word
shingles are then computed with numpy over the whole buffer, never per word in
Python.  All hashes are seeded constants, so every executor agrees.
"""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_POLY = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_POLY_INV = pow(_POLY, -1, 1 << 64)
_BYTES = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.uint64)
#: Bytes of text that one call hashes at once; longer batches are cut between documents.
BUFFER_BYTES = 1 << 20

#: ASCII blanks: space and tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte that is neither a letter nor a digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64, kept for the next batch."""
    key = f"{base:x}"
    if key not in _powers or len(_powers[key]) < n:
        grown = np.full(max(n, BUFFER_BYTES + 1), base, np.uint64)
        grown[0] = 1
        _powers[key] = np.multiply.accumulate(grown)
    return _powers[key][:n]


def word_hashes(texts: list[bytes], separators: np.ndarray = BLANKS, fold: bool = True):
    """Hashes of the words of each text, and the number of words of each.

    Words are maximal runs of bytes outside ``separators``; ``fold`` lower-cases A-Z.
    Returns (hashes of all words in order, words per text).
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if fold:
        buf = _FOLD[buf]
    gap = separators[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[buf] * _power(_POLY, len(buf)), out=sums[1:])
    h = mix((sums[stops] - sums[starts]) * _power(_POLY_INV, len(buf))[starts] + (stops - starts).astype(np.uint64))
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; the whole sequence as one if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    acc = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        acc = acc * _MULT + words[i : n - k + 1 + i]
    return mix(acc + np.uint64(k))


def batches(texts: list[str | None], limit: int = BUFFER_BYTES):
    """(first index, encoded texts) in runs of at most ``limit`` bytes, or of one text if it is longer."""
    run: list[bytes] = []
    first = used = 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if run and used + len(b) > limit:
            yield first, run
            run, first, used = [], i, 0
        run.append(b)
        used += len(b) + 1
    if run:
        yield first, run


def shingle_sets(texts: list[str | None], size: int, separators: np.ndarray = BLANKS):
    """Yields, text by text, the sorted distinct shingle hashes (uint64)."""
    for _, run in batches(texts):
        h, n = word_hashes(run, separators)
        at = 0
        for k in n:
            yield np.unique(shingle_hashes(h[at : at + k], size))
            at += k

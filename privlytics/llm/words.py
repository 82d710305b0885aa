"""Words and word shingles of texts as 64-bit hashes, in numpy over UTF-8 bytes.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's hash is a polynomial over random numbers of its bytes,
mixed; hashes of different words are taken to differ (64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        _POWERS["value"] = mix(lower.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        blank = np.zeros(256, bool)
        blank[9:14] = blank[32] = True
        _POWERS["blank"] = blank
    return _POWERS["up"], _POWERS["down"], _POWERS["value"], _POWERS["blank"]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in bytes."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down, value, blank = _tables(len(data))
    gap = np.concatenate([[True], blank[data], [True]])
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turn[::2], turn[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def rows_of_words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows (a, b): (a, b, word hashes, first word of each row and the end, bytes, (start, end) pairs).

    A run has about ``PIECE`` bytes; a longer text is a run of its own.
    """
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1))
        # a blank before each text keeps the words of two texts apart
        starts = offsets[at:upto] - offsets[at] + np.arange(upto - at)
        text = np.full(offsets[upto] - offsets[at] + upto - at, 32, np.uint8)
        where = np.ones(len(text), bool)
        where[starts] = False
        text[where] = data[offsets[at] : offsets[upto]]
        hashes, first, last = word_hashes(text)
        bounds = np.append(np.searchsorted(first, starts), len(first))
        yield at, upto, hashes, bounds, text, np.stack([first, last])
        at = upto


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; of the whole sequence where it has fewer words."""
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(size)]
    for a, b, words, bounds, _, _ in rows_of_words(data, offsets):
        n = len(words) - size + 1
        whole = np.zeros(max(n, 0), np.uint64)
        for i, f in enumerate(factors):
            if n > 0:
                whole += words[i : i + n] * f
        whole = mix(whole)
        for r in range(b - a):
            lo, hi = bounds[r], bounds[r + 1]
            if hi - lo >= size:
                found = np.sort(whole[lo : hi - size + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif hi > lo:
                whole_row = (words[lo:hi] * np.array(factors[: hi - lo])).sum(keepdims=True) + np.uint64(hi - lo)
                yield mix(whole_row ^ np.uint64(0x5851F42D4C957F2D))
            else:
                yield np.zeros(0, np.uint64)

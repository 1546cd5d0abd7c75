"""64-bit hashes of the words of a text, a whole text at a time.

A word is a run of bytes other than blank and the controls 9 to 13; A to Z are
lower-cased.  A word's hash is a polynomial over its bytes modulo 2^64, read from
running sums, then mixed.
"""

from __future__ import annotations

import hashlib

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)],
                  np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULT)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSE = [_powers(1 << 12)], pow(int(_MULT), -1, 1 << 64)
_INVERSES = [np.empty(0, np.uint64)]


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, grown as texts need them."""
    if len(_INVERSES[0]) < n:
        size = max(n, 2 * len(_INVERSES[0]), 1 << 12)
        inverse = np.full(size, np.uint64(_INVERSE))
        inverse[:1] = 1
        _POWERS[0], _INVERSES[0] = _powers(size), np.multiply.accumulate(inverse)
    return _POWERS[0], _INVERSES[0]


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn, and the position after each text's last word."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(raws).lower(), np.uint8)               # bytes.lower is A-Z only
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    begin, end = edge[::2], edge[1::2]
    ends = np.searchsorted(begin, np.cumsum([len(r) + 1 for r in raws]))
    if not len(begin):
        return np.empty(0, np.uint64), ends
    up, down = _scales(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[:len(raw)], dtype=np.uint64)))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)), ends


def word_hashes(text: str | None) -> np.ndarray:
    return words_of([text])[0]


def some_at_a_time(texts: list[str | None], size: int = 1 << 18):
    """Slices of ``texts`` of about ``size`` characters, or of one longer text."""
    at = 0
    while at < len(texts):
        begin, n = at, 0
        while at < len(texts) and (n < size or at == begin):
            n += len(texts[at] or "") + 1
            at += 1
        yield texts[begin:at]


def chain(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the sequence ``before`` followed by ``word``."""
    return mix(before * _MULT + word)

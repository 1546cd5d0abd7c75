"""Word hashes under a stated set of delimiter bytes, over whole texts in bounded slices.

All delimiters are ASCII, so UTF-8 bytes decide; A to Z are lower-cased.  A long
text is cut behind a delimiter only, so that no word is split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from papyra.llm.words import _BYTES, _scales, mix

SLICE = 1 << 18


class Delimiters:
    """``gaps`` end a word; ``breaks`` end a word and the piece that it stands in."""

    def __init__(self, gaps: bytes, breaks: bytes = b""):
        self.kind = np.zeros(256, np.uint8)
        self.kind[list(gaps)] = 1
        self.kind[list(breaks)] = 2
        self.any = re.compile(b"[" + re.escape(gaps + breaks) + b"]")


ALPHANUMERIC = Delimiters(bytes(b for b in range(128) if not chr(b).isalnum()))   # as lower-cased


def slices(texts: list[str | None], cut: Delimiters, size: int = SLICE) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (index of the text, lower-cased bytes) of about ``size`` bytes; a longer text continues in the next list."""
    held, n = [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if held and n + len(raw) > size:
            yield held
            held, n = [], 0
        at = 0
        while len(raw) - at > size:
            found = cut.any.search(raw, at + size)
            end = found.end() if found else len(raw)
            yield [(i, raw[at:end])]
            at = end
        held.append((i, raw[at:]))
        n += len(raw) - at + 1
    if held:
        yield held


def words_in(parts: list[bytes], cut: Delimiters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the parts in turn: (hash, first byte, byte behind, words before each part's end, joined bytes)."""
    raw = np.frombuffer(b"\n".join(parts), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = cut.kind[raw] == 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    ends = np.searchsorted(begin, np.cumsum([len(p) + 1 for p in parts]))
    up, down = _scales(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[:len(raw)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin, end, ends, raw


def words_by_text(texts: list[str | None], cut: Delimiters) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(index of the text, hashes of its next words, whether these are its last)."""
    before = None
    for held in slices(texts, cut):
        hashes, _, _, ends, _ = words_in([p for _, p in held], cut)
        for (i, _), own in zip(held, np.split(hashes, ends[:-1]), strict=True):
            if before is not None:
                yield (*before, before[0] != i)
            before = i, own
    if before is not None:
        yield (*before, True)

"""Overlap chunking of documents (D13) as an Arrow UDF + ``posexplode``.

The splitter is the public recursive character algorithm: try separators in
order ("\\n\\n", "\\n", " ", ""), keep each separator at the start of the
following piece, recurse into pieces that are still too long, then merge
pieces greedily into chunks of at most ``size`` characters with up to
``overlap`` characters carried over.  Lengths are code points (Python
``len``).  Each document is split independently inside the task that holds
it; Spark distributes documents, Arrow carries them in batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra import lexicons as L


_OTHER_SPACE = re.compile(r"[^\S ]")      # any whitespace character except the plain space


def _split_keep_start(text: str, sep: str) -> list[str]:
    if not sep:
        return list(text)
    parts = re.split(f"({re.escape(sep)})", text)
    out = [parts[0]] + [parts[i] + parts[i + 1] for i in range(1, len(parts) - 1, 2)]
    return [p for p in out if p]


def _join(pieces: list[str], sep: str) -> str | None:
    s = sep.join(pieces).strip()
    return s or None


def _merge(pieces: list[str], sep: str, size: int, overlap: int) -> list[str]:
    sep_len = len(sep)
    chunks: list[str] = []
    window: list[str] = []
    total = 0
    for p in pieces:
        n = len(p)
        if total + n + (sep_len if window else 0) > size:
            if window:
                doc = _join(window, sep)
                if doc is not None:
                    chunks.append(doc)
                drop = 0
                while total > overlap or (total + n + (sep_len if len(window) > drop else 0) > size
                                          and total > 0):
                    total -= len(window[drop]) + (sep_len if len(window) - drop > 1 else 0)
                    drop += 1
                window = window[drop:]
        window.append(p)
        total += n + (sep_len if len(window) > 1 else 0)
    doc = _join(window, sep)
    if doc is not None:
        chunks.append(doc)
    return chunks


def _single_space_windows(words: list[str], size: int, overlap: int) -> list[str]:
    """Closed form of the merge for text split on single spaces, all words shorter than ``size``.

    cum[i] = length of words[:i] joined with their leading spaces; a window
    [s, e) holds while cum[e] - cum[s] <= size; the next window starts at the
    first word after which at most ``overlap`` characters remain and the next
    word still fits.  O(words) per text.
    """
    import bisect

    cum = [0]
    for i, w in enumerate(words):
        cum.append(cum[-1] + len(w) + (1 if i > 0 else 0))
    n = len(words)
    out: list[str] = []
    s = 0
    while True:
        e = bisect.bisect_right(cum, cum[s] + size, lo=s) - 1
        out.append(" ".join(words[s:e]))
        if e == n:
            return out
        thr = max(cum[e] - overlap, cum[e + 1] - size)
        s = bisect.bisect_left(cum, thr, lo=s)


def split_text(text: str | None, size: int = L.CHUNK_SIZE, overlap: int = L.CHUNK_OVERLAP,
               separators: list[str] | None = None) -> list[str]:
    """Chunks of one text; empty or null text gives no chunks."""
    if not text:
        return []
    if overlap > size:
        raise ValueError("overlap larger than chunk size")
    seps = list(separators or L.CHUNK_SEPARATORS)
    if (seps == L.CHUNK_SEPARATORS and _OTHER_SPACE.search(text) is None and text == text.strip()
            and "  " not in text):
        words = text.split(" ")
        if max(map(len, words)) < size:
            return _single_space_windows(words, size, overlap)
    return _split(text, seps, size, overlap)


def _split(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    sep = separators[-1]
    rest: list[str] = []
    for i, s in enumerate(separators):
        if s == "":
            sep = s
            break
        if s in text:
            sep = s
            rest = separators[i + 1:]
            break
    out: list[str] = []
    good: list[str] = []
    for piece in _split_keep_start(text, sep):
        if len(piece) < size:
            good.append(piece)
            continue
        if good:
            out.extend(_merge(good, "", size, overlap))
            good = []
        if rest:
            out.extend(_split(piece, rest, size, overlap))
        else:
            out.append(piece)
    if good:
        out.extend(_merge(good, "", size, overlap))
    return out


def chunk_column(col, size: int = L.CHUNK_SIZE, overlap: int = L.CHUNK_OVERLAP) -> Column:
    """``array<string>`` of chunks, computed over Arrow batches."""
    @F.pandas_udf("array<string>")
    def _chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap))

    return _chunks(F.col(col) if isinstance(col, str) else col)


def chunk_documents(df: DataFrame, text_col: str, key_cols: list[str],
                    size: int = L.CHUNK_SIZE, overlap: int = L.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: ``key_cols..., chunk_index, chunk_text`` (no rows for empty text)."""
    return df.select(*key_cols, F.posexplode(chunk_column(text_col, size, overlap))
                     .alias("chunk_index", "chunk_text"))

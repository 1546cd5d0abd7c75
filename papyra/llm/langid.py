"""Language identification by hyperdimensional profiles.

Every letter has a random +1/-1 vector.  A trigram's vector is the product of
its letters' vectors, each rotated by its place; a text's profile is the sum of
its trigrams' vectors, and a language's prototype the sum over its documents.  A
document goes to the language whose prototype has the largest cosine.

Sums commute with inner products, so no profile has to be held per document:
a prototype is built from the language's trigram counts, and the product of a
document with it is the sum, over the document's trigrams, of a precomputed
product (trigram vector, prototype).  The document's own length divides all
cosines alike, so the winner and the score do not need it.  Trigrams that no
training text holds are orthogonal to all prototypes up to noise and count 0.

Only trigram counts per language are shuffled; at most 2^21 of them exist per
language, which bounds what the driver gathers and broadcasts.

Edge cases: null text and texts without a letter are "und" with score 0, as is
everything if nothing can be learned; any other text gets a learned language, the
one with the largest sum even where no sum is positive (score 0), and the one with
the most trigrams where all sums are equal; long texts are read whole, in slices;
other ties go to the first language in sorted order; repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from papyra.llm.common import without

SYMBOLS = 128          # 0: not a letter; 1-26: a-z; 27-127: other letters
DIMENSIONS = 2048
UNKNOWN = "und"
_FLUSH = 1 << 21       # buffered trigrams before a worker emits counts
_CHUNK = 2048          # trigram vectors expanded at a time
_SLICE = 1 << 16       # trigrams of a text looked up at a time


def _symbol_of(code: int) -> int:
    c = chr(code)
    if not c.isalpha():
        return 0
    low = ord(c.lower()[0])
    if 97 <= low <= 122:
        return low - 96
    if 0xDF <= low <= 0xFF:
        return 27 + low - 0xDF                       # Latin-1 letters keep symbols of their own
    return 60 + low * 2654435761 % (1 << 32) % (SYMBOLS - 60)


_TABLE: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Symbol of every code point, built once per worker."""
    if not _TABLE:
        _TABLE.append(np.fromiter((_symbol_of(c) for c in range(0x110000)), np.uint8, 0x110000))
    return _TABLE[0]


def trigrams(text: str | None) -> np.ndarray:
    """Trigram numbers of a text; runs of other characters count as one blank."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate(([0], _symbols()[codes], [0])).astype(np.int32)
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    if len(s) < 3:
        return np.empty(0, np.int32)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def emit():
        for lang, parts in held.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n, pa.int64())],
                                             ["lang", "gram", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = trigrams(text)
            held.setdefault(lang, []).append(t)
            size += len(t)
            if size > _FLUSH:
                yield from emit()
                held, size = {}, 0
    yield from emit()


def _vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    a, b, c = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


class Profiles:
    """Languages and, per trigram number, its product with each unit prototype."""

    def __init__(self, langs: list[str], grams: np.ndarray, counts: np.ndarray, dims: int, seed: int):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dims))
        chunks = [slice(i, i + _CHUNK) for i in range(0, len(grams), _CHUNK)]
        prototypes = np.zeros((len(langs), dims))
        for c in chunks:
            prototypes += counts[:, c] @ _vectors(grams[c], letters).astype(np.float64)
        norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
        prototypes /= np.where(norms > 0, norms, 1)
        self.langs, self.grams = langs, grams
        self.commonest = int(counts.sum(axis=1).argmax()) if langs else 0
        self.products = np.concatenate([np.empty((0, len(langs)), np.float32)] + [
            (_vectors(grams[c], letters).astype(np.float32) @ prototypes.T.astype(np.float32)) for c in chunks])

    def table(self) -> np.ndarray:
        out = np.zeros((SYMBOLS**3, len(self.langs)), np.float32)
        out[self.grams] = self.products
        return out


def learn_profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", dims: int = DIMENSIONS,
                   seed: int = 9) -> Profiles:
    rows = labelled.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    found = (rows.mapInArrow(_counts, "lang string, gram int, n long").groupBy("lang", "gram")
             .agg(F.sum("n").alias("n")).toPandas())
    langs, grams = sorted(found["lang"].unique()), np.unique(found["gram"].to_numpy(np.int64))
    counts = np.zeros((len(langs), len(grams)))
    counts[np.searchsorted(langs, found["lang"]) if langs else [], np.searchsorted(grams, found["gram"])] = found["n"]
    return Profiles(langs, grams, counts, dims, seed)


def predict_languages(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` (but for old ones of these names) plus lang_pred and score.

    The score is the winner's share of the positive cosines.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = without(docs, "lang_pred", "score")
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for b in batches:
            names, scores = [], []
            for text in b.column(text_col).to_pylist():
                t = trigrams(text)
                if not len(t) or not model.langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                sums = sum(table[t[i:i + _SLICE]].sum(axis=0, dtype=np.float64) for i in range(0, len(t), _SLICE))
                total = np.maximum(sums, 0).sum()
                best = model.commonest if (sums == sums[0]).all() else int(sums.argmax())
                names.append(model.langs[best])
                scores.append(float(max(sums[best], 0) / total) if total > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores)],
                                             [*b.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)

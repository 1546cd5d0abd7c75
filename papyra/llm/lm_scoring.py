"""Language-model scoring from a log-frequency Bloom filter.

Words and pairs of neighbouring words of the training texts are counted
whole.  A count c is kept as the level 1 + floor(log_b c); the filter holds
(n-gram, 1) ... (n-gram, level), and a reader probes rising levels until one is
missing.  Reading errs only upwards, and seldom by more than a level.  The
probability of a word after another mixes the pair's share of its first word's
count with the word's own add-one probability:

    P(w | h) = m c(h w) / c(h) + (1 - m) (c(w) + 1) / (N + V + 1)

Counting moves sorted arrays of (hash, count) per task and hash range, merged per
range; ranges are as many as the text needs to keep each merge bounded.  The
filter is built per range, words and pairs apart, each range as large as its
entries need at ``BITS_PER_ENTRY``.  Up to ``max_bytes`` it is broadcast; a larger
one stays a table, and the n-grams of blocks of texts go to their ranges; their levels
alone come back, in the order sent.  A text's block is a hash of it and of its input
partition, so texts move once and copies spread.  Both ways read the same levels.  All
pairs are held, unless ``min_pair`` asks for more than one occurrence.  Sorted hashes
move as the gaps between them, compressed: about four bytes each.

The unigram base score needs exact counts of all words: those of the most frequent
words (``MAX_FREQUENT``, broadcast) are looked up in place, all others by a join.

Edge cases: null text is empty and has the end token alone; long texts are read
whole; repeated rows are counted and scored each; without training rows every
word is new (N = V = 0); an empty table gives no rows; columns of any name are handed
on, but for those named like a result.  Words are told apart by 64-bit hashes, pairs by
48 bits of theirs: far less often alike than the filter errs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyra.llm.words import chain, mix, some_at_a_time, words_of
from papyra.session import cut_lineage

BASE = 1.3                     # ratio of neighbouring levels
PROBES = 4
BITS_PER_ENTRY = 12
MAX_FREQUENT = 1 << 17         # words with counts in the broadcast table: 16 bytes each
RANGE_BYTES = 1 << 24          # text per hash range
END = np.uint64(1)
PAIR_MASK = np.uint64((1 << 64) - (1 << 16))   # the 48 bits kept of a pair's hash
_BLOCK = 1 << 21               # n-grams sorted together in a task
_SCORED = 1 << 23              # characters scored together in a task


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def expected(level: np.ndarray) -> np.ndarray:
    """Count that a level stands for: the middle of its range, 0 for level 0."""
    low = np.ceil(BASE ** (level - 1) - 1e-9)
    high = np.ceil(BASE ** level - 1e-9) - 1
    return np.where(level > 0, np.where(high > low, (low + high) / 2, low), 0.0)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts in turn, an end after each text, and how many each has."""
    runs, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for some in some_at_a_time(texts):
        words, ends = words_of(some)
        runs.append(np.insert(words, ends, END))
        sizes.append(np.diff(ends, prepend=0) + 1)
    return np.concatenate(runs), np.concatenate(sizes)


def pairs(t: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first of a text follows the end of the one before, or an end."""
    return chain(mix(np.concatenate(([END], t[:-1]))), t) & PAIR_MASK


def _shrunk(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), "zstd", asbytes=True)


def _regrown(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, n * size, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def _gaps(h: np.ndarray) -> bytes:
    return _shrunk(np.diff(h, prepend=np.uint64(0)))


def _hashes(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_regrown(blob, n, np.uint64), dtype=np.uint64)


def _by_range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Where the second and later hash ranges begin in sorted hashes."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    return np.searchsorted(h, np.arange(1, ranges, dtype=np.uint64) << shift) if ranges > 1 else np.empty(0, np.int64)


class Filter:
    """Bits in ranges, of equal size if not given; an n-gram's range is given by the top bits of its hash."""

    def __init__(self, bits: np.ndarray, ranges: int, sizes: np.ndarray | None = None):
        self.bits, self.shift = bits, np.uint64(64 - (ranges.bit_length() - 1))
        self.sizes = np.full(ranges, len(bits) * 8 // ranges, np.uint64) if sizes is None else sizes
        self.size = self.sizes[0]
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def joined(cls, segments: list[bytes]) -> Filter:
        return cls(np.frombuffer(b"".join(segments), np.uint8), len(segments),
                   np.array([8 * len(x) for x in segments], np.uint64))

    @classmethod
    def segment(cls, h: np.ndarray, n: np.ndarray) -> bytes:
        """The bits of one range: a count stands for as many entries as its level."""
        top = levels(n)
        bits = np.zeros((int(top.sum()) * BITS_PER_ENTRY // 64 + 1) * 64, bool)
        for level in range(1, int(top.max(initial=0)) + 1):
            for place in cls.places(h[top >= level], level, np.uint64(len(bits))):
                bits[place.astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    @staticmethod
    def places(h: np.ndarray, level: int, size):
        a = mix(h + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        b = mix(a) | np.uint64(1)
        for j in range(PROBES):
            yield (a + np.uint64(j) * b) % size

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Highest level held without a gap, by probing levels 1, 2, ... of the n-grams still found."""
        out = np.zeros(len(h), np.int64)
        part = np.zeros(len(h), np.int64) if self.shift == 64 else (h >> self.shift).astype(np.int64)
        start, size = self.starts[part], self.sizes[part]
        live, level = np.arange(len(h)), 1
        while len(live):
            hit = np.ones(len(live), bool)
            for place in self.places(h[live], level, size[live]):
                at = start[live] + place
                hit &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[hit]
            out[live] = level
            level += 1
        return out


def _blobs(ngrams, ranges: int):
    """Task: count n-grams in blocks and hand on, per hash range, their sorted hashes and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        raw: list[np.ndarray] = []
        size = 0

        def fold():
            if raw:
                held.append(np.unique(np.concatenate(raw), return_counts=True))
                raw.clear()

        def emit():
            fold()
            h, n = _merged(held)
            held.clear()
            cuts = _by_range(h, ranges)
            rows = [(i, len(x), _gaps(x), _shrunk(y.astype(np.uint32)))
                    for i, (x, y) in enumerate(zip(np.split(h, cuts), np.split(n, cuts), strict=True)) if len(x)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (
                    pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "size", "h", "n"])

        for b in batches:
            for some in some_at_a_time(b.column(0).to_pylist()):
                raw.append(ngrams(tokens(some)[0]))
                size += len(raw[-1])
                if size > _BLOCK:
                    fold()
                    size = 0
                    if sum(len(h) for h, _ in held) > 3 * _BLOCK:
                        yield emit()
        if raw or held:
            yield emit()

    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(n, first)


def _counted(texts: DataFrame, ngrams, ranges: int, least: int, exact: bool) -> DataFrame:
    """(part, bits): per hash range the filter of the n-grams with at least ``least`` occurrences; if ``exact``, h and n too."""
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        h, n = _merged([(_hashes(r["h"], r["size"]), _regrown(r["n"], r["size"], np.uint32)) for r in table.to_pylist()])
        h, n = h[n >= least], n[n >= least]
        cols = {"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([Filter.segment(h, n)], pa.binary())}
        if exact:
            cols |= {"h": pa.array([h.view(np.int64)], pa.list_(pa.int64())), "n": pa.array([n], pa.list_(pa.int64()))}
        return pa.table(cols)

    return (texts.mapInArrow(_blobs(ngrams, ranges), "part int, size int, h binary, n binary").groupBy("part")
            .applyInArrow(merge, "part int, bits binary" + (", h array<long>, n array<long>" if exact else "")))


def _same(t: np.ndarray) -> np.ndarray:
    return t


class Model:
    """``filters``: of words and of pairs, to broadcast; None above the bound, then ``held`` has their bits by kind and range."""

    def __init__(self, filters: tuple[Filter, Filter] | None, held: DataFrame, ranges: int, n: int, v: int,
                 mix_pairs: float, frequent: tuple[np.ndarray, np.ndarray]):
        self.filters, self.held, self.ranges = filters, held, ranges
        self.n, self.v, self.mix_pairs, self.frequent = n, v, mix_pairs, frequent


def learn_model(training: DataFrame, text_col: str = "text", mix_pairs: float = 0.3, min_pair: int = 1,
                max_bytes: int = 1 << 26) -> tuple[Model, DataFrame]:
    """The model, and the exact counts (h, n) of all words.  A filter above ``max_bytes`` is not broadcast."""
    texts = training.select(F.col(f"`{text_col}`").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(0, (size // RANGE_BYTES).bit_length())
    words = cut_lineage(_counted(texts, _same, ranges, 1, True))
    twos = cut_lineage(_counted(texts, pairs, ranges, min_pair, False))
    held = (words.select(F.lit(0).alias("kind"), "part", "bits")
            .unionByName(twos.select(F.lit(1).alias("kind"), "part", "bits")))
    counts = words.select(F.explode(F.arrays_zip("h", "n")).alias("x")).select("x.h", "x.n")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    frequent = counts.orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).toArrow().sort_by("h")
    filters = None
    if (held.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) <= max_bytes:
        found = {(r["kind"], r["part"]): r["bits"] for r in held.toArrow().to_pylist()}
        filters = tuple(Filter.joined([found.get((kind, i), bytes(8)) for i in range(ranges)]) for kind in (0, 1))
    return Model(filters, held, ranges, int(n), int(v), mix_pairs,
                 (frequent["h"].to_numpy(), frequent["n"].to_numpy())), counts


def _probes(ranges: int, copies: int):
    """Group: the n-grams of a block to look up in each range of the filter."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        t, _ = tokens(table["_text"].to_pylist())
        rows = [(name, kind, i, name % copies, len(x), _gaps(x)) for kind, h in enumerate((np.unique(t), np.unique(pairs(t))))
                for i, x in enumerate(np.split(h, _by_range(h, ranges))) if len(x)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        ["_block", "kind", "part", "copy", "size", "h"])

    return run


def _looked_up(probes: pa.Table, held: pa.Table) -> pa.Table:
    """The levels of the n-grams of one range, as bytes in the order of the n-grams; those of many blocks are probed once."""
    table = Filter.joined(held["bits"].to_pylist() or [bytes(8)])
    asked = [_hashes(r["h"], r["size"]) for r in probes.to_pylist()]
    h, which = np.unique(np.concatenate([np.empty(0, np.uint64), *asked]), return_inverse=True)
    level = table.levels(h).astype(np.uint8)[which]
    found = [_shrunk(x) for x in np.split(level, np.cumsum([len(x) for x in asked])[:-1])] if asked else []
    return pa.table({"_block": probes["_block"], "kind": probes["kind"], "part": probes["part"], "size": probes["size"],
                     "level": pa.array(found, pa.binary())})


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` but the text, plus n_tokens, n_known, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.filters, model.n, model.v, model.mix_pairs, model.frequent))
    names = ("n_tokens", "n_known", "base_score", "score")
    kept = [c for c in docs.columns if c != text_col and c.lower() not in names]
    extra = StructType.fromDDL("n_tokens long, known long, base double, score double, rare array<long>")
    inner = [f"_given{i}" for i in range(len(kept))]             # no column of any name clashes with those made here
    plain = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(kept, inner, strict=True)],
                        F.col(f"`{text_col}`").alias("_text"))
    schema = StructType([*plain.drop("_text").schema.fields, *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value[0]
        for b in batches:
            yield from scored_rows(b, lambda kind, h: filters[kind].levels(h))

    def of_block(rows: pa.Table, found: pa.Table) -> pa.Table:
        def read(kind: int, h: np.ndarray) -> np.ndarray:
            some = found.filter(pc.equal(found["kind"], kind)).sort_by("part").to_pylist()
            level = np.concatenate([_regrown(r["level"], r["size"], np.uint8) for r in some])
            if len(level) != len(h):
                raise RuntimeError("a block of texts was not read again as it was sent")
            return level.astype(np.int64)

        rows = rows.drop_columns("_block").combine_chunks()
        return pa.Table.from_batches([block(b, *tokens(b.column("_text").to_pylist()), read) for b in rows.to_batches()])

    def scored_rows(b: pa.RecordBatch, find) -> Iterator[pa.RecordBatch]:
        at = 0
        for some in some_at_a_time(b.column("_text").to_pylist(), _SCORED):
            yield block(b.slice(at, len(some)), *tokens(some), find)
            at += len(some)

    def block(b, t, sizes, find):
        _, total, kinds, mix_pairs, (keys, often) = shared.value

        def count(kind, h):                      # no n-gram occurs more often than there are tokens
            return np.minimum(expected(find(kind, h)), total)

        first = np.cumsum(sizes) - sizes
        words, which = np.unique(t, return_inverse=True)
        c = count(0, words)
        both, pair = np.unique(pairs(t), return_inverse=True)
        cb = count(1, both)[pair]
        before = np.roll(c[which], 1)
        before[first] = c[np.searchsorted(words, END)]
        single = (c[which] + 1) / (total + kinds + 1)
        share = np.minimum(1.0, cb / np.maximum(before, 1))
        p = np.where(before > 0, mix_pairs * share + (1 - mix_pairs) * single, single)
        score = np.add.reduceat(np.log10(p), first)
        place = np.minimum(np.searchsorted(keys, words.view(np.int64)), max(len(keys) - 1, 0))
        found = keys[place] == words.view(np.int64) if len(keys) else np.zeros(len(words), bool)
        exact = np.where(found, np.log10((often[place] if len(keys) else 0) + 1.0), 0.0)[which]
        known = found[which]
        rare = [x[~k].view(np.int64) for x, k in zip(np.split(t, first[1:]), np.split(known, first[1:]), strict=True)]
        base = np.add.reduceat(exact, first) - sizes * np.log10(total + kinds + 1.0)
        cols = [b.column(i) for i, n in enumerate(b.schema.names) if n != "_text"]
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(sizes, pa.int64()), pa.array(np.add.reduceat(known.astype(np.int64), first)),
             pa.array(base), pa.array(score), pa.array(rare, pa.list_(pa.int64()))], schema=pa.schema(
                [*[f for f in b.schema if f.name != "_text"], ("n_tokens", pa.int64()), ("known", pa.int64()),
                 ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64()))]))

    if model.filters is not None:
        judged = plain.mapInArrow(run, schema)
    else:
        size = plain.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
        copies = 1 + size // (model.ranges * RANGE_BYTES)        # of a range, where far more is scored than was learned
        name = F.pmod(F.xxhash64("_text", F.spark_partition_id()), F.lit(1 + size // RANGE_BYTES))
        plain = plain.withColumn("_block", name)                 # both groupings below read one shuffle of it
        probes = plain.groupBy("_block").applyInArrow(
            _probes(model.ranges, copies), "_block long, kind int, part int, copy int, size int, h binary")
        held = model.held.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        found = (probes.groupBy("kind", "part", "copy").cogroup(held.groupBy("kind", "part", "copy"))
                 .applyInArrow(_looked_up, "_block long, kind int, part int, size int, level binary"))
        judged = plain.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(of_block, schema)
    scored = cut_lineage(judged.withColumn("_row", F.monotonically_increasing_id()))
    rest = (scored.select("_row", F.explode("rare").alias("h"))
            .join(counts, "h").groupBy("_row")
            .agg(F.sum(F.log10(F.col("n") + 1.0)).alias("_more"), F.count("n").alias("_seen")))
    return (scored.join(rest, "_row", "left")
            .select(*[F.col(x).alias(c) for c, x in zip(kept, inner, strict=True)], "n_tokens",
                    (F.col("known") + F.coalesce("_seen", F.lit(0))).alias("n_known"),
                    (F.col("base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), "score"))

"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of documents of about ``SHARD`` words that one task has read.
Its text is the sequence of word numbers, each document closed by a mark of its
own.  The index holds the Burrows-Wheeler transform of that sequence as a wavelet
matrix, the sorted hashes of the shard's words, and every ``RATE``-th suffix
position.  It is written as a table and knows nothing of the benchmark, so that
other test sets can be searched for without reading the texts again.

Test phrases are windows of ``width`` words of the items (a shorter item is one
window).  All windows of a broadcast group go backwards through the index at
once, two ranks a word; rows of their suffix ranges step to the next sampled
position, which gives every occurrence.  Spans are merged per document.

Documents longer than ``SEGMENT`` words lie in several segments that overlap by
``width - 1`` words; a row per document results, whatever its length.  Windows
are broadcast in groups of about ``GROUP``, each a pass over the index.

Edge cases: null and wordless texts have no words and no hits; rows are told
apart by a number, so repeated rows and ids and null ids give a row each; items
without words are never found; equal windows count for all their items, rows
that share an item_id are one item, and a null item_id counts as ''; no
documents give no rows, no items leave every row clean; other columns of either
table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import written
from papyra.llm.tokens import ALPHANUMERIC, words_by_text

SHARD = 1 << 20        # words and documents of a shard; two such numbers and a third fit in 63 bits
SEGMENT = 1 << 19
RATE = 8
GROUP = 1 << 16        # windows broadcast at once, 80 bytes each
WIDTH = 10
_LOCATE = 1 << 18      # suffix rows located at once
_BLOBS = ("bits", "zeros", "jumps", "vocab", "marks", "samples", "starts")


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of numbers below 2^21 in which some mark that occurs once follows every place."""
    n, h = len(s), 3
    key = s.astype(np.int64) << 42
    key[:-1] |= s[1:].astype(np.int64) << 21
    key[:-2] |= s[2:]
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    slots = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(slots):                                        # only suffixes that share h words are sorted again
        at = order[slots]
        key = (rank[at] << 21) | rank[at + h]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        slots = slots[~(first & np.append(first[1:], True))]
        h *= 2
    return order


def _packed(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bits) // 64 + 1, np.uint64)
    raw = np.packbits(bits, bitorder="little")
    out.view(np.uint8)[:len(raw)] = raw
    return out


def _counted(words: np.ndarray) -> np.ndarray:
    """Ones before each word of a bit row."""
    out = np.zeros(words.shape, np.int64)
    np.cumsum(np.bitwise_count(words[..., :-1]), axis=-1, out=out[..., 1:])
    return out


def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    at = i >> 6
    return before[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


def index_shard(docs: list[np.ndarray]) -> dict[str, bytes]:
    """The FM-index of documents given as arrays of word hashes."""
    sizes = np.array([len(d) + 1 for d in docs])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    n, close = int(starts[-1]), starts[1:] - 1
    coded = pa.array(np.concatenate(docs).view(np.int64)).dictionary_encode()
    seen = coded.dictionary.to_numpy().view(np.uint64)
    by = np.argsort(seen)
    number = np.empty(len(seen), np.int64)
    number[by] = np.arange(1, len(seen) + 1)
    word = np.ones(n, bool)
    word[close] = False
    text = np.zeros(n, np.int64)                             # 0 closes a document
    text[word] = number[coded.indices.to_numpy()]
    distinct = text + (len(docs) - 1)
    distinct[close] = np.arange(len(docs))
    order = suffix_order(distinct)

    left = text[order - 1]                                   # order 0 reads the last mark, a 0
    counts = np.bincount(left, minlength=len(seen) + 1)
    levels = max(1, int(len(seen)).bit_length())
    bits, zeros = np.empty((levels, n // 64 + 1), np.uint64), np.empty(levels, np.int64)
    x = left.astype(np.int32)
    for i in range(levels):
        one = (x >> (levels - 1 - i)) & 1 != 0
        bits[i], zeros[i] = _packed(one), n - int(one.sum())
        x = np.concatenate((x[~one], x[one]))
    head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    bottom = np.zeros(len(seen) + 1, np.int64)
    bottom[x[head]] = head
    sampled = (order % RATE == 0) | ~word[order - 1]         # and every start of a document
    return {"bits": bits.tobytes(), "zeros": zeros.tobytes(), "vocab": seen[by].tobytes(),
            "jumps": (np.cumsum(counts) - counts - bottom).astype(np.int32).tobytes(),
            "marks": _packed(sampled).tobytes(), "samples": order[sampled].astype(np.int32).tobytes(),
            "starts": starts.astype(np.int32).tobytes()}


class Shard:
    """An index that was read back."""

    def __init__(self, blobs: dict[str, bytes]):
        kinds = {"bits": np.uint64, "zeros": np.int64, "vocab": np.uint64, "marks": np.uint64}
        got = {k: np.frombuffer(blobs[k], kinds.get(k, np.int32)) for k in _BLOBS}
        self.zeros, self.vocab, self.marks = got["zeros"], got["vocab"], got["marks"]
        self.jumps, self.samples, self.starts = (got[k].astype(np.int64) for k in ("jumps", "samples", "starts"))
        self.bits = got["bits"].reshape(len(self.zeros), -1)
        self.before, self.marked = _counted(self.bits), _counted(self.marks)
        self.n = int(self.starts[-1])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; 0 for those that the shard doesn't hold."""
        at = np.searchsorted(self.vocab, hashes)
        there = at < len(self.vocab)
        there[there] = self.vocab[at[there]] == hashes[there]
        return np.where(there, at + 1, 0)

    def _backward(self, rows: np.ndarray, word: np.ndarray) -> np.ndarray:
        """First row not below the suffixes that put ``word`` before those above ``rows``."""
        for i, (bits, before) in enumerate(zip(self.bits, self.before, strict=True)):
            ones = _ones(bits, before, rows)
            rows = np.where(word >> (len(self.zeros) - 1 - i) & 1 != 0, self.zeros[i] + ones, rows - ones)
        return rows + self.jumps[word]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each phrase (numbers, flush left in a row)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        inside = np.arange(phrases.shape[1]) < lengths[:, None]
        live = np.flatnonzero((lengths > 0) & ((phrases > 0) | ~inside).all(1))
        low[np.setdiff1d(np.arange(len(phrases)), live)] = self.n
        for back in range(1, phrases.shape[1] + 1):
            now = live[lengths[live] >= back]
            if not len(now):
                break
            word = phrases[now, lengths[now] - back]
            low[now], high[now] = np.split(self._backward(np.concatenate((low[now], high[now])), np.tile(word, 2)), 2)
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: backward steps to the next sampled one."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            here = self.marks[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1) != 0
            out[todo[here]] = self.samples[_ones(self.marks, self.marked, rows[here])] + steps
            todo, rows, steps = todo[~here], rows[~here], steps + 1
            word = np.zeros(len(rows), np.int64)
            for i, (bits, before) in enumerate(zip(self.bits, self.before, strict=True)):
                one = bits[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1) != 0
                ones = _ones(bits, before, rows)
                rows = np.where(one, self.zeros[i] + ones, rows - ones)
                word = word << 1 | one
            rows = rows + self.jumps[word]
        return out


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """One row per shard: the index, and per segment its document's number and id and its place there in words."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                       F.col(f"`{text_col}`").alias("text"))
    id_type = rows.schema["id"].dataType
    schema = f"rows array<long>, ids array<{id_type.simpleString()}>, places array<long>, " + ", ".join(
        f"{b} binary" for b in _BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, meta, n = [], [], 0

        def shard():
            out = {k: [v] for k, v in index_shard(held).items()}
            out |= {k: [[m[i] for m in meta]] for i, k in enumerate(("rows", "ids", "places"))}
            kinds = [("rows", pa.list_(pa.int64())), ("ids", pa.list_(id_kind)), ("places", pa.list_(pa.int64()))]
            return pa.RecordBatch.from_pydict(out, pa.schema(kinds + [(b, pa.binary()) for b in _BLOBS]))

        for b in batches:
            id_kind, numbers, ids = b.schema.field("id").type, b.column("row").to_pylist(), b.column("id").to_pylist()
            own, place = [], 0
            for i, hashes, last in words_by_text(b.column("text").to_pylist(), ALPHANUMERIC):
                own.append(hashes)
                while True:
                    size = sum(map(len, own))
                    if size <= SEGMENT and not last:
                        break
                    whole = own[0] if len(own) == 1 else np.concatenate(own)
                    part = whole[:SEGMENT]
                    if held and n + len(part) + 1 > SHARD:
                        yield shard()
                        held, meta, n = [], [], 0
                    held.append(part)
                    meta.append((numbers[i], ids[i], place))
                    n += len(part) + 1
                    if size <= SEGMENT:
                        own, place = [], 0
                        break
                    own, place = [whole[SEGMENT - width + 1:]], place + SEGMENT - width + 1
        if held:
            yield shard()

    return rows.mapInArrow(run, schema)


def item_windows(items: DataFrame, text_col: str = "text", id_col: str = "item_id", width: int = WIDTH) -> DataFrame:
    """Distinct (item, window) rows; a window is the bytes of its word hashes."""
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"),
                        F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, before, any_yet = b.column("item").to_pylist(), np.empty(0, np.uint64), False
            for i, hashes, last in words_by_text(b.column("text").to_pylist(), ALPHANUMERIC):
                whole = np.concatenate((before, hashes))
                found = [whole[at:at + width].tobytes() for at in range(len(whole) - width + 1)]
                if last and not any_yet and 0 < len(whole) < width:
                    found = [whole.tobytes()]
                any_yet = not last and (any_yet or bool(found))
                before = whole[:0] if last else whole[len(whole) - min(len(whole), width - 1):]
                yield pa.RecordBatch.from_pydict({"item": [ids[i]] * len(found), "window": found},
                                                 pa.schema([("item", pa.string()), ("window", pa.binary())]))

    return rows.mapInArrow(run, "item string, window binary").distinct()


def _search(shard: Shard, words: np.ndarray, phrases: np.ndarray, lengths: np.ndarray):
    """Hit places of the shard's text, and the (document, phrase) pairs that occur."""
    numbers = np.concatenate((shard.numbers(words), [0]))[phrases]
    low, high = shard.ranges(numbers, lengths)
    size = high - low
    edge, pairs = np.zeros(shard.n + 1, np.int64), np.empty(0, np.int64)
    for begin in range(0, int(size.sum()), _LOCATE):
        nth = np.arange(begin, min(begin + _LOCATE, int(size.sum())))
        ends = np.cumsum(size)
        phrase = np.searchsorted(ends, nth, "right")
        at = shard.locate(low[phrase] + nth - (ends - size)[phrase])
        np.add.at(edge, at, 1)
        np.add.at(edge, at + lengths[phrase], -1)
        doc = np.searchsorted(shard.starts, at, "right") - 1
        pairs = np.unique(np.concatenate((pairs, doc * len(phrases) + phrase)))
    return np.cumsum(edge[:-1]) > 0, pairs // max(1, len(phrases)), pairs % max(1, len(phrases))


def _found(index: DataFrame, windows: list[tuple[str, bytes]], counts: bool) -> DataFrame:
    spark = index.sparkSession
    names = sorted({w[0] for w in windows})
    numbered = {x: i for i, x in enumerate(sorted({w[1] for w in windows}))}
    rows = [np.frombuffer(w, np.uint64) for w in numbered]
    width = max(map(len, rows), default=1)
    words = np.unique(np.concatenate([np.empty(0, np.uint64), *rows]))
    phrases = np.full((len(rows), width), len(words))        # the last number stands for no word
    for i, w in enumerate(rows):
        phrases[i, :len(w)] = np.searchsorted(words, w)
    lengths = np.array([len(w) for w in rows], np.int64)
    place = {x: i for i, x in enumerate(names)}
    owner = np.array(sorted((numbered[w], place[x]) for x, w in windows), np.int64).reshape(-1, 2)
    sent = spark.sparkContext.broadcast((names, words, phrases, lengths, owner))
    id_kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, phrases, lengths, owner = sent.value
        for b in batches:
            id_type = b.schema.field("ids").type.value_type
            for r in range(b.num_rows):
                shard = Shard({c: b.column(c)[r].as_py() for c in _BLOBS})
                hit, doc, phrase = _search(shard, words, phrases, lengths)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
                begin, end = edge[::2], edge[1::2]           # a mark is never hit, so no run leaves its document
                of = np.searchsorted(shard.starts, begin, "right") - 1
                places = b.column("places")[r].values.to_numpy()
                shift = places - shard.starts[:-1]
                cuts = np.searchsorted(of, np.arange(1, len(places)))
                own = np.searchsorted(owner[:, 0], phrase), np.searchsorted(owner[:, 0], phrase, "right")
                held = np.repeat(doc, own[1] - own[0])
                which = owner[np.concatenate([np.arange(x, y) for x, y in zip(*own, strict=True)]).astype(int), 1] if len(doc) else owner[:0, 1]
                pair = np.unique(held * max(1, len(names)) + which)
                item_cuts = np.searchsorted(pair // max(1, len(names)), np.arange(1, len(places)))
                size = (places + np.diff(shard.starts) - 1) if counts else places * 0
                yield pa.RecordBatch.from_arrays([
                    b.column("rows")[r].values, b.column("ids")[r].values.cast(id_type), pa.array(size),
                    pa.array([x.tolist() for x in np.split(begin + shift[of], cuts)], pa.list_(pa.int64())),
                    pa.array([x.tolist() for x in np.split(end + shift[of], cuts)], pa.list_(pa.int64())),
                    pa.array([[names[i] for i in x] for x in np.split(pair % max(1, len(names)), item_cuts)],
                             pa.list_(pa.string()))], ["row", "id", "n_words", "begins", "ends", "items"])

    return index.mapInArrow(run, f"row long, id {id_kind}, n_words long, begins array<long>, ends array<long>, "
                                 "items array<string>")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted and joined where they touch."""
    for b in batches:
        begins, ends, hits = [], [], []
        for x, y in zip(b.column("begins").to_pylist(), b.column("ends").to_pylist(), strict=True):
            by = np.argsort(x, kind="stable")
            begin, end = np.array(x, np.int64)[by], np.maximum.accumulate(np.array(y, np.int64)[by])
            first = np.concatenate(([True], begin[1:] > end[:-1]))[:len(begin)]
            begin, end = begin[first], end[np.append(first[1:], True)[:len(end)]]
            begins.append(begin.tolist())
            ends.append(end.tolist())
            hits.append(int((end - begin).sum()))
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("n_words"), pa.array(hits, pa.int64()), pa.array(begins, pa.list_(pa.int64())),
             pa.array(ends, pa.list_(pa.int64())), b.column("items")],
            ["id", "n_words", "n_hit", "begins", "ends", "items"])


def find_windows(index: DataFrame, windows: DataFrame, group: int = GROUP) -> DataFrame:
    """Per document: id, n_words, n_hit, the removal spans (begins, ends in words) and the sorted items found."""
    windows = written(windows, "windows")
    groups = max(1, -(-windows.count() // group))
    found = None
    for g in range(groups):
        own = windows.where(F.pmod(F.xxhash64("item", "window"), F.lit(groups)) == g).toArrow()
        part = _found(index, list(zip(own.column("item").to_pylist(), own.column("window").to_pylist(), strict=True)),
                      counts=g == 0)
        found = part if found is None else found.unionByName(part)
    by_doc = found.groupBy("row").agg(
        F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("begins")).alias("begins"),
        F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    id_kind = by_doc.schema["id"].dataType.simpleString()
    return by_doc.drop("row").mapInArrow(
        _merged, f"id {id_kind}, n_words long, n_hit long, begins array<long>, ends array<long>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``find_windows`` of ``items`` in an index of ``docs`` that is written to the shared folder."""
    return find_windows(written(build_index(docs, width=width), "fm_index"), item_windows(items, width=width))

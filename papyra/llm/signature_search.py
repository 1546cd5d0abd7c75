"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature holds its terms, once for every power of two that a
term's count reaches.  Signatures of like size form a block; a block is stored by
slices: one bitmap over its documents per signature bit.  The bits of a term and
level are the AND of ``PROBES`` slices, which may name documents too many but
never one too few, so the weighted sum over terms and levels, with the largest
count that a level allows, is an upper bound of every document's score.

A block's documents are rescored from its forward lists, highest bound first,
until no bound reaches the k-th score; only documents that are provably out are
left unscored.  The k-th scores start from a first pass over one block in
``SAMPLE``: any documents' k-th score is a bound for all, so the result doesn't
depend on it, and a task passes on only documents that reach it.

The index is a table in the shared folder.  Items are broadcast in groups, each
a pass over the index; ``GROUP`` bounds their number.

Edge cases: null and termless texts count nowhere and are never returned; a null
id ranks behind all others of its score; repeated rows and ids are documents of
their own; rows that share an item_id are one item with the terms of all; items
without terms, or whose terms no document holds, give no rows; empty tables give
no rows; ids are integers below 2^63 - 1; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import written
from papyra.llm.tokens import ALPHANUMERIC, words_by_text
from papyra.llm.words import mix

PROBES = 3
BITS = 8               # of a signature per entry, at least; less than twice as many at most
DOCS = 512             # of a block
ENTRIES = 1 << 18      # terms of a block; a document with more is a block of its own
SAMPLE = 16
GROUP = 256            # items broadcast together
TERMS = 2048           # terms bounded together
ROUND = 64             # documents rescored per item before its k-th score is read again
_NO_ID = np.iinfo(np.int64).max
_BLOCK = [("draw", pa.int32()), ("docs", pa.int64()), ("total", pa.int64()), ("width", pa.int64()), ("levels", pa.int32())] + [
    (c, pa.binary()) for c in ("ids", "sizes", "slices", "terms", "counts", "ends")]
_KINDS = {"ids": np.int64, "sizes": np.int64, "slices": np.uint8, "terms": np.uint64, "counts": np.int32, "ends": np.int64}


def _places(keys: np.ndarray, level: int, width: int) -> np.ndarray:
    """The slices of (key, level), a row of PROBES each."""
    a = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    b = mix(a) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(width)).astype(np.int64)


def _block(held: list[tuple], entries: int) -> dict:
    """Slices and forward lists of documents (row, id, size, terms, counts)."""
    width = BITS * entries
    ends = np.cumsum([len(d[3]) for d in held])
    terms, counts = np.concatenate([d[3] for d in held]), np.concatenate([d[4] for d in held])
    doc = np.repeat(np.arange(len(held)), [len(d[3]) for d in held])
    bits = np.zeros((width, len(held)), bool)
    level = 0
    while len(at := np.flatnonzero(counts >> level)):
        bits[_places(terms[at], level, width), doc[at, None]] = True
        level += 1
    out = {"ids": np.array([_NO_ID if d[1] is None else d[1] for d in held], np.int64),
           "sizes": np.array([d[2] for d in held], np.int64), "slices": np.packbits(bits, axis=1, bitorder="little"),
           "terms": terms, "counts": counts.astype(np.int32), "ends": ends}
    return {"draw": int(mix(np.array([held[0][0]], np.uint64))[0] % np.uint64(SAMPLE)), "docs": len(held),
            "total": int(out["sizes"].sum()), "width": width, "levels": level,
            **{c: x.astype(_KINDS[c]).tobytes() for c, x in out.items()}}


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per block of documents with at least one term."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}                           # by the logarithm of the signature's entries
        kept: dict[int, int] = {}
        emit = lambda c: pa.RecordBatch.from_pylist([_block(held.pop(c), 1 << c)], pa.schema(_BLOCK))
        for b in batches:
            numbers, ids, own = b.column("row").to_pylist(), b.column("id").to_pylist(), []
            for i, hashes, last in words_by_text(b.column("text").to_pylist(), ALPHANUMERIC):
                own.append(np.unique(hashes, return_counts=True))
                if not last:
                    continue
                terms, counts = own[0]
                if len(own) > 1:
                    terms, at = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([x for _, x in own])).astype(np.int64)
                own = []
                if not len(terms):
                    continue
                entries = int((np.frexp(counts.astype(np.float64))[1]).sum())      # 1 + floor(log2) levels a term
                c = max(3, (entries - 1).bit_length())
                if c in held and (len(held[c]) == DOCS or kept[c] + len(terms) > ENTRIES):
                    yield emit(c)
                if c not in held:
                    held[c], kept[c] = [], 0
                held[c].append((numbers[i], ids[i], int(counts.sum()), terms, counts))
                kept[c] += len(terms)
        for c in list(held):
            yield emit(c)

    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[t]}" for c, t in _BLOCK))


def item_terms(items: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """Distinct (item, term) rows; terms as signed hashes."""
    rows = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, hashes, _ in words_by_text(b.column("text").to_pylist(), ALPHANUMERIC):
                terms = np.unique(hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array([i] * len(terms), pa.int64())),
                                                  pa.array(terms)], ["item", "term"])

    return rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, term long").distinct()


class Group:
    """Items of one broadcast: their terms as ranges of numbers into the sorted vocabulary, with weights."""

    def __init__(self, items: list, terms: np.ndarray):
        """``items`` and ``terms`` (uint64) row by row."""
        names = {x: i for i, x in enumerate(dict.fromkeys(items))}
        self.items = list(names)
        self.vocab, number = np.unique(terms, return_inverse=True)
        of = np.array([names[x] for x in items], np.int64)
        by = np.lexsort((number, of))
        self.of, self.number = of[by], number[by]
        self.ends = np.searchsorted(self.of, np.arange(len(names)), "right")
        self.weights = np.zeros(len(self.vocab), np.int64)
        self.n = self.total = 0

    def weigh(self, n: int, total: int, df: np.ndarray) -> None:
        self.n, self.total = n, total
        self.weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        self.weights[df == 0] = 0

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among ``terms`` that are in the vocabulary, and their numbers."""
        at = np.minimum(np.searchsorted(self.vocab, terms), len(self.vocab) - 1)
        there = np.flatnonzero(self.vocab[at] == terms)
        return there, at[there]

    def part(self, count: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1000000000 * count // (1000 * count + 20 * m)

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        return 50 + 50 * sizes * self.n // self.total

    def bounds(self, block: dict) -> np.ndarray:
        """Upper bounds of the scores, items by documents."""
        slices, docs, width = block["slices"].reshape(block["width"], -1), block["docs"], block["width"]
        m, out = self.lengths(block["sizes"]), np.zeros((len(self.items), block["docs"]))
        for begin in range(0, len(self.vocab), TERMS):
            at = np.arange(begin, min(begin + TERMS, len(self.vocab)))
            at = at[self.weights[at] > 0]
            there, below = None, 0
            for level in range(block["levels"]):
                own = np.bitwise_and.reduce(slices[_places(self.vocab[at], level, width)], axis=1)
                there = own if there is None else there & own
                some = there.any(1)
                at, there = at[some], there[some]
                if not len(at):
                    break
                pick = np.flatnonzero(np.isin(self.number, at))
                weights = np.zeros((len(self.items), len(at)))
                weights[self.of[pick], np.searchsorted(at, self.number[pick])] = self.weights[self.number[pick]]
                most = self.part(np.int64((2 << level) - 1), m)
                out += (weights @ np.unpackbits(there, axis=1, count=docs, bitorder="little").astype(np.float64)) * (most - below)
                below = most
        return out

    def rescore(self, block: dict, doc: int, which: np.ndarray) -> list[int]:
        """Exact scores of one document for some of the items."""
        own = slice(int(block["ends"][doc - 1]) if doc else 0, int(block["ends"][doc]))
        place, number = self.find(block["terms"][own])
        parts = np.zeros(len(self.vocab), np.int64)
        parts[number] = self.weights[number] * self.part(block["counts"][own][place].astype(np.int64),
                                                         self.lengths(block["sizes"][doc:doc + 1]))
        return [int(parts[self.number[self.ends[i - 1] if i else 0:self.ends[i]]].sum()) for i in which.tolist()]


class Best:
    """The k best (score, id) per item so far."""

    def __init__(self, items: int, k: int, floor: np.ndarray | None = None):
        self.k, self.scores, self.ids = k, [np.empty(0, np.int64)] * items, [np.empty(0, np.int64)] * items
        self.low = np.ones(items, np.int64) if floor is None else floor.copy()   # least score that may still enter

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.scores[item], scores)), np.concatenate((self.ids[item], ids))
        s, i = s[s >= self.low[item]], i[s >= self.low[item]]
        by = np.lexsort((i, -s))[:self.k]
        self.scores[item], self.ids[item] = s[by], i[by]
        if len(by) == self.k:
            self.low[item] = max(self.low[item], s[by[-1]])

    def rescored(self, block: dict, group: Group) -> int:
        """Takes in a block; the number of (item, document) pairs that were scored."""
        bounds, scored = group.bounds(block), 0
        order = np.argsort(-bounds, axis=1, kind="stable")
        for begin in range(0, bounds.shape[1], ROUND):
            docs = order[:, begin:begin + ROUND]
            live = np.take_along_axis(bounds, docs, 1) >= self.low[:, None]
            if not live.any():
                break
            item, at = np.nonzero(live)
            doc, scores = docs[item, at], np.empty(len(item), np.int64)
            by = np.argsort(doc, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(doc[by])) + 1):
                scores[own] = group.rescore(block, int(doc[own[0]]), item[own])
            for own in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
                self.add(int(item[own[0]]), scores[own], block["ids"][doc[own]])
            scored += len(item)
        return scored


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for r in range(b.num_rows):
            yield {c: np.frombuffer(b.column(c)[r].as_py(), _KINDS[c]) if c in _KINDS else b.column(c)[r].as_py()
                   for c in b.schema.names}


def _frequencies(index: DataFrame, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = sent.value
        df = np.zeros(len(group.vocab), np.int64)
        for block in _blocks(batches):
            df += np.bincount(group.find(block["terms"])[1], minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], ["number", "df"])

    return index.select("terms").mapInArrow(run, "number long, df long").groupBy("number").agg(F.sum("df").alias("df"))


def _ranked(index: DataFrame, sent, k: int, item_type: str, floor=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = sent.value
        best = Best(len(group.items), k, floor.value if floor else None)
        for block in _blocks(batches):
            best.rescored(block, group)
        for i in range(len(group.items)):
            ids = best.ids[i]
            yield pa.RecordBatch.from_pydict({"nth": np.full(len(ids), i), "doc_id": pa.array(ids, mask=ids == _NO_ID),
                                              "score": best.scores[i]})

    found = index.mapInArrow(run, "nth long, doc_id long, score long")
    best = Window.partitionBy("nth").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 50, group_size: int = GROUP) -> DataFrame:
    """(item, term) rows against a written index -> item, rank, doc_id, score: the k best documents of each item."""
    spark, item_type = index.sparkSession, items.schema["item"].dataType.simpleString()
    items = written(items, "item_terms")
    n, total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    groups = -(-items.agg(F.count_distinct(F.struct("item"))).first()[0] // group_size)
    out = spark.createDataFrame([], f"item {item_type}, rank int, doc_id long, score long")
    for g in range(groups if n else 0):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).toArrow()
        if not own.num_rows:
            continue
        group = Group(own.column("item").to_pylist(), own.column("term").to_numpy().view(np.uint64))
        df = np.zeros(len(group.vocab), np.int64)
        for r in _frequencies(index, spark.sparkContext.broadcast(group)).collect():    # at most the group's terms
            df[r["number"]] = r["df"]
        group.weigh(n, total, df)
        sent = spark.sparkContext.broadcast(group)
        floor = np.ones(len(group.items), np.int64)
        for r in _ranked(index.where("draw = 0"), sent, k, item_type).where(F.col("rank") == k).collect():
            floor[r["nth"]] = r["score"]
        found = _ranked(index, sent, k, item_type, spark.sparkContext.broadcast(floor))
        names = spark.createDataFrame(list(enumerate(group.items)), f"nth long, item {item_type}")
        out = out.unionByName(found.join(F.broadcast(names), "nth").select("item", "rank", "doc_id", "score"))
    return out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``search`` for the terms of ``items`` in an index of ``docs`` that is written to the shared folder."""
    return search(written(build_index(docs), "signatures"), item_terms(items), k)

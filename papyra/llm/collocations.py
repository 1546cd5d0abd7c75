"""Phrase collocations by dynamic itemset counting.

The documents lie in ``shards`` parts that are scanned in a cycle; lengths are
not counted one after the other but interleaved.  Single words are active from
the first scan.  A longer phrase becomes active behind the scan in which the last
of its two subphrases (all words but the last, all but the first) has reached
``min_count``, joins the scan where that one stands, and is counted for one full
cycle of shards.  Counting ends when every active phrase has come round.

Which phrases are active is told by a table of bytes per length, ``1 << FILTER``
long whatever the corpus, that holds for each hash place the first scan after
which some phrase of that place had reached the threshold.  A phrase's place of
entry follows from the table alone, at every later time alike, so each is counted
over exactly one cycle and no task needs the set of phrases.  Phrases that are let
in because a place is shared are counted in full like the others and fail the
threshold by themselves; counts are exact whatever the table's load.  A phrase
that has come round below the threshold is forgotten.

Phrases are told apart by 64-bit hashes while counting; counts move as sorted,
packed keys per bucket, whose number grows with the text.  At the end the words of
all frequent phrases are read back from the texts.  Two phrases read back under
one hash stop the job with an error, and another ``seed`` separates them.

Edge cases: null texts are empty, a null lang is ``und``; breaks at either end
and empty pieces hold no phrases; a text of any length is cut into slices behind
a delimiter, and phrases across a cut count once; repeated rows and ids are
documents of their own; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import dropped, written
from papyra.llm.tokens import Delimiters, slices, words_in
from papyra.llm.words import chain, mix
from papyra.session import scratch_dir

SHARDS = 4
PARTS = 4              # folders of a shard
FILTER = 23            # bytes of the table of a length, as a power of two
KEPT = 26              # bits of the table of frequent phrases, as a power of two
BUFFER = 1 << 21       # occurrences added up at once in a task
PIECES = Delimiters(b" \t", b".,;:!?\n\x0b\x0c\r")
_NEVER = 255
BUCKET = 1 << 22       # bytes of text per bucket of counts
BUCKETS = 64, 1 << 18
_COUNTED = pa.schema([("bucket", pa.int64()), ("old", pa.bool_()), ("n", pa.int64()), ("keys", pa.binary()),
                      ("tags", pa.binary()), ("counts", pa.binary())])
_STATE = _COUNTED.append(pa.field("reached", pa.list_(pa.struct([("key", pa.int64()), ("length", pa.int32())])))).append(
    pa.field("kind", pa.string()))
_COUNTED_SQL = "bucket long, old boolean, n long, keys binary, tags binary, counts binary"
_STATE_SQL = _COUNTED_SQL + ", reached array<struct<key: long, length: int>>, kind string"
_BITMAP = 1 << 15      # bits of one bitmap of bitmap_construct_agg


def _phrases(batches: Iterator[pa.RecordBatch], longest: int, seed: int):
    """Per slice: words (begin, end, raw bytes), their text's place in the batch, and (keys, valid starts) by length.

    Words that stand before a cut come again in front of the next slice; only phrases that end in new words are valid.
    """
    langs: dict[str, np.uint64] = {}
    for b in batches:
        of, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for x in set(of) - langs.keys():
            langs[x] = np.frombuffer(hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).digest(), np.uint64)[0]
        before, carried = None, []
        for held in slices(texts, PIECES):
            parts = [p for _, p in held]
            old = b" ".join(carried) + (b" " if carried else b"") if before == held[0][0] else b""
            hashes, begin, end, ends, raw = words_in([old + parts[0], *parts[1:]], PIECES)
            text = np.repeat([i for i, _ in held], np.diff(ends, prepend=0))
            piece = np.cumsum(PIECES.kind[raw] == 2)[begin] if len(begin) else begin
            fresh = begin >= len(old)
            key = mix(hashes + np.array([langs[x] for x in of], np.uint64)[text])
            keys, valid = [key], [fresh]
            for n in range(2, longest + 1):
                if len(key) < n:
                    keys.append(key[:0])
                    valid.append(fresh[:0])
                    continue
                keys.append(chain(keys[-1][:len(key) - n + 1], key[n - 1:]))
                valid.append((piece[n - 1:] == piece[:len(key) - n + 1]) & fresh[n - 1:])
            yield of, text, (begin, end, raw), keys, valid
            before, carried = held[-1][0], []
            if len(held[-1][1]) and len(begin):             # the words of the open piece, should the text go on
                last = np.flatnonzero((text == before) & (piece == np.cumsum(PIECES.kind[raw] == 2)[-1]))[1 - longest:]
                carried = [raw[begin[i]:end[i]].tobytes() for i in last]


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys & np.uint64((1 << bits) - 1), keys >> np.uint64(64 - bits)


def _sent(spark, tables: list[np.ndarray]):
    """Tables of bytes as a broadcast, compressed: mostly empty ones take next to no place on any disk."""
    return spark.sparkContext.broadcast([pa.compress(t.tobytes(), "zstd", asbytes=True) for t in tables])


def _received(sent, size: int) -> list[np.ndarray]:
    return [np.frombuffer(pa.decompress(t, size, "zstd"), np.uint8) for t in sent.value]


def _planes(x: np.ndarray) -> bytes:
    """Numbers by their bytes, all lowest ones first, compressed: high bytes are mostly 0."""
    return pa.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd",
                       asbytes=True)


def _numbers(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, 8 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


def _packed(keys: np.ndarray, tags: np.ndarray, counts: np.ndarray) -> dict:
    """Sorted keys with tag and count, 5 to 7 bytes each."""
    return {"n": len(keys), "keys": _planes(np.diff(keys, prepend=np.uint64(0))), "tags": _planes(tags), "counts": _planes(counts)}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    return (np.cumsum(_numbers(row["keys"], n), dtype=np.uint64), _numbers(row["tags"], n).astype(np.int64),
            _numbers(row["counts"], n).astype(np.int64))


def _summed(keys: np.ndarray, tags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.argsort(keys)
    keys = keys[by]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[:len(keys)])
    return keys[head], tags[by[head]], np.add.reduceat(counts[by], head) if len(head) else counts


def _added(parts: list[tuple[np.ndarray, int]], bits: int) -> pa.RecordBatch:
    """Occurrences by key, a row per bucket (the key's highest bits); the tag (entry * 8 + length) follows from the key."""
    keys = np.concatenate([k for k, _ in parts])
    tags = np.repeat(np.array([t for _, t in parts], np.int64), [len(k) for k, _ in parts])
    keys, tags, counts = _summed(keys, tags, np.ones(len(keys), np.int64))
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))[:len(keys)])
    rows = [{"bucket": int(bucket[i]), "old": False, **_packed(keys[i:j], tags[i:j], counts[i:j])}
            for i, j in zip(head, [*head[1:], len(keys)], strict=True)]
    return pa.RecordBatch.from_pylist(rows, _COUNTED)


def _merged(step: int, cycle: int, longest: int, min_count: int):
    """Per bucket: what is still open, what has come round with ``min_count``, and what has reached it just now."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = [_unpacked(r) for r in rows]
        old = np.repeat([r["old"] for r in rows], [r["n"] for r in rows])
        keys, tags, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        total = _summed(keys, tags, counts)
        before = _summed(keys, tags, np.where(old, counts, 0))[2]
        keys, tags, counts = total
        enough, round_ = counts >= min_count, (tags >> 3) + cycle - 1 <= step
        new = enough & (before < min_count) & (tags & 7 < longest)
        out = []
        for kind, own in (("open", ~round_), ("closed", round_ & enough)):
            reached = [{"key": k, "length": t} for k, t in zip(
                keys[own & new].view(np.int64).tolist(), (tags[own & new] & 7).tolist(), strict=True)]
            if own.any():
                out.append({"bucket": rows[0]["bucket"], "old": True, **_packed(keys[own], tags[own], counts[own]),
                            "reached": reached, "kind": kind})
        return pa.Table.from_pylist(out, _STATE)

    return run


def _scan(shard: DataFrame, step: int, cycle: int, longest: int, entered, seed: int, bits: int) -> DataFrame:
    """Counts of the phrases that are active at ``step``, added up in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, parts = _received(entered, 1 << FILTER), []
        for *_, keys, valid in _phrases(batches, longest, seed):
            if step < cycle:
                parts.append((keys[0][valid[0]], 1))
            for length in range(2, longest + 1):
                shorter, ok = keys[length - 2], valid[length - 1]
                if not ok.any():
                    continue
                one, two = (tables[length - 2][p] for p in _places(shorter, FILTER))
                since = np.maximum(one, two)
                since = np.maximum(since[:len(ok)], since[1:len(ok) + 1])
                ok = ok & (since != _NEVER)
                for s in range(max(0, step - cycle), step):
                    own = ok & (since == s)
                    if own.any():
                        parts.append((keys[length - 1][own], (s + 1) * 8 + length))
            if sum(len(k) for k, _ in parts) >= BUFFER:
                yield _added(parts, bits)
                parts = []
        if any(len(k) for k, _ in parts):
            yield _added(parts, bits)

    return shard.mapInArrow(run, _COUNTED_SQL)


def _marked(keys: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """The places of (key, length) rows as bitmaps per length: 1 << bits bits each, gathered as such."""
    place = F.explode(F.array(F.col("key").bitwiseAND((1 << bits) - 1) + 1, F.shiftrightunsigned("key", 64 - bits) + 1))
    maps = (keys.select("length", place.alias("place"))
            .groupBy("length", F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")))
    out: dict[int, np.ndarray] = {}
    for r in maps.toArrow().to_pylist():
        at = (r["bucket"] - 1) * _BITMAP // 8
        own = out.setdefault(r["length"], np.zeros(max(_BITMAP, 1 << bits) // 8, np.uint8))
        own[at:at + _BITMAP // 8] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def _read_back(docs: DataFrame, wanted, longest: int, seed: int) -> DataFrame:
    """(key, lang, phrase) once per task for all phrases that ``wanted`` may hold; (null, lang, null, words) per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen, words = _received(wanted, 1 << KEPT - 3), set(), {}
        rows: tuple[list, list, list] = ([], [], [])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()),
                                               pa.array(rows[2], pa.string()), pa.nulls(len(rows[0]), pa.int64())],
                                              ["key", "lang", "phrase", "words"])

        for of, text, (begin, end, raw), keys, valid in _phrases(batches, longest, seed):
            for i, n in zip(*np.unique(text[valid[0]], return_counts=True), strict=True):
                words[of[i]] = words.get(of[i], 0) + int(n)
            raw = raw.tobytes()
            for length, (k, ok) in enumerate(zip(keys, valid, strict=True), 1):
                at = np.flatnonzero(ok)
                one, two = _places(k[at], KEPT)
                held = bitmap[length - 1]
                on = (held[(one >> np.uint64(3)).astype(np.int64)] >> (one & np.uint64(7)).astype(np.uint8)
                      & held[(two >> np.uint64(3)).astype(np.int64)] >> (two & np.uint64(7)).astype(np.uint8)) & 1
                at = at[on != 0]
                own, first = np.unique(k[at].view(np.int64), return_index=True)
                for x, i in zip(own.tolist(), at[first].tolist(), strict=True):
                    if x not in seen:
                        seen.add(x)
                        rows[0].append(x)
                        rows[1].append(of[text[i]])
                        rows[2].append(b" ".join([raw[begin[j]:end[j]] for j in range(i, i + length)]).decode())
            if len(rows[0]) >= 1 << 16:
                yield out()
                rows = ([], [], [])
            if len(seen) >= BUFFER // 4:
                seen.clear()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()),
                                          pa.nulls(len(words), pa.string()), pa.array(list(words.values()), pa.int64())],
                                         ["key", "lang", "phrase", "words"])

    return docs.mapInArrow(run, "key long, lang string, phrase string, words long")


def frequent_phrases(docs: DataFrame, min_count: int = 10, longest: int = 3, shards: int = SHARDS,
                     text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, count) of all phrases up to ``longest`` words with that count, and (lang, n) words."""
    spark = docs.sparkSession
    if longest * shards >= _NEVER or not 2 <= longest < 8:
        raise ValueError("longest must be 2 to 7, with fewer than 255 scans")
    path = scratch_dir(spark, "parts")
    kind = "lang string, text string, part int"
    (docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                 F.col(f"`{text_col}`").cast("string").alias("text"),
                 F.pmod(F.monotonically_increasing_id(), F.lit(PARTS * shards)).cast("int").alias("part"))
     .write.partitionBy("part").parquet(path))
    own = spark.read.schema(kind).parquet(path)
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = int(min(max(size // BUCKET, BUCKETS[0]), BUCKETS[1]) - 1).bit_length()

    tables = [np.full(1 << FILTER, _NEVER, np.uint8) for _ in range(longest - 1)]
    still, closed, step, last = None, [], 0, -1
    while step < shards or step <= last + shards:
        sent = _sent(spark, tables)
        scan = _scan(own.where(F.col("part") % shards == step % shards).select("lang", "text"), step, shards, longest,
                     sent, seed, bits)
        if still is not None:
            scan = scan.unionByName(spark.read.schema(_STATE_SQL).parquet(still).where("kind = 'open'")
                                    .drop("reached", "kind"))
        at = scratch_dir(spark, f"scan{step}")
        (scan.groupBy("bucket").applyInArrow(_merged(step, shards, longest, min_count), _STATE_SQL)
         .write.partitionBy("kind").parquet(at))
        sent.destroy()
        if still is not None:
            dropped(spark, f"{still}/kind=open")
        still = at
        state = spark.read.schema(_STATE_SQL).parquet(at)
        closed.append(state.where("kind = 'closed'"))
        for length, bitmap in _marked(state.select(F.explode("reached").alias("r")).select("r.*"), FILTER).items():
            on = np.unpackbits(bitmap, bitorder="little")[:1 << FILTER] != 0
            tables[length - 1][on & (tables[length - 1] == _NEVER)] = step
            last = step
        step += 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys, tags, counts = _unpacked(r)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array((tags & 7).astype(np.int32)),
                                                  pa.array(counts)], ["key", "length", "count"])

    found = reduce(DataFrame.unionByName, closed).select("n", "keys", "tags", "counts")
    found = written(found.mapInArrow(rows, "key long, length int, count long"), "counts")
    texts, missing, seen = [], found, 0
    while seen < PARTS * shards:                             # most phrases stand in the first part already
        upto = min(PARTS * shards, max(1, 4 * seen))
        marked = _marked(missing, KEPT)
        wanted = _sent(spark, [marked.get(n, np.zeros(1 << KEPT - 3, np.uint8)) for n in range(1, longest + 1)])
        part = own.where((F.col("part") >= seen) & (F.col("part") < upto)).select("lang", "text")
        texts.append(written(_read_back(part, wanted, longest, seed), "phrases"))
        wanted.destroy()
        missing, seen = missing.join(texts[-1].where("key IS NOT NULL").select("key").distinct(), "key", "left_anti"), upto
    texts = reduce(DataFrame.unionByName, texts)
    named = (texts.where("key IS NOT NULL").groupBy("key")
             .agg(F.min(F.struct("lang", "phrase")).alias("low"), F.max(F.struct("lang", "phrase")).alias("high")))
    one = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
        F.raise_error(F.lit("two phrases share a hash: choose another seed")))
    phrases = found.join(named, "key").withColumn("one", one).select(
        F.col("one.lang").alias("lang"), F.col("one.phrase").alias("phrase"), "length", "count")
    return written(phrases, "frequent"), texts.where("words IS NOT NULL").groupBy("lang").agg(F.sum("words").alias("n"))


def collocations(docs: DataFrame, min_count: int = 10, longest: int = 3, top: int = 2000, covered: int = 50,
                 **options) -> DataFrame:
    """Per lang the ``top`` phrases of 2 to ``longest`` words by their weakest cut: lang, rank, phrase, a, l, r, n, score.

    The score of a cut is floor(1000000 * a * a / (l * r)).  A phrase that stands inside a longer one with at least
    ``covered`` percent of its count is left out.
    """
    phrases, sizes = frequent_phrases(docs, min_count, longest, **options)
    longer = phrases.where("length > 1").withColumnRenamed("count", "a")
    words = F.split("phrase", " ")

    def part(begin, size):
        return F.array_join(F.slice(words, begin, size), " ")

    inner = F.explode(F.expr("flatten(transform(sequence(2, length - 1), m -> transform(sequence(1, length - m + 1), "
                             "i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"))
    inside = (longer.where("length > 2").select("lang", inner.alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    kept = (longer.join(inside, ["lang", "phrase"], "left")
            .where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most"))
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, length - 1)"))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"),
        part(F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    counts = phrases.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l"))
    cuts = (cuts.join(counts, ["lang", "head"])
            .join(counts.withColumnRenamed("head", "rest").withColumnRenamed("l", "r"), ["lang", "rest"]))
    wide = [F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")]
    cuts = cuts.withColumns({"_a": wide[0], "_l": wide[1], "_r": wide[2]}).withColumn(
        "score", F.expr("(1000000 * (_a * _a)) div (_l * _r)"))
    weakest = (cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
               .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

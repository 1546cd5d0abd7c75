"""N-gram Jaccard join: exact links between shingle sets, their number per document, and their components.

Two documents link when the Jaccard similarity of their sets of five-word
shingles is at least ``threshold`` (a ratio of integers).  Equal sets are one
class, named by a digest of it, and classes are joined by prefix lists:
a class is listed under its rarest shingles, as many as two linked sets cannot
both miss.  A list entry holds the set's size n and its position p, which bound
the size of a partner that can still reach the threshold through this entry:
at most (5 n - 9 p) / 4 at 0.8.

Block skipping.  The entries of a list are cut into blocks by size and
position (and by a hash where one shingle is very common), and a pair of
blocks is skipped when the bounds of the one rule out every size of the other,
or, where only components are asked for, when both lie in one component.

Answers from similar sets.  The entry with the widest bound leads its block.
Bitmaps of the sets rule out most pairs; of the rest,
every member is checked against its leader first.  A member that links shares the
leader's component, and where only components are asked for, pairs inside one need
no check.  Where every link is, members that link with the same leader (its kin) are held
as their differences from it, and the overlap of two of them is that of the leader with
both, corrected by what their differences share: exact, without the sets.  Their links are
counted block against block of a kin, so that no pair of members is a row, and lists that
hold one kin only are left out.  For the rest
the overlaps with a common leader bound the overlap of the pair: it is at most
min(o1, o2) + min(n1 - o1, n2 - o2).  Only pairs that pass are compared, on
whole sets.  Where only components are asked for, a set goes with a guide that it links
with, itself if there is none, and lists hold guides: lists of the same guides are one.
Guides that meet are compared once, and members x, y of guides g, h overlap in at most
|g and h| + |x - g| + |y - h|, so most pairs of groups are ruled out without their members.

Cells.  Neither two entries of one list nor two members of two groups are a row of a join.  The
entries of a list, or the members of a group and of all smaller ones it may link with, lie
together in bounded cells with brief bitmaps, and only pairs that these leave open come out.

Edge cases: null and empty texts have no shingle and link with nothing; fewer than
five words are one shingle; repeated rows are one class; rows without an id link like
others, and a class or component of such rows alone has no id; long texts are read whole;
an empty table gives no rows.  Shingles
and whole sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import fits, written
from papyra.llm.words import chain, some_at_a_time, words_of
from papyra.session import bound_batches, cut_lineage

SHINGLE = 5
COMMON = 16            # a shingle counts as common from so many sets within one block of shingles
COUNT_BLOCK = 1 << 20  # shingles counted together
MAX_BROADCAST_IDS = 1 << 20      # 8 bytes each; more are joined by shuffle
LIST_BLOCK = 4096      # common lists are dealt by hash into blocks of about so many entries
KIN_BLOCK = 512        # sets of one kin in a block, about
KIN_LENGTH = 1 << 20   # and hashes in all their differences
DENSE = 16             # shingles in so many differences of a cell are counted by a matrix product
COLUMNS = 1 << 9       # so many of them at a time
ROWS = 1 << 6          # sets of a cell whose links are counted at a time
MET = 1 << 13          # list entries, or sets open to one group, that meet in a task's cells, about
STRIP = 1 << 16        # pairs whose bitmaps are held against each other at a time
BRIEF = 8              # 64-bit words of a bitmap that goes with a list entry, at most


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its five-word shingles, A-Z lower-cased."""
    for some in some_at_a_time(texts):
        words, ends = words_of(some)
        runs = np.full(max(0, len(words) - SHINGLE + 1), np.uint64(SHINGLE))
        for i in range(SHINGLE):
            runs = chain(runs, words[i:i + len(runs)])
        for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if end - begin >= SHINGLE:
                yield np.unique(runs[begin:end - SHINGLE + 1])
            else:                                    # all words as one shingle, or none
                short = np.full(min(1, end - begin), np.uint64(end - begin))
                for i in range(begin, end):
                    short = chain(short, words[i:i + 1])
                yield short


def shingle_set(text: str | None) -> np.ndarray:
    return next(shingle_sets([text]))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _class_of(s: np.ndarray) -> int:
    """64-bit digest of a set: the name of the class of all documents with this set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bitmap(s: np.ndarray) -> np.ndarray:
    """One bit per hash of the set as 64-bit words; the bits are a power of two, two to four for each hash."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    bits = np.zeros(size, np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, id, bits) of documents; rows without bits (null, count, shingle, null) are what is common in a block of sets."""
    held: list[np.ndarray] = []
    size = 0

    def common():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= COMMON
        return pa.RecordBatch.from_arrays([pa.nulls(int(keep.sum()), pa.int64()), pa.array(n[keep], pa.int64()),
                                           pa.array(_signed(h[keep])), pa.nulls(int(keep.sum()), pa.list_(pa.int64()))],
                                          ["doc_id", "n", "id", "bits"])

    for b in batches:
        n, names, maps = [], [], []
        for s in shingle_sets(b.column(1).to_pylist()):
            n.append(len(s))
            names.append(_class_of(s))
            maps.append(_bitmap(s))
            held.append(s)
            size += len(s)
            if size > COUNT_BLOCK:
                yield common()
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.int64()),
                                          pa.array(maps, pa.list_(pa.int64()))], ["doc_id", "n", "id", "bits"])
    if held:
        yield common()


def _set_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets with their class; mostly once per class and task, and a set twice does no harm."""
    given: set[int] = set()
    for b in batches:
        if len(given) > COUNT_BLOCK:
            given.clear()
        sets = {_class_of(s): s for s in shingle_sets(b.column(0).to_pylist())}
        fresh = [k for k in sets if k not in given]
        given.update(fresh)
        yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.int64()),
                                          pa.array([_signed(sets[k]) for k in fresh], pa.list_(pa.int64()))],
                                         ["id", "items"])


def common_shingles(counted: DataFrame, limit: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the common shingles, the ``limit`` most frequent at most.

    They only order the prefixes and size the blocks: any order gives the same links.
    """
    found = (counted.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(limit).toArrow()
             .sort_by("id"))
    return found["id"].to_numpy(), found["n"].to_numpy()


def _ceil_div(a, b: int):
    return -(-a // b)


def _entries(hot: tuple[np.ndarray, np.ndarray], num: int, den: int):
    """Prefix entries of each set: shingle, salt, class, size, position; mostly once per class and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = hot
        listed: set[int] = set()
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            if len(listed) > COUNT_BLOCK:
                listed.clear()
            for s in shingle_sets(b.column(0).to_pylist()):
                n, name = len(s), _class_of(s)
                if not n or name in listed:
                    continue
                listed.add(name)
                s = _signed(s)
                at = np.minimum(np.searchsorted(keys, s), max(len(keys) - 1, 0))
                often = np.where(keys[at] == s, counts[at], 0) if len(keys) else np.zeros(n, np.int64)
                length = n - _ceil_div(n * num, den) + 1
                first = np.lexsort((s, often))[:length]
                salts = often[first] // LIST_BLOCK + 1
                cols[0].append(s[first])
                cols[1].append(np.where(salts > 1, 1 + (name >> 8) % salts, 0))      # 0: the whole list is one block
                cols[2].append(np.full(length, name))
                cols[3].append(np.full(length, n))
                cols[4].append(np.arange(length))
            kinds = [np.int64, np.int32, np.int64, np.int32, np.int32]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, k), *c]).astype(k)) for c, k in zip(cols, kinds, strict=True)],
                ["h", "salt", "id", "n", "p"])

    return run


def _widest(n: Column, p: Column, num: int, den: int) -> Column:
    """Largest partner size m with num (n + m) <= (num + den) (n - p), so that the rest of the set can overlap enough."""
    return F.floor(((num + den) * (n - p) - num * n) / num)


def _need(n: Column, m: Column, num: int, den: int) -> Column:
    """Smallest overlap of linked sets of sizes n and m."""
    return F.ceil(num * (n + m) / (num + den))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): smallest id reachable over links (a, b); nodes without links are their own root.

    Each round hooks every root to its smallest neighbour root, shortens the chains
    by pointer doubling and keeps the links between different roots.
    """
    edges = written(links.where("a <> b").distinct(), "edges")
    labels = nodes.withColumn("root", F.col("id"))
    while not edges.isEmpty():
        hooks = written(edges.union(edges.select("b", "a")).groupBy("a")
                        .agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")), "hooks")
        for _ in range(3):                       # a hook may now skip up to eight steps of its chain
            hooks = hooks.join(hooks.select(F.col("a").alias("to"), F.col("to").alias("up")), "to").select(
                "a", F.col("up").alias("to"))
        hooks = written(hooks, "hooks")
        ends = [hooks.select(F.col("a").alias(c), F.col("to").alias(f"r{c}")) for c in "ab"]
        edges = written(edges.join(ends[0], "a").join(ends[1], "b").where("ra <> rb")
                        .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        labels = (labels.join(hooks.select(F.col("a").alias("root"), F.col("to").alias("_to")), "root", "left")
                  .withColumn("root", F.coalesce("_to", "root")).drop("_to"))
    return labels.select(*nodes.columns, "root")


def _possible(pairs: DataFrame, maps: DataFrame, num: int, den: int, small: str = "n", slack: str = "0") -> DataFrame:
    """Pairs (a, b) that the bitmaps leave open: a bit of one set that the other lacks is a shingle it lacks.

    For groups of sets around a and b, ``small`` is the size of the smallest set of a group and ``slack`` the
    most shingles that one of them has beyond a or b.
    """
    sides = [maps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"m{c}"),
                         F.expr(small).alias(f"l{c}"), F.expr(slack).alias(f"s{c}")) for c in "ab"]

    def folded(x: str, y: str) -> Column:        # half as many bits: each word with the one half the map further on
        half = F.expr(f"size({x}) div 2")
        both = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))
        return F.when(F.size(x) > F.size(y), both).otherwise(F.col(x))

    def lacking(x: str, y: str) -> Column:       # maps that differ in size after one fold tell nothing
        count = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0),
                            lambda s, v: s + v)
        return F.coalesce(count, F.lit(0))

    met = pairs.join(sides[0], "a").join(sides[1], "b").withColumns({"fa": folded("ma", "mb"), "fb": folded("mb", "ma")})
    most = F.least(F.col("na") - lacking("fa", "fb"), F.col("nb") - lacking("fb", "fa"))
    return met.where(most + F.col("sa") + F.col("sb") >= _need(F.col("la"), F.col("lb"), num, den)).select("a", "b")


def _brief(bits: str = "bits") -> Column:
    """The bitmap folded to ``BRIEF`` words at most: long sets do not move theirs with each of their entries."""
    return F.expr(f"IF(size({bits}) <= {BRIEF}, {bits}, aggregate(sequence(1, size({bits}) div {BRIEF}), array_repeat(0L, {BRIEF}), "
                  f"(x, i) -> zip_with(x, slice({bits}, {BRIEF} * (i - 1) + 1, {BRIEF}), (p, q) -> p | q)))")


def _words(bits: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brief bitmaps as rows of words, the same folded to half their size, and their sizes."""
    size = np.diff(bits.offsets.to_numpy())
    whole = np.zeros((len(size), BRIEF), np.uint64)
    whole[np.arange(BRIEF) < size[:, None]] = bits.flatten().to_numpy().view(np.uint64)
    half = whole.copy()
    for k in np.unique(size[size > 1]):
        of = size == k
        half[of] = 0
        half[of, :k // 2] = whole[of, :k // 2] | whole[of, k // 2:k]
    return whole, half, size


def _left_open(maps: tuple[np.ndarray, np.ndarray, np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs (i, j) the bitmaps leave open, as in ``_possible``."""
    whole, half, size = maps
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), STRIP):
        a, b = i[at:at + STRIP], j[at:at + STRIP]
        x = np.where((size[a] > size[b])[:, None], half[a], whole[a])
        y = np.where((size[b] > size[a])[:, None], half[b], whole[b])
        known = np.maximum(size[a], size[b]) <= 2 * np.minimum(size[a], size[b])     # others are not of one size after a fold
        most = np.minimum(n[a] - known * np.bitwise_count(x & ~y).sum(1, dtype=np.int64),
                          n[b] - known * np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
        out[at:at + STRIP] = (num + den) * most >= num * (n[a] + n[b])
    return out


def _pair_table(ids: np.ndarray, i: list[np.ndarray], j: list[np.ndarray]) -> pa.Table:
    a, b = (ids[np.concatenate([np.empty(0, np.int64), *x])] for x in (i, j))
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.table({"a": found[0], "b": found[1]})


def _list_cells(num: int, den: int):
    """Group: the open pairs of the entries of some cells, each a list, a block of one, or two blocks: no other pair is a row."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("low", "ascending"), ("high", "ascending")])
        h, low, high, block, ids, n, wide, root, guide, o = [
            table[c].to_numpy() for c in ("h", "low", "high", "block", "id", "n", "wide", "root", "guide", "o")]
        n, o, maps = n.astype(np.int64), o.astype(np.int64), _words(table["bits"].combine_chunks())
        cell = np.cumsum(np.concatenate(([0], (np.diff(h) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0))))
        found: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        live, step = np.arange(len(h)), 1
        while True:                              # each entry and the one so many steps after it, while in one cell
            live = live[:np.searchsorted(live, len(h) - step)]
            live = live[cell[live + step] == cell[live]]
            if not len(live):
                return _pair_table(ids, *found)
            i, j = live, live + step
            met = (root[i] != root[j]) & (n[j] <= wide[i]) & (n[i] <= wide[j]) & ((low[i] == high[i]) | (block[i] != block[j]))
            i, j = i[met], j[met]
            most = np.minimum(o[i], o[j]) + np.minimum(n[i] - o[i], n[j] - o[j])
            met = (guide[i] != guide[j]) | ((num + den) * most >= num * (n[i] + n[j]))
            i, j = i[met], j[met]
            met = _left_open(maps, n, i, j, num, den)
            found[0].append(i[met])
            found[1].append(j[met])
            step += 1

    return run


def _group_cells(num: int, den: int):
    """Group: open pairs of the members of a group and those of other groups whose guides overlap with its guide by ``overlap``."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, n, slack, lead, overlap = [table[c].to_numpy() for c in ("id", "n", "slack", "lead", "overlap")]
        n, maps = n.astype(np.int64), _words(table["bits"].combine_chunks())
        hosts, guests = np.flatnonzero(overlap < 0), np.flatnonzero(overlap >= 0)
        found: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        some = max(1, STRIP // max(1, len(hosts)))
        for at in range(0, len(guests), some):
            g = guests[at:at + some]
            met = ((num + den) * ((overlap[g] + slack[g])[:, None] + slack[hosts]) >= num * (n[g][:, None] + n[hosts])
                   ) & ~(lead[g][:, None] & lead[hosts])         # the guides were compared
            x, y = np.nonzero(met)
            i, j = g[x], hosts[y]
            met = _left_open(maps, n, i, j, num, den)
            found[0].append(i[met])
            found[1].append(j[met])
        return _pair_table(ids, *found)

    return run


def _compared(pairs: DataFrame, texts: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) -> a, b, na, nb, overlap, linked, from the whole sets of one document of each class; if linked, only_a and only_b."""
    wanted = cut_lineage(classes.select("id", F.col("class_id").alias("doc_id"))
                         .join(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id"))
    ids, unnamed = wanted.where("doc_id IS NOT NULL").select("doc_id"), wanted.where("doc_id IS NULL")

    def sets_of(chosen: DataFrame) -> DataFrame:
        return chosen.select("text").mapInArrow(_set_arrays, "id long, items array<long>").join(wanted, "id", "left_semi")

    sets = sets_of(texts.join(F.broadcast(ids) if fits(ids, MAX_BROADCAST_IDS) else ids, "doc_id", "left_semi"))
    if not unnamed.isEmpty():                    # classes of rows without an id: found by their sets
        nameless = sets_of(texts.where("doc_id IS NULL")).join(unnamed, "id", "left_semi")
        sets = sets.union(nameless.groupBy("id").agg(F.first("items").alias("items")))
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", "ia", "ib", F.size("ia").alias("na"), F.size("ib").alias("nb"),
                    F.size(F.array_intersect("ia", "ib")).alias("overlap"))
            .withColumn("linked", F.col("overlap") >= _need(F.col("na"), F.col("nb"), num, den))
            .select("a", "b", "na", "nb", "overlap", "linked", F.when(F.col("linked"), F.array_except("ia", "ib")).alias("only_a"),
                    F.when(F.col("linked"), F.array_except("ib", "ia")).alias("only_b")))


def _kin(answers: DataFrame, classes: DataFrame) -> DataFrame:
    """id, n, copies, kin, past, less, diff: each linked set as its difference from one leader that it links with.

    The kin of a set is the leader that most sets link with, of those it links with and itself.  ``diff`` holds
    what only one of the two has, ``past`` of them are the set's own, ``less`` are the leader's.
    """
    linked, none = answers.where("linked"), F.array().cast("array<long>")
    seen = (linked.select(F.col("a").alias("id"), F.col("b").alias("kin"), F.col("only_b").alias("gone"), F.col("only_a").alias("new"))
            .union(linked.select("b", "a", "only_a", "only_b"))
            .union(linked.select("a").union(linked.select("b")).distinct().select("a", F.col("a").alias("kin"), none, none)))
    weight = seen.groupBy("kin").agg(F.count(F.lit(1)).alias("w"))
    return cut_lineage(seen.join(weight, "kin").groupBy("id")
                       .agg(F.max_by(F.struct("kin", "gone", "new"), F.struct("w", "kin")).alias("x"))
                       .join(classes.select("id", "n", "copies"), "id")
                       .select("id", "n", "copies", "x.kin", F.size("x.new").alias("past"), F.size("x.gone").alias("less"),
                               F.concat("x.gone", "x.new").alias("diff")))


def _shared(rows: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """(k, k) numbers of codes that two rows share, from (row, code) incidences; the diagonal is not filled."""
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    _, at, often = np.unique(codes, return_inverse=True, return_counts=True)
    out = np.zeros((k, k), np.float32)
    wide = often >= DENSE
    column = np.cumsum(wide) - 1
    dense = wide[at]
    r, c = rows[dense], column[at[dense]]
    for begin in range(0, int(wide.sum()), COLUMNS):
        here = slice(*np.searchsorted(c, [begin, begin + COLUMNS]))
        part = np.zeros((k, COLUMNS), np.float32)
        part[r[here], c[here] - begin] = 1
        out += part @ part.T
    r, c = rows[~dense], codes[~dense]
    for step in range(1, DENSE - 1):             # a code of few rows: each of them with those after it
        same = np.flatnonzero(c[step:] == c[:-step]) if len(c) > step else np.empty(0, np.int64)
        if not len(same):
            break
        met = np.bincount(r[same] * k + r[same + step], minlength=k * k).reshape(k, k).astype(np.float32)
        out += met + met.T
    return out


def _kin_cell(num: int, den: int, pairs: bool):
    """Links among the sets of one cell: two blocks of the sets of one kin, or one block with itself."""
    def run(key: tuple, cell: pa.Table) -> pa.Table:
        one = key[1].as_py() == key[2].as_py()
        ids, n, copies, past, less, block = [cell.column(c).to_numpy() for c in ("id", "n", "copies", "past", "less", "block")]
        diff = cell.column("diff").combine_chunks()
        rows = np.repeat(np.arange(len(ids)), np.diff(diff.offsets.to_numpy()))
        shared = _shared(rows, diff.flatten().to_numpy(), len(ids))
        found: list[pa.Table] = []
        for at in range(0, len(ids), ROWS):      # some rows of the matrix at a time
            x = slice(at, at + ROWS)
            overlap = shared[x] + (n - past)[x, None] - less
            linked = ((num + den) * overlap >= num * (n[x, None] + n)) & (ids[x, None] != ids)
            if not one:
                linked &= block[x, None] != block
            if pairs:
                a, b = np.nonzero(np.triu(linked, at))
                a += at
                found.append(pa.table({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])}))
            else:
                weight = linked @ copies
                found.append(pa.table({"id": ids[x][weight > 0], "linked": weight[weight > 0]}))
        return pa.concat_tables(found)

    return run


def _among_kin(kin: DataFrame, num: int, den: int, pairs: bool) -> DataFrame:
    """Links between sets of one kin: (a, b), or for each set the number of rows it links with, (id, linked), in parts.

    The sets of a kin are dealt by hash into blocks, by number and by the length of their differences, and a task
    takes two blocks: no pair is a row, and no task holds a whole kin.
    """
    sizes = kin.groupBy("kin").agg(F.count(F.lit(1)).alias("k"), F.sum(F.size("diff")).alias("long")).where("k > 1")
    blocks = F.greatest(F.ceil(F.col("k") / KIN_BLOCK), F.ceil(F.col("long") / KIN_LENGTH)).cast("int")
    dealt = (kin.join(sizes.select("kin", blocks.alias("blocks")), "kin")
             .withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("kin", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     "block", "id", "n", "copies", "past", "less", "diff"))
    return dealt.groupBy("kin", "low", "high").applyInArrow(
        _kin_cell(num, den, pairs), "a long, b long" if pairs else "id long, linked long")


_GROUP = ("id", "n", "wide", "root", "small", "slack", "lead", "o", "past")


def _open(num: int, den: int) -> Column:
    """Groups that differ in root, are in reach of each other and are left open by a leader that both guides were compared with."""
    most = F.least("o", "o_2") + F.least("past", "past_2") + F.col("slack") + F.col("slack_2")
    led = F.coalesce((F.col("lead") == F.col("lead_2")) & (most < _need(F.col("small"), F.col("small_2"), num, den)), F.lit(False))
    return F.expr("root <> root_2 AND n_2 <= wide AND n <= wide_2") & ~led


def _between_groups(listed: DataFrame, first: DataFrame, answers: DataFrame, texts: DataFrame, classes: DataFrame,
                    maps: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets of different components, as many as the components need.

    Sets go in groups by a guide that they link with.  Lists hold groups, and guides are compared for their members.
    """
    linked = answers.where("linked")
    seen = (linked.select(F.col("a").alias("id"), F.col("b").alias("guide"), "overlap")
            .union(linked.select("b", "a", "overlap")).union(maps.select("id", "id", "n")))
    weight = seen.groupBy("guide").agg(F.count(F.lit(1)).alias("w"))
    members = written(seen.join(weight, "guide").groupBy("id")
                      .agg(F.max_by(F.struct("guide", "overlap"), F.struct("w", "guide")).alias("x"))
                      .join(maps.select("id", "n"), "id").join(first, "id")
                      .select("id", "n", "root", F.col("x.guide").alias("guide"),
                              (F.col("n") - F.col("x.overlap")).alias("slack")), "members")
    groups = written(members.groupBy("guide").agg(F.min("n").alias("small"), F.max("slack").alias("slack"),
                                                  F.min("root").alias("root"), F.count(F.lit(1)).alias("size"))
                     .withColumnRenamed("guide", "id").join(maps, "id"), "groups")
    # the leader that most were compared with, of those a guide was compared with, itself included
    compared = (answers.select(F.col("a").alias("id"), F.col("b").alias("lead"), F.col("overlap").alias("o"))
                .union(answers.select("b", "a", "overlap")).union(maps.select("id", "id", "n")))
    weight = compared.groupBy("lead").agg(F.count(F.lit(1)).alias("w"))
    leads = (compared.join(groups.select("id", "n", "small", "slack"), "id").join(weight, "lead").groupBy("id", "n", "small", "slack")
             .agg(F.max_by(F.struct("lead", "o"), F.struct("w", "lead")).alias("x"))
             .select("id", "small", "slack", "x.lead", "x.o", (F.col("n") - F.col("x.o")).alias("past")))
    # lists of groups; one whose groups lie in one component has nothing left to find
    rows = (listed.join(members.select("id", "guide", "root"), "id")
            .groupBy("h", F.when(F.col("split"), F.col("block")).alias("block"), F.col("guide").alias("id"))
            .agg(F.min("n").alias("n"), F.max("wide").alias("wide"), F.min("root").alias("root")))
    rows = written(rows.join(leads, "id"), "lists")
    told = (rows.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("block").alias("parts"),
                                  F.bit_xor(F.xxhash64("id")).alias("x"), F.count(F.lit(1)).alias("k"))
            .where("r0 <> r1").select("h", "parts", F.struct("k", "x").alias("same")))
    rows = written(rows.join(told, "h"), "mixed")
    # unsplit lists of the same groups meet once, with the widest of their bounds
    whole = (rows.where("parts IS NULL").groupBy("same", "id")
             .agg(F.min("n").alias("n"), F.max("wide").alias("wide"),
                  *[F.first(c).alias(c) for c in _GROUP[3:]]))
    # a split list meets itself block by block, but for the pairs of blocks that bounds or components rule out
    parts = rows.where("parts IS NOT NULL").withColumn("block", F.coalesce("block", F.lit(0)))
    stats = parts.groupBy("h", "block").agg(F.min("n").alias("n"), F.max("wide").alias("wide"),
                                            F.min("root").alias("r0"), F.max("root").alias("r1"))
    other = stats.select("h", *[F.col(c).alias(f"{c}_2") for c in ("block", "n", "wide", "r0", "r1")])
    cells = (stats.join(other, "h").where("block <= block_2 AND n_2 <= wide AND n <= wide_2 "
                                          "AND NOT (r0 = r1 AND r0_2 = r1_2 AND r0 = r0_2)")
             .select("h", "block", "block_2"))
    two = parts.select("h", *[F.col(c).alias(f"{c}_2") for c in ("block", *_GROUP)])
    within = (parts.join(cells, ["h", "block"]).join(two, ["h", "block_2"]).where(_open(num, den))
              .select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")))
    met = (whole.join(whole.select("same", *[F.col(c).alias(f"{c}_2") for c in _GROUP]), "same")
           .where(F.expr("id < id_2") & _open(num, den)).select(F.col("id").alias("a"), F.col("id_2").alias("b")))
    open_groups = cut_lineage(_possible(met.union(within).distinct(), groups, num, den, "small", "slack"))
    compared = cut_lineage(_compared(open_groups, texts, classes, num, den).select("a", "b", "overlap", "linked"))
    links = compared.where("linked").select("a", "b")
    # groups that the links of their guides leave apart and whose members the overlap of the guides leaves open
    ends = [members.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    joined = links.join(ends[0], "a").join(ends[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    roots = written(components(joined, members.select(F.col("root").alias("id")).distinct()), "roots")
    sides = [groups.select(F.col("id").alias(c), F.col("small").alias(f"l{c}"), F.col("slack").alias(f"s{c}"),
                           F.struct("size", "id").alias(f"w{c}"), "root")
             .join(roots.select(F.col("id").alias("root"), F.col("root").alias(f"r{c}")), "root").drop("root") for c in "ab"]
    rest = (compared.where("NOT linked").join(sides[0], "a").join(sides[1], "b")
            .where(F.col("ra") != F.col("rb"))
            .where(F.col("overlap") + F.col("sa") + F.col("sb") >= _need(F.col("la"), F.col("lb"), num, den))
            .select(*[F.when(F.col("wa") > F.col("wb"), F.col(x)).otherwise(F.col(y)).alias(c) for c, x, y in (
                ("host", "a", "b"), ("guide", "b", "a"), ("least", "la", "lb"), ("more", "sa", "sb"))], "overlap"))
    # the larger group is the host: its members meet the members of all smaller ones, block against block
    entries = ["id", "n", F.col("slack").cast("long").alias("slack"), (F.col("id") == F.col("guide")).alias("lead")]
    guests = written(rest.join(members, "guide")
                     .where(F.col("overlap") + F.col("slack") + F.col("more") >= _need(F.col("n"), F.col("least"), num, den))
                     .select("host", *entries, F.col("overlap").cast("long").alias("overlap")), "guests")
    dealt = (guests.groupBy(F.col("host").alias("id")).agg(F.ceil(F.count(F.lit(1)) / MET).cast("int").alias("guests"))
             .join(groups.select("id", F.ceil(F.col("size") / KIN_BLOCK).cast("int").alias("hosts")), "id")
             .withColumnRenamed("id", "host"))
    hosts = members.withColumn("host", F.col("guide")).select("host", *entries, F.lit(-1).cast("long").alias("overlap"))
    rows = [x.join(dealt, "host").withColumn(own, F.pmod(F.xxhash64("id"), own).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("host", "hosts", "guests", *x.columns[1:])
            for x, own, other in ((hosts, "hosts", "guests"), (guests, "guests", "hosts"))]
    inner = (rows[0].union(rows[1]).join(maps.select("id", _brief().alias("bits")), "id")
             .groupBy("host", "hosts", "guests").applyInArrow(_group_cells(num, den), "a long, b long"))
    inner = cut_lineage(_possible(inner, maps, num, den))
    late = _compared(inner, texts, classes, num, den).where("linked").select("a", "b")
    return links.union(cut_lineage(late))


def _inside(listed: DataFrame, kin: DataFrame, answers: DataFrame, pairs: DataFrame, texts: DataFrame, classes: DataFrame,
            maps: DataFrame, num: int, den: int) -> DataFrame:
    """Every link (a, b) between sets of different kin that the first answers do not hold."""
    # the rest: pairs of entries of different kin that no bound rules out
    seen = (answers.select(F.col("a").alias("id"), F.col("b").alias("guide"), "overlap")
            .union(answers.select("b", "a", "overlap"))
            .union(answers.select("a", "a", "na")).union(answers.select("b", "b", "nb")))
    # the guide is the most often compared set among those a set was compared with, itself included
    weight = F.count(F.lit(1)).over(Window.partitionBy("guide"))
    best = (seen.distinct().withColumn("w", weight).groupBy("id")
            .agg(F.max_by(F.struct("guide", "overlap"), F.struct("w", "guide")).alias("x"))
            .select("id", F.col("x.guide").alias("guide"), F.col("x.overlap").alias("o")))
    rest = written(listed.join(kin.select("id", F.col("kin").alias("root")), "id", "left")
                   .withColumn("root", F.coalesce("root", "id")).join(best, "id", "left")
                   .withColumns({"guide": F.coalesce("guide", "id"), "o": F.coalesce("o", "n")})
                   .join(maps.select("id", _brief().alias("bits")), "id")
                   .select("h", "split", "block", "id", "n", "wide", "root", "guide", "o", "bits"), "rest")
    mixed = (rest.groupBy("h").agg(F.min("root").alias("m0"), F.max("root").alias("m1"), F.min("n").alias("s0"),
                                   F.max("wide").alias("w0")).where("m0 <> m1").select("h", "s0", "w0"))
    rest = written(rest.join(mixed, "h").where("s0 <= wide AND n <= w0").drop("s0", "w0"), "mixed")
    # a split list meets itself block by block, but for the pairs of blocks that bounds or kin rule out
    stats = (rest.where("split").groupBy("h", "block")
             .agg(F.min("n").alias("small"), F.max("wide").alias("reach"), F.min("root").alias("r0"),
                  F.max("root").alias("r1")))
    other = stats.select("h", *[F.col(c).alias(f"{c}_2") for c in ("block", "small", "reach", "r0", "r1")])
    cells = (stats.join(other, "h").where("block <= block_2 AND small_2 <= reach AND small <= reach_2 "
                                          "AND NOT (r0 = r1 AND r0_2 = r1_2 AND r0 = r0_2)")
             .select("h", "block", "block_2"))
    cells = cells.select("h", F.explode(F.array_distinct(F.array("block", "block_2"))).alias("block"),
                         F.col("block").alias("low"), F.col("block_2").alias("high"))
    met = [rest.where("split").join(cells, ["h", "block"]),
           rest.where("NOT split").withColumns({c: F.lit(0) for c in ("block", "low", "high")})]
    met = met[0].unionByName(met[1]).drop("split")
    parts = F.lit(1 + rest.count() // MET)
    open_pairs = (met.withColumn("part", F.pmod(F.xxhash64("h", "low", "high"), parts)).groupBy("part")
                  .applyInArrow(_list_cells(num, den), "a long, b long").distinct())
    open_pairs = open_pairs.join(pairs, ["a", "b"], "left_anti")
    fresh = cut_lineage(_possible(open_pairs, maps, num, den))
    late = cut_lineage(_compared(fresh, texts, classes, num, den).select("a", "b", "linked"))
    return late.where("linked").select("a", "b")


def jaccard_components(docs: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set) and component_id of every document that has an id.

    Rows without one link like the others, but no row here can name them; ``jaccard_join`` returns them too.
    """
    return _joined(docs, num, den, id_col, text_col, "")[0].where("doc_id IS NOT NULL")


def jaccard_join(docs: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The columns of ``jaccard_components`` and n_links: the other rows that the document links with, those of its class too."""
    return _joined(docs, num, den, id_col, text_col, "count")[0]


def jaccard_links(docs: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(class_a, class_b): every link between classes of equal sets, once, by the smallest ids of the classes.

    A class of rows without an id has none: null, in ``class_a`` if only one of the two has none.
    """
    _, classes, links = _joined(docs, num, den, id_col, text_col, "list")
    ends = [classes.select(F.col("id").alias(c), F.col("class_id").alias(f"class_{c}")) for c in "ab"]
    return (links.join(ends[0], "a").join(ends[1], "b")
            .select(F.when(F.col("class_a").isNotNull() & F.col("class_b").isNotNull(), F.least("class_a", "class_b")).alias("class_a"),
                    F.greatest("class_a", "class_b").alias("class_b")))


def _joined(docs: DataFrame, num: int, den: int, id_col: str, text_col: str,
            every: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, classes, and links (a, b) between classes: every one to "list"; to "count" those of one kin are counted only."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.col(f"`{text_col}`").alias("text"))
    rows = cut_lineage(texts.mapInArrow(_documents, "doc_id long, n long, id long, bits array<long>"))
    members, hot = rows.where("bits IS NOT NULL"), common_shingles(rows.where("bits IS NULL"))
    classes = written(members.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"),
                                                               F.first("bits").alias("bits"),
                                                               F.count(F.lit(1)).alias("copies")), "classes")
    members = members.select("doc_id", "n", "id")

    entries = texts.select("text").mapInArrow(_entries(hot, num, den), "h long, salt int, id long, n int, p int")
    # a list that is not split must hold two classes to matter
    one_list = Window.partitionBy("h", "salt")
    listed = (entries.withColumns({"_lo": F.min("id").over(one_list), "_hi": F.max("id").over(one_list)})
              .where("salt > 0 OR _lo <> _hi").withColumn("wide", _widest(F.col("n"), F.col("p"), num, den).cast("int")))
    # blocks by size step and by whether the entry can still reach its own size
    block = F.hash("salt", F.floor(F.log("n") / F.log(F.lit(1.25))), F.col("wide") >= F.col("n"))
    listed = listed.select("h", "salt", block.alias("block"), "id", "n", "wide").distinct()
    # the leader of each block and of each list: rows of a list lie together already, so none moves again
    widest = F.struct("wide", "id", "n")
    listed = listed.withColumns({"head": F.max(widest).over(Window.partitionBy("h", "salt", "block")),
                                 "top": F.max(widest).over(one_list)})
    listed = written(listed.withColumn("split", F.col("salt") > 0), "listed")

    # first answers: every entry against the leader of its block, block leaders against the list's, and these
    # against each other where a list is split
    parts = listed.where("split").groupBy("h", "salt").agg(F.max("top").alias("head"))
    tops = parts.groupBy("h").agg(F.max("head").alias("top"))
    of_head = [F.col("head.id").alias("id"), F.col("head.n").alias("n"), F.col("head.wide").alias("wide"), "top"]
    starts = (listed.select("id", "n", "wide", F.col("head").alias("top")).union(listed.select(*of_head))
              .union(parts.join(tops, "h").select(*of_head)))
    pairs = (starts.where("id <> top.id AND top.n <= wide AND n <= top.wide")
             .select(F.least("id", "top.id").alias("a"), F.greatest("id", "top.id").alias("b")).distinct())
    listed = listed.drop("salt", "head", "top")
    active = cut_lineage(listed.select("id").distinct())
    maps = classes.join(active, "id", "left_semi").select("id", "n", "bits")
    pairs = cut_lineage(_possible(pairs, maps, num, den))
    answers = cut_lineage(_compared(pairs, texts, classes, num, den))
    links = answers.where("linked").select("a", "b")
    if every:
        kin = _kin(answers, classes)
        late = _inside(listed, kin, answers, pairs, texts, classes, maps, num, den)
        final = components(links.union(late), active)
        ends = [kin.select(F.col("id").alias(c), F.col("kin").alias(f"k{c}")) for c in "ab"]
        links = links.join(ends[0], "a").join(ends[1], "b").where("ka <> kb").select("a", "b").union(late).distinct()
        if every == "list":
            links = links.union(_among_kin(kin, num, den, True))
    else:
        first = written(components(links, active), "components")
        more = _between_groups(listed, first, answers, texts, classes, maps, num, den)
        final = components(first.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more), active)
    classes = cut_lineage(classes.select("id", "class_id", "copies").join(final, "id", "left")
                          .withColumn("root", F.coalesce("root", "id")))
    whole = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = classes.join(whole, "root").select("id", "class_id", "component_id", "copies")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
               F.coalesce("component_id", "doc_id").alias("component_id")]
    if every:
        size = classes.select(F.col("id").alias("b"), "copies")
        degree = (links.union(links.select("b", "a")).join(size, "b").select(F.col("a").alias("id"), F.col("copies").alias("linked"))
                  .union(_among_kin(kin, num, den, False)).groupBy("id").agg(F.sum("linked").alias("linked")))
        named = named.join(degree, "id", "left")
        columns.append((F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return (members.withColumn("id", F.when(F.col("n") > 0, F.col("id"))).join(named, "id", "left").select(*columns),
            classes, links)

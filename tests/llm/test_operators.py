"""Corpus operators against brute force, and the defined results of their edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import (fingerprints, jaccard_join, langid, lm_scoring, mixing, packing, sharding, topk, toxicity,
                        url_filter)
from papyra.llm import queries as Q
from papyra.llm.common import read

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, copy string"
EDGES = [(1, None, "en", "a", 0, "x", "y"), (2, "", None, None, None, None, None), (3, "  \n\t", "en", "a", 4, None, None),
         (4, "one two three", "en", "b", 13, None, None), (5, "One  two\nthree", "en", "b", 14, None, None),
         (6, "idiot " * 3000, "en", "b", 18000, None, None), (6, "idiot " * 3000, "en", "b", 18000, None, None),
         (None, "no id at all here now", "fr", "a", 21, None, None), (9, "été à la plage <|endoftext|> 日本", "fr", "c", 9, None, None)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


def _documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in read(spark, SF, "documents").collect()}


def _shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_match_brute_force(spark):
    docs = _documents(spark)
    order = sorted(docs, reverse=True)
    rows = {r["doc_id"]: r for r in Q.op1_fingerprints(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    for i, d in enumerate(order):
        text, nxt = docs[d], docs[order[(i + 1) % len(order)]]
        third = len(text) // 3
        edited = text[:len(text) - third] + nxt[:third]
        assert rows[d]["n_chars"] == len(text)
        assert rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", nxt)):
            a, b = set(text.lower().split()) and _shingles(text.lower()), _shingles(other.lower())
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(rows[d][name] - true) < 0.25


def test_sketches_estimate_and_merge(spark):
    words = [f"w{i}" for i in range(3000)]
    df = fingerprints.with_sketch(spark.createDataFrame(
        [(1, " ".join(words)), (2, " ".join(words[:2000])), (3, "")], "k long, text string"))
    a, b, empty = (r["sketch"] for r in df.orderBy("k").collect())
    assert len(a) == len(b) == fingerprints.K and empty == []
    both = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    r = both.select(fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.containment(F.col("b"), F.col("a")),
                    fingerprints.distinct_shingles(F.col("a"))).first()
    assert abs(r[0] - 2 / 3) < 0.2 and r[1] > 0.8 and abs(r[2] / 2996 - 1) < 0.35
    parts = spark.createDataFrame([(1, " ".join(words[:1500])), (1, " ".join(words[1496:]))], "k long, text string")
    assert fingerprints.merge_sketches(fingerprints.with_sketch(parts), "k").first()["sketch"] == a


def _components(docs):
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, _shingles(t)) for d, t in docs.items()]
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def test_jaccard_components_match_brute_force(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op2_jaccard_join(spark, SF).collect()}
    assert got == _components(_documents(spark))


def test_jaccard_chains_of_near_copies(spark, monkeypatch):
    """Near copies of which the ends do not link, with common shingles, also when their lists are split."""
    words = [f"w{i}" for i in range(120)]
    docs = {k: " ".join(words[:100 - k] + [f"x{j}" for j in range(k)]) for k in range(0, 40)}
    docs |= {100 + k: " ".join([*words[:60], f"y{k}", *words[60:]]) for k in range(30)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    want = _components(docs)
    for block in (4096, 8):
        monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
        got = jaccard_join.jaccard_components(frame).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_sharding(spark):
    docs, rows = _documents(spark), Q.op4_rendezvous(spark, SF).collect()
    assert len(rows) == len(docs)
    slots: dict = {}
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
        assert r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])

        def draw(s, d=r["doc_id"]):
            u = (int(hashlib.md5(f"{d}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -np.log(u)
        assert r["shard"] == min(range(24), key=draw) and r["grown_shard"] == min(range(25), key=draw)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_block_pruning_is_exact_and_prunes():
    rng = np.random.default_rng(5)
    centres = rng.integers(-60, 60, (8, 16))
    rows = np.concatenate([c + rng.integers(-4, 5, (64, 16)) for c in centres])
    blocks = [(np.arange(i, i + 64), rows[i:i + 64]) for i in range(0, 512, 64)]
    most, least = (np.stack([f(r, axis=0) for _, r in blocks]) for f in (np.max, np.min))
    q = rows[::20]
    s, i, scored = topk.best_of(np.arange(0, 512, 20), q, blocks, most, least, 5)
    full = (q @ rows.T).astype(float)
    full[np.arange(len(q)), np.arange(0, 512, 20)] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(512), full.shape), -full), axis=1)[:, :5]
    assert (i == want).all() and (s == np.take_along_axis(full, want, 1)).all()
    assert scored < 0.7 * full.size


def test_topk_tells_rows_apart_that_share_an_id(spark, tmp_dir):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(-20, 70)]
    rows += [rows[20], rows[40], (0, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (None, [9.0, 9.0, 9.0]),
             (100, []), (101, []), (120, None), (121, [1.0, None, 2.0]), (122, [float("inf")] * 3), (140, [1e30])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_dir}/embeddings.parquet")
    held = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows
            if v is not None and None not in v and np.isfinite(v).all() and len(v) != 1]
    want = []
    for at, (q, v) in enumerate(held):
        if q is not None and q % 20 == 0:
            others = [(-int(v @ w), i is None, i) for n, (i, w) in enumerate(held) if n != at and len(w) == len(v)]
            want += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(others)[:20])]
    got = Q.op5_block_topk(spark, tmp_dir).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_packing_round_trip(spark, edges):
    from tokenizers import Tokenizer
    encoder = Tokenizer.from_file(packing.default_tokenizer()[0])
    docs = _documents(spark)
    rows = packing.pack_documents(read(spark, SF, "documents")).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d, text in docs.items():
        ids = np.array([*encoder.encode(text, add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]]
        assert sum(r["length"] for r in parts) == len(ids) and all(r["length"] == 1024 for r in parts[1:])
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in parts)
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in parts])
        assert [r["offset"] for r in parts] == [0, *ends[:-1]] and ends[-1] <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= 1.05 * total / 1024 + 2
    assert {r["doc_id"] for r in packing.pack_documents(edges).collect()} == {r[0] for r in EDGES}


def test_scores_match_brute_force(spark):
    from collections import Counter
    docs = {d: [*t.encode().lower().split(), b"\0end"] for d, t in _documents(spark).items()}
    count = Counter()
    for d, t in docs.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(t)
    n, v = sum(count.values()), len(count)
    for r in Q.op7_lm_scoring(spark, SF).collect():
        t = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(count[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * len(t)
        assert r["score"] <= 0


def test_filter_never_reads_low():
    h = lm_scoring.mix(np.arange(1, 2001, dtype=np.uint64))
    level = lm_scoring.levels(np.arange(1, 2001))
    bits = np.zeros(1 << 15, np.uint8)
    table = lm_scoring.Filter(bits, 1)
    for k in range(1, level.max() + 1):
        for p in table.places(h[level >= k], k, table.size):
            np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(int), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
    assert (table.levels(h) >= level).all() and (table.levels(h) > level).mean() < 0.1


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = [r for r in Q.op9_language_id(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.95
    toxic = {r["doc_id"]: r["toxic"] for r in read(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [r for r in Q.op10_toxicity(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in rows]) > 0.9


def test_chain_marginals_match_enumeration():
    import itertools
    m = toxicity.Field(emit=np.linspace(-1, 2, 19), trans=np.array([[0, -0.5], [0.3, 0.8]]), start=0.2)
    classes = [0, 0, 5, 0, 0, 0, 9, 3, 0]
    p = np.zeros(len(classes))
    for y in itertools.product((0, 1), repeat=len(classes)):
        z = np.exp(m.start * y[0] + sum(m.emit[c] * s for c, s in zip(classes, y)) + sum(m.trans[a, b] for a, b in zip(y, y[1:])))
        p += np.array([*y]) * z
        p[0:0] = 0
    total = sum(np.exp(m.start * y[0] + sum(m.emit[c] * s for c, s in zip(classes, y))
                       + sum(m.trans[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=9))
    hits = {i: c for i, c in enumerate(classes) if c}
    assert np.allclose(m.marginals(len(classes), hits), (p / total)[list(hits)])


def test_edges(spark, edges):
    got = {r["doc_id"]: r for r in fingerprints.with_edited(edges).collect()}
    assert got[1]["sketch"] == [] and got[None]["edited"] == "no id at all h"
    joined = jaccard_join.jaccard_components(edges).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in joined) == [
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (9, 2, 9)]
    assert sharding.shard_rows(edges, {0: 1.0, 1: 2.0}, (2, 1.0)).count() == len(EDGES)
    mixed = mixing.poisson_mix(edges, epochs=3.0)
    assert mixed.columns.count("copy") == 1 and set(EDGES[0][:1]) <= {r[0] for r in EDGES}
    langs = langid.predict_languages(edges, langid.learn_profiles(edges)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in langs}[3] == langid.UNKNOWN and len(langs) == len(EDGES)
    labels = spark.createDataFrame([(6, 1), (4, 0), (4, None), (77, 1)], "doc_id long, toxic int")
    tagged = toxicity.score_toxicity(edges, toxicity.learn_field(edges, labels))
    assert tagged.count() == len(EDGES) and tagged.where("score < 0 or score > 1 or score is null").count() == 0
    model, counts = lm_scoring.learn_model(edges)
    assert lm_scoring.score_texts(edges, model, counts).count() == len(EDGES)
    rules = spark.createDataFrame([("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x", "allow")],
                                  "host string, path string, verdict string")
    urls = [(None, "q"), ("", "q"), ("no scheme", "q"), ("http://b.A.org/xy?z", "q"), ("http://a.org", "q"),
            ("http://org/", "q"), ("http://borg/", "q")]
    judged = url_filter.judge_urls(spark.createDataFrame(urls, "url string, verdict string"), rules).collect()
    assert sorted((r["rule"] or "", r["verdict"]) for r in judged) == [("", "allow")] * 5 + [("a.org/x", "block"), ("org/", "allow")]


def test_empty_tables(spark, edges):
    none = edges.where("false")
    assert fingerprints.with_edited(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert sharding.shard_rows(none, {0: 1.0}, (1, 1.0)).count() == 0
    assert mixing.poisson_mix(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert langid.predict_languages(none, langid.learn_profiles(none)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(none, toxicity.learn_field(none, labels)).count() == 0
    model, counts = lm_scoring.learn_model(none)
    assert lm_scoring.score_texts(edges, model, counts).count() == len(EDGES)
    vectors = topk.quantised(spark.createDataFrame([(1, None), (None, [1.0]), (3, [float("nan")])],
                                                   "vec_id long, embedding array<float>"))
    assert topk.top_k(vectors, vectors).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    docs = read(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_filter_grows_and_reads_the_same_by_ranges(spark, edges, monkeypatch):
    from collections import Counter
    monkeypatch.setattr(lm_scoring, "RANGE_BYTES", 1 << 12)                  # many ranges and blocks
    docs = read(spark, SF, "documents").select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    columns = ("doc_id", "n_tokens", "n_known", "base_score", "score")
    small, counts = lm_scoring.learn_model(docs, max_bytes=1 << 10)          # far below what the entries need
    large, _ = lm_scoring.learn_model(docs)
    assert small.filters is None and large.filters is not None
    a, b = (Counter(tuple(r) for r in lm_scoring.score_texts(docs, m, counts).select(
        *columns[:3], F.round("base_score", 6), F.round("score", 6)).collect()) for m in (small, large))
    assert a == b and sum(a.values()) == docs.count()
    unseen = lm_scoring.mix(np.arange(1, 20001, dtype=np.uint64) * np.uint64(7919))
    for f in large.filters:
        assert (f.levels(unseen) > 0).mean() < 0.03


def test_no_probability_above_one(spark):
    texts = spark.createDataFrame([(1, "a " * 5000)], "doc_id long, text string")
    model, counts = lm_scoring.learn_model(texts)
    model.mix_pairs = 0.0
    assert lm_scoring.score_texts(texts, model, counts).first()["score"] <= 0


def test_pairs_seen_once_count(spark):
    texts = spark.createDataFrame([(1, "a b c d"), (2, "b a d c")], "doc_id long, text string")
    model, counts = lm_scoring.learn_model(texts.where("doc_id = 1"))
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(texts, model, counts).collect()}
    # five tokens, each once: a seen pair has share 1, an unseen one 0; every word's own probability is 2 / 11
    seen, unseen = np.log10(0.3 + 0.7 * 2 / 11), np.log10(0.7 * 2 / 11)
    assert abs(got[1] - 5 * seen) < 1e-9 and abs(got[2] - 5 * unseen) < 1e-9


def test_jaccard_join_counts_every_link(spark, monkeypatch):
    """Links inside components too: between near copies of one leader, exact copies, repeated rows and null texts."""
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(words[:100 - k] + [f"x{j}" for j in range(k)])) for k in range(0, 40)]
    rows += [(100 + k, " ".join([*words[:60], f"y{k}", *words[60:]])) for k in range(30)]
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, rows[50][1]), (202, rows[50][1]), (203, None), (204, "")]
    sets = [_shingles(t or "") for _, t in rows]
    want = sorted((d, sum(bool(a and b) and i != j and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)))
                  for i, ((d, _), a) in enumerate(zip(rows, sets, strict=True)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    first = {}                                                    # the smallest id of each set
    for (d, _), a in zip(rows, sets, strict=True):
        first[frozenset(a)] = min(d, first.get(frozenset(a), d))
    several = [a for a in first if a]
    pairs = sorted(tuple(sorted((first[a], first[b]))) for i, a in enumerate(several) for b in several[:i]
                   if 100 * len(a & b) >= 80 * len(a | b))
    for block in (4096, 8):
        monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
        got = jaccard_join.jaccard_join(frame).collect()
        assert sorted((r["doc_id"], r["n_links"]) for r in got) == want
    assert sorted(tuple(r) for r in jaccard_join.jaccard_links(frame).collect()) == pairs


def test_near_copies_without_or_with_shared_ids(spark):
    import corpus_pipeline
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(7, a), (3, a + " more"), (3, a + " more"), (None, a), (None, b), (None, b + " too"), (5, c), (5, "other words here"),
            (2, c + " end"), (9, "one of a kind"), (9, "one of a kind"), (None, "alone without id"), (11, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    sets = [_shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:                                           # smallest number over links
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[i] = min(root[i], root[j])
    groups = [[rows[i] for i in range(len(rows)) if root[i] == r] for r in sorted(set(root))]
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups]
    assert len(got) == len(want)
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(d for d, _ in want if d is not None)
    kept = [rows[r["k"]] for r in got]
    assert all(sum(rows[r["k"]] in g for r in got) == 1 for g in groups) and set(kept) <= {r for g in groups for r in g}


def test_pipeline_bounds_arrow_batches(monkeypatch):
    from types import SimpleNamespace as Some

    import corpus_pipeline
    monkeypatch.setattr(corpus_pipeline, "prepare_session", lambda spark: None)
    for given, wanted in ((None, {corpus_pipeline.ARROW_ROWS: "2000"}), ("500", {})):
        found = {}
        corpus_pipeline.prepare(Some(sparkContext=Some(getConf=lambda g=given: Some(get=lambda key: g)),
                                     conf=Some(set=found.__setitem__)))
        assert found == wanted

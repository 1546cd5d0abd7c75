"""Collocations, signature search and decontamination against brute force, with their edge cases."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import collocations, decontaminate, langid, signature_search
from papyra.llm import queries as Q
from papyra.llm.common import read
from papyra.llm.tokens import ALPHANUMERIC, words_by_text

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, row long, items string, key long, count long, n long"
LONG = "the cat sat. " * 40_000 + "on the mat " * 3


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, "x", 8, 9, 10) for i, t, lang in rows], DOCS)


EDGES = [(1, None, "en"), (2, "", None), (3, " .,\n\t", "en"), (4, "A b. a B! a b c", "en"), (4, "A b. a B! a b c", "en"),
         (None, "a b c d", None), (6, "été à la plage, été à la plage", "fr"), (7, "日本 語 日本 語", "und"), (8, LONG, "en")]


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", _lower(text))


def _mined(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", _lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        own = []
        for p, a in c.items():
            if len(p) < 2 or a < least or any(
                    100 * b >= 50 * a for q, b in c.items() if len(q) == 3 > len(p) and b >= least and p in (q[:2], q[1:])):
                continue
            cuts = [(1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            own.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)]
    return out


def test_collocations_match_brute_force(spark):
    rows = EDGES + [(100 + r["doc_id"], r["text"], r["lang"]) for r in
                    read(spark, SF, "documents").where("doc_id < 40").collect()]
    got = collocations.collocations(_docs(spark, rows), min_count=3, top=150)
    assert sorted(tuple(r) for r in got.collect()) == sorted(_mined(rows, 3, 150))
    assert [c for c, _ in got.dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_of_nothing(spark):
    assert collocations.collocations(_docs(spark, []), shards=1).count() == 0


def test_phrases_across_a_cut_count_once():
    text = "alpha beta " * 50_000                            # several slices without a break
    found = Counter()

    class Batch:
        def column(self, c):
            return type("C", (), {"to_pylist": lambda _: ["en", "en"] if c == "lang" else [text, "alpha beta. gamma"]})()

    for *_, keys, valid in collocations._phrases([Batch()], 3, 0):
        for n, (k, ok) in enumerate(zip(keys, valid, strict=True), 1):
            found[n] += len(k[ok])
    assert found == {1: 100_003, 2: 99_999 + 1, 3: 99_998}


def _ranked(docs, items, k):
    terms = {i: Counter(_terms(t)) for i, (_, t) in enumerate(docs)}
    terms = {i: c for i, c in terms.items() if c}
    n, total = len(terms), sum(sum(c.values()) for c in terms.values())
    df = Counter(t for c in terms.values() for t in c)
    own = defaultdict(set)
    for item, text in items:
        own[item].update(_terms(text))
    out = []
    for item, want in own.items():
        scored = []
        for i, c in terms.items():
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                    for t in want if c[t])
            if s > 0:
                scored.append((-s, docs[i][0] is None, docs[i][0] or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_ranked_search_matches_brute_force(spark):
    docs = [(i, t) for i, t, _ in EDGES] + [(r["doc_id"] + 100, r["text"]) for r in read(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").limit(12).collect()]
    items += [(1000, "the cat"), (1000, "A b"), (None, "plage 日本"), (1001, None), (1002, "..."), (1003, "nowhereatall")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, score long")
    want = sorted(_ranked(docs, items, 5), key=str)
    docs = _docs(spark, [(i, t, "en") for i, t in docs])
    got = signature_search.rank_documents(docs, frame, k=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    index = signature_search.build_index(docs)                # several groups of items, each a pass
    got = signature_search.search(index, signature_search.item_terms(frame), 5, group_size=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert signature_search.rank_documents(docs.where("false"), frame).count() == 0
    assert signature_search.rank_documents(docs, frame.where("false")).count() == 0


def test_signature_bounds_hold_and_exclude():
    rng = np.random.default_rng(3)
    held = []
    for i in range(400):
        terms = np.unique(rng.integers(1, 4000, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        held.append((i, i, 0, terms, rng.integers(1, 9, len(terms))))
    held = [(r, i, int(c.sum()), t, c) for r, i, _, t, c in held]
    raw = signature_search._block(held, 256)
    block = {c: np.frombuffer(v, signature_search._KINDS[c]) if c in signature_search._KINDS else v for c, v in raw.items()}
    group = signature_search.Group([i for i in range(30) for _ in range(12)],
                                   np.concatenate([held[i][3][:12] for i in range(30)]))
    df = np.bincount(group.find(block["terms"])[1], minlength=len(group.vocab))
    group.weigh(400, raw["total"], df)
    bounds = group.bounds(block)
    exact = np.array([group.rescore(block, d, np.arange(30)) for d in range(400)]).T
    assert (bounds >= exact).all()
    best = signature_search.Best(30, 5)
    scored = best.rescored(block, group)
    again = signature_search.Best(30, 5, best.low).rescored(block, group)
    assert again < scored < exact.size
    for i in range(30):
        assert best.scores[i].tolist() == sorted(exact[i][exact[i] > 0].tolist(), reverse=True)[:5]


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    for _ in range(12):
        docs = [rng.integers(1, 6, rng.integers(0, 40)).astype(np.uint64) for _ in range(rng.integers(1, 12))]
        docs += docs[:3]
        shard = decontaminate.Shard(decontaminate.index_shard(docs))
        phrases = [rng.integers(1, 7, rng.integers(1, 6)) for _ in range(50)]
        words, flush, lengths = np.arange(1, 8, dtype=np.uint64), np.full((50, 5), 7), np.array([len(p) for p in phrases])
        for i, p in enumerate(phrases):
            flush[i, :len(p)] = p - 1
        hit, doc, phrase = decontaminate._search(shard, words, flush, lengths)
        want, pairs = [], set()
        for d, text in enumerate(docs):
            own = np.zeros(len(text) + 1, bool)
            for i, p in enumerate(phrases):
                for at in range(len(text) - len(p) + 1):
                    if (text[at:at + len(p)] == p).all():
                        own[at:at + len(p)] = True
                        pairs.add((d, i))
            want.append(own)
        assert (np.concatenate(want) == hit).all() and pairs == set(zip(doc.tolist(), phrase.tolist(), strict=True))


def _contaminated(docs, items, width=10):
    own = defaultdict(set)
    for item, text in items:
        w = _terms(text)
        for at in range(max(1, len(w) - width + 1) if w else 0):
            own[tuple(w[at:at + width])].add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = _terms(text), set(), set()
        for size in {len(k) for k in own}:
            for at in range(len(w) - size + 1):
                if names := own.get(tuple(w[at:at + size])):
                    hit.update(range(at, at + size))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("segment", [1 << 19, 25])
def test_decontamination_matches_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)    # with 25, most documents lie in several segments
    monkeypatch.setattr(decontaminate, "SHARD", max(200, segment))
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    items += [(500, "cat sat"), (500, "on the mat"), (None, "A b c"), (501, None), (502, "!"), (503, items[0][1]),
              (504, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (505, " ".join(f"w{i}" for i in range(40)))]
    docs = [(i, t) for i, t, _ in EDGES[:-1]] + [(8, LONG[:3000])]
    docs += [(r["doc_id"] + 100, r["text"]) for r in read(spark, SF, "documents").where("doc_id < 60").collect()]
    docs += [(90, " ".join(f"w{i}" for i in range(5, 39))), (91, "x W0-w1 w2 w3 w4 w5 w6 w7 w8?")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row long")
    got = decontaminate.contamination(_docs(spark, [(i, t, "en") for i, t in docs]), frame).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])          # noqa: E731
    assert sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=key) == sorted(
        _contaminated(docs, items), key=key)
    for r in got:
        assert sum(e - b for b, e in zip(r["begins"], r["ends"], strict=True)) == r["n_hit"]
        assert all(x < y for x, y in zip(r["ends"], r["begins"][1:], strict=False))


def test_decontamination_of_nothing(spark):
    docs, items = _docs(spark, EDGES), read(spark, SF, "benchmark")
    assert decontaminate.contamination(docs.where("false"), items).count() == 0
    clean = decontaminate.contamination(docs, items.where("false")).collect()
    assert len(clean) == len(EDGES) and all(r["n_hit"] == 0 and r["items"] == [] for r in clean)
    grouped = decontaminate.find_windows(decontaminate.build_index(docs), decontaminate.item_windows(items), group=50)
    assert grouped.count() == len(EDGES)


def test_planted_passages_are_found(spark):
    """The registered query marks the documents that hold an item's words, with the item's id."""
    item = read(spark, SF, "benchmark").first()
    holds = " ".join(_terms(item["text"]))
    rows = {r["doc_id"]: r for r in Q.op13_decontaminate(spark, SF).collect()}
    for r in read(spark, SF, "documents").collect():
        if holds in " ".join(_terms(r["text"])):
            assert rows[r["doc_id"]]["contaminated"] and rows[r["doc_id"]]["n_hit"] >= len(_terms(item["text"]))
    assert not all(r["contaminated"] for r in rows.values())


def test_words_across_slices():
    text = "Ab1é " * 200_000
    parts = list(words_by_text([text, None, "x"], ALPHANUMERIC))
    assert sum(len(h) for i, h, _ in parts if i == 0) == 200_000 and len({*np.concatenate([h for i, h, _ in parts if i == 0])}) == 1
    assert [last for i, _, last in parts if i > 0] == [True, True]


def _cosines(texts, docs, dims, seed):
    """Prototypes and cosines from explicit vectors, the slow way."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (langid.SYMBOLS, dims)).astype(np.int64)

    def vector(text):
        out = np.zeros(dims, np.int64)
        for g in langid.trigrams(text).tolist():
            a, b, c = g // langid.SYMBOLS**2, g // langid.SYMBOLS % langid.SYMBOLS, g % langid.SYMBOLS
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    langs = sorted({lang for lang, _ in docs})
    protos = {lang: sum(vector(t) for x, t in docs if x == lang) for lang in langs}
    seen = {g for _, t in docs for g in langid.trigrams(t).tolist()}
    out = []
    for t in texts:
        own = np.zeros(dims, np.int64)
        for g in langid.trigrams(t).tolist():
            if g in seen:
                a, b, c = g // langid.SYMBOLS**2, g // langid.SYMBOLS % langid.SYMBOLS, g % langid.SYMBOLS
                own += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        out.append([float(own @ protos[x] / np.linalg.norm(protos[x])) for x in langs])
    return langs, out


def test_languages_by_explicit_vectors(spark):
    rows = [(r["lang"], r["text"][:300]) for r in read(spark, SF, "documents").where("lang IS NOT NULL").limit(24).collect()]
    texts = [t[:80] for _, t in rows] + ["xyzzy the et", "un deux trois"]
    learned = spark.createDataFrame(rows, "lang string, text string")
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict_languages(asked, langid.learn_profiles(learned, dims=256)).collect()}
    langs, sums = _cosines(texts, rows, 256, 9)
    for i, s in enumerate(sums):
        assert got[i]["lang_pred"] == langs[int(np.argmax(s))]
        assert abs(got[i]["score"] - max(max(s), 0) / sum(x for x in s if x > 0)) < 1e-3


def test_every_text_with_a_letter_gets_a_learned_language(spark):
    learned = spark.createDataFrame([("en", "the cat sat on the mat and the dog ran"), ("fr", "le chat")], "lang string, text string")
    texts = ["привет мир", "x", "zzz", "日本語", "the", "le chat", "12 !", "", None, "the " * 200_000]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_languages(asked, langid.learn_profiles(learned)).collect()}
    assert all(got[i][0] in ("en", "fr") for i in (0, 1, 2, 3, 4, 5, 9)) and got[1] == ("en", 0.0)
    assert got[4][0] == got[9][0] == "en" and got[5][0] == "fr"
    assert all(got[i] == ("und", 0.0) for i in (6, 7, 8)) and all(0 <= s <= 1 for _, s in got.values())

"""Components over groups of near copies against brute force, and language-model scoring of clashing columns."""

import random
from collections import Counter

import pytest

from papyra.llm import jaccard_join, lm_scoring
from tests.llm.test_operators import _components, _documents, _shingles


def _families(seed: int) -> dict[int, str]:
    """Families of near copies around few bases: some drift into each other, others share a passage but do not link."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    docs: dict[int, list[str]] = {}
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(40)] + passage if family % 2 else [f"f{family // 2}w{i}" for i in range(120)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(40)}"
            docs[len(docs)] = text + [f"t{i}" for i in range(rng.randrange(0, 12))]
    for k in range(30):                                       # from the first base step by step to something else
        docs[1000 + k] = [f"f0w{i}" for i in range(120 - 4 * k)] + [f"z{i}" for i in range(4 * k)]
    return {d: " ".join(t) for d, t in docs.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_families(spark, monkeypatch, seed):
    docs = _families(seed)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    want = _components(docs)
    assert 2 < len(Counter(c for _, c in want.values())) < len(docs)
    for block in (4096, 8):
        monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame).collect()}
        assert got == want


def test_components_of_the_table(spark):
    docs = _documents(spark)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame).collect()}
    assert got == _components(docs)


def _links(texts: list[str | None]) -> list[set[int]]:
    sets = [_shingles(t or "") for t in texts]
    return [{j for j, b in enumerate(sets) if i != j and a and 100 * len(a & b) >= 80 * len(a | b)} for i, a in enumerate(sets)]


@pytest.mark.parametrize("block,length,dense", [(512, 1 << 20, 16), (4, 1 << 20, 2), (512, 40, 16)])
def test_links_within_kin_are_counted(spark, monkeypatch, block, length, dense):
    """In one cell, in many by number or by length, by products or by pairs of few; rows repeat over partitions."""
    monkeypatch.setattr(jaccard_join, "KIN_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "KIN_LENGTH", length)
    monkeypatch.setattr(jaccard_join, "DENSE", dense)
    texts = list(_families(3).values())
    rows = [*enumerate(texts), *[(k, texts[k]) for k in range(0, 60, 7)]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = _links([t for _, t in rows])
    got = jaccard_join.jaccard_join(frame).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == sorted((d, len(w)) for (d, _), w in zip(rows, want, strict=True))
    root = _components(dict(enumerate(texts)))
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for d, (_, c) in root.items()}


def _near_groups() -> dict[int, str]:
    """A large group of near copies, and texts that are close to it without a link to any of its members."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    docs = {}
    for k in range(90):
        text = list(base)
        for place in rng.sample(range(5, 190), 3) if k < 60 else [*rng.sample(range(5, 190), 2), *range(3, 195, 27)]:
            text[place] = f"e{k}x{place}"
        docs[k] = " ".join(text)
    return docs


@pytest.mark.parametrize("met,strip,brief", [(1 << 13, 1 << 16, 8), (16, 64, 2)])
def test_pairs_of_large_groups_are_no_rows(spark, monkeypatch, met, strip, brief):
    monkeypatch.setattr(jaccard_join, "MET", met)
    monkeypatch.setattr(jaccard_join, "STRIP", strip)
    monkeypatch.setattr(jaccard_join, "BRIEF", brief)
    monkeypatch.setattr(jaccard_join, "KIN_BLOCK", 8 if met == 16 else 512)
    docs, given, possible = _near_groups(), [], jaccard_join._possible
    monkeypatch.setattr(jaccard_join, "_possible", lambda pairs, *rest: given.append(pairs.count()) or possible(pairs, *rest))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want, links = _components(docs), _links(list(docs.values()))
    got = jaccard_join.jaccard_components(frame).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    several = [given[-1]]
    counted = jaccard_join.jaccard_join(frame).collect()
    assert {r["doc_id"]: r["n_links"] for r in counted} == {d: len(x) for d, x in enumerate(links)}
    several.append(given[-1])
    assert brief < 8 or several[0] < 400 and several[1] < 1300      # 464 and 1,587 pairs were rows, and are left by bounds alone


def test_rows_without_an_id_link(spark):
    words = [f"w{i}" for i in range(60)]
    near, far = " ".join([*words, "end"]), " ".join(f"v{i}" for i in range(30))
    rows = [(5, " ".join(words)), (None, " ".join(words)), (None, near), (None, near), (None, far), (None, far + " too"),
            (None, None), (9, ""), (7, "x y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.jaccard_join(frame).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    want = [(5, 56, 5, 3), (None, 56, 5, 3), (None, 57, 5, 3), (None, 57, 5, 3), (None, 26, None, 1), (None, 27, None, 1),
            (None, 0, None, 0), (9, 0, 9, 0), (7, 1, 7, 0)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sorted(map(str, map(tuple, jaccard_join.jaccard_links(frame).collect()))) == ["(None, 5)", "(None, None)"]


def test_scores_beside_columns_of_any_name(spark, monkeypatch):
    """Names used inside come back as given, rows of one text agree, on both ways to read the filter."""
    monkeypatch.setattr(lm_scoring, "RANGE_BYTES", 1 << 6)
    rows = [(1, "a b c a b", 7, 8, 9, 10, 11), (1, "a b c a b", 7, 8, 9, 10, 11), (2, None, 7, 8, 9, 10, 11),
            (None, "", 7, 8, 9, 10, 11), (3, "x " * 300, 7, 8, 9, 10, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, known int, base int, rare int, _row int, _block int")
    for bound in (1 << 26, 0):
        model, counts = lm_scoring.learn_model(docs, max_bytes=bound)
        assert (model.filters is None) == (bound == 0)
        got = lm_scoring.score_texts(docs, model, counts).collect()
        assert [tuple(r[c] for c in ("known", "base", "rare", "_row", "_block")) for r in got] == [(7, 8, 9, 10, 11)] * 5
        assert sorted(r["n_tokens"] for r in got) == [1, 1, 6, 6, 301]
        assert len({r["score"] for r in got if r["n_tokens"] == 6}) == 1 and all(r["n_known"] == r["n_tokens"] for r in got)

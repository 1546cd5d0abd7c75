"""Chunker properties and the closed form for single-space text."""

from hypothesis import given, settings
from hypothesis import strategies as st

from papyra import lexicons as L
from papyra.operators.chunking import _split, chunk_documents, split_text


def closed_form(text, size, overlap):
    """Greedy word windows for cleaned text whose words are all shorter than ``size``."""
    if not text:
        return []
    w = text.split(" ")
    cum = [0]
    for i, t in enumerate(w):
        cum.append(cum[-1] + len(t) + (1 if i > 0 else 0))
    n = len(w)
    out, s = [], 0
    while True:
        e = max(i for i in range(s, n + 1) if cum[i] <= cum[s] + size)
        out.append(" ".join(w[s:e]))
        if e == n:
            return out
        thr = max(cum[e] - overlap, cum[e + 1] - size)
        s = next(i for i in range(s, n + 1) if cum[i] >= thr)


words = st.text(alphabet="abcdeé", min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, min_size=1, max_size=300), st.sampled_from([(100, 20), (120, 0), (300, 150), (60, 59)]))
def test_chunks_bounded_and_covering(ws, params):
    size, overlap = params
    text = " ".join(ws)
    chunks = split_text(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    # every word of the text appears, in order, across the chunks
    joined = " ".join(chunks).split(" ")
    it = iter(joined)
    assert all(any(x == y for y in it) for x in ws)
    assert chunks[0] == text[:len(chunks[0])]
    assert text.endswith(chunks[-1])
    assert chunks == closed_form(text, size, overlap)
    # the O(n) fast path equals the general recursive splitter
    assert chunks == _split(text, list(L.CHUNK_SEPARATORS), size, overlap)


def test_empty_and_null():
    assert split_text("") == []
    assert split_text(None) == []


def test_character_fallback_for_long_word():
    text = "a" * 25 + " bb"
    chunks = split_text(text, 10, 2)
    assert all(len(c) <= 10 for c in chunks)
    assert "".join(c for c in chunks if set(c) == {"a"}).count("a") >= 25


def test_paragraph_separators_first():
    text = "para one line\n\npara two is here\nsecond line"
    assert split_text(text, 20, 0) == ["para one line", "para two is here", "second line"]


def test_default_size_on_prose():
    text = " ".join(f"w{i:03d}xyz" for i in range(400))
    a = split_text(text)
    assert all(len(c) <= 1000 for c in a) and len(a) == 4


def test_spark_chunks_equal_python(spark):
    texts = [(1, " ".join(f"tok{i}" for i in range(700))), (2, ""), (3, "short text")]
    df = spark.createDataFrame(texts, "id int, t string")
    got = {(r.id, r.chunk_index): r.chunk_text for r in chunk_documents(df, "t", ["id"], 200, 50).collect()}
    want = {(i, k): c for i, t in texts for k, c in enumerate(split_text(t, 200, 50))}
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\té", max_size=400), st.sampled_from([(50, 10), (30, 0), (80, 40)]))
def test_general_path_bounds(text, params):
    size, overlap = params
    for c in split_text(text, size, overlap):
        assert 0 < len(c) <= size and c == c.strip()

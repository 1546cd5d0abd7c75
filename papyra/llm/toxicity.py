"""Toxicity: a linear-chain conditional random field tags toxic spans.

Words are runs of letters.  Labelled documents give, for every five-letter
piece of a word (with its ends marked), in how many toxic and clean documents it
occurs; pieces whose log odds stay high two deviations below the estimate are
cues.  A word's class is its strongest cue's level with its number of cues, 0
for none.  Labelled tokens are the words of labelled documents: toxic if the
document is and the word holds a cue.  The field learns one weight per class and
one per transition from them; forward-backward marginals give each word's
probability of being toxic.  A logistic function of their sum and maximum,
fitted to the document labels, is the document's score; words with marginals of
one half or more are the offending spans.

Words without a cue share one class, so a run of n of them is the n-th power of
one 2 x 2 matrix: the marginals are exact, at a cost that follows the cues.

The fit uses at most about ``sample_rows`` labelled documents, taken by a hash of
the id (a classifier's bounded sample); every document is scored whole.

Edge cases: null and empty texts have no words and get the score of no cue;
several labels of one id count as their maximum; null labels, and labels without
a document, are left out; without both classes the score is the smoothed share
of toxic labels; repeated rows get equal answers; an empty table stays empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyra.llm.common import unit_hash, without

PIECE = 5
MIN_LOG_ODDS = 2.0
LEVELS, COUNTS = 6, 3            # classes of words with a cue: level x number of cues
MAX_CUES = 1 << 16
WINDOW = 32                      # the field is fitted on windows of so many words
_WORD = re.compile(r"[^\W\d_]+")


def pieces(word: str) -> set[str]:
    """Five-letter pieces of " word ", or all of it if it is shorter."""
    w = f" {word} "
    return {w[i:i + PIECE] for i in range(max(1, len(w) - PIECE + 1))}


@dataclass
class Field:
    """Cues with their levels, weights of the chain, and of the document score."""

    cues: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros(1 + LEVELS * COUNTS))     # of state 1; state 0 has 0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    logit: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        for cue, level in self.cues.items():
            a.add_word(cue, level)
        if self.cues:
            a.make_automaton()
        return a

    def hits(self, text: str | None, automaton) -> tuple[int, dict[int, int]]:
        """Number of words, and the class of each word that holds a cue."""
        words = _WORD.findall(text or "")
        found: dict[int, tuple[int, int]] = {}
        if self.cues and words:
            line = f" {' '.join(words)} ".lower()
            at, word = 0, -1
            for end, level in automaton.iter(line):
                word, at = word + line.count(" ", at, end), end      # the piece's last letter but one is in the word
                best, n = found.get(word, (0, 0))
                found[word] = max(best, level), n + 1
        return len(words), {w: 1 + (level - 1) * COUNTS + min(n, COUNTS) - 1 for w, (level, n) in found.items()}

    def marginals(self, n_words: int, hits: dict[int, int]) -> list[float]:
        """Probability of state 1 of each word with a cue, in the order of ``hits``."""
        if not hits:
            return []
        plain = np.array([1.0, math.exp(self.emit[0])])
        step = np.exp(self.trans)
        m = step * plain
        half, root = (m[0, 0] + m[1, 1]) / 2, math.sqrt(((m[0, 0] - m[1, 1]) / 2) ** 2 + m[0, 1] * m[1, 0])
        p1 = (m - (half - root) * np.eye(2)) / (2 * root)
        p2, ratio = np.eye(2) - p1, (half - root) / (half + root)

        def run(n: int) -> np.ndarray:                  # a run of n plain words, scaled
            return p1 + ratio**n * p2

        words = list(hits)
        own = [np.array([1.0, math.exp(self.emit[hits[w]])]) for w in words]
        first = np.array([1.0, math.exp(self.start)])
        forward = [own[0] * (first if words[0] == 0 else first * plain @ run(words[0] - 1) @ step)]
        for k in range(1, len(words)):
            v = forward[-1] @ run(words[k] - words[k - 1] - 1) @ step * own[k]
            forward.append(v / v.sum())
        after = run(n_words - 1 - words[-1]) @ np.ones(2)
        out = []
        for k in reversed(range(len(words))):
            both = forward[k] * after
            out.append(float(both[1] / both.sum()))
            if k:
                after = run(words[k] - words[k - 1] - 1) @ step @ (own[k] * after)
                after /= after.sum()
        return out[::-1]

    def score(self, marginals: list[float]) -> float:
        z = float(self.logit @ _features(marginals))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _features(marginals: list[float]) -> np.ndarray:
    return np.array([1.0, math.log1p(sum(marginals)), max(marginals, default=0.0)])


def spans(text: str, marginals: dict[int, float]) -> list[tuple[int, int, float]]:
    """(begin, end, largest marginal) of the runs of words with a marginal of one half or more."""
    out: list[tuple[int, int, float]] = []
    last = -2
    for i, w in enumerate(_WORD.finditer(text)):
        p = marginals.get(i, 0.0)
        if p >= 0.5:
            if last == i - 1:
                out[-1] = (out[-1][0], w.end(), max(out[-1][2], p))
            else:
                out.append((w.start(), w.end(), p))
            last = i
    return out


def fit_chain(classes: np.ndarray, labels: np.ndarray, lengths: np.ndarray, weights: np.ndarray, model: Field,
              rounds: int = 150, rate: float = 0.1) -> None:
    """Maximise the weighted conditional likelihood of ``labels`` (rows are windows), by Adam."""
    rows, steps = classes.shape
    live = np.arange(steps)[None] < lengths[:, None]
    w = weights / weights.sum()
    seen = np.bincount(classes.ravel(), (labels * live * w[:, None]).ravel(), len(model.emit))
    pairs = np.zeros((2, 2))
    for t in range(1, steps):
        np.add.at(pairs, (labels[:, t - 1], labels[:, t]), w * live[:, t])
    theta = np.zeros(len(model.emit) + 4)            # emissions, transitions 01 10 11, start
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        emit, trans = theta[:-4], np.array([[0.0, theta[-4]], [theta[-3], theta[-2]]])
        own = np.stack([np.ones(classes.shape), np.exp(emit[classes])], 2)
        step, first = np.exp(trans), np.array([1.0, np.exp(theta[-1])])
        alpha, beta = np.empty((steps, rows, 2)), np.ones((steps, rows, 2))
        alpha[0] = first * own[:, 0]
        for t in range(1, steps):
            v = alpha[t - 1] @ step * own[:, t]
            alpha[t] = np.where(live[:, t, None], v / v.sum(1, keepdims=True), alpha[t - 1])
        for t in range(steps - 1, 0, -1):
            v = (own[:, t] * beta[t]) @ step.T
            beta[t - 1] = np.where(live[:, t, None], v / v.sum(1, keepdims=True), beta[t])
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        grad = np.empty_like(theta)
        grad[:-4] = seen - np.bincount(classes.ravel(), (post[:, :, 1].T * live * w[:, None]).ravel(), len(emit))
        expected = np.zeros((2, 2))
        for t in range(1, steps):
            both = alpha[t - 1][:, :, None] * step * (own[:, t] * beta[t])[:, None, :]
            expected += np.tensordot(w * live[:, t], both / both.sum((1, 2), keepdims=True), 1)
        grad[-4:-1] = (pairs - expected)[[0, 1, 1], [1, 0, 1]]
        grad[-1] = w @ (labels[:, 0] - post[0, :, 1])
        grad -= theta * 1e-6
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-12)
    model.emit, model.trans = theta[:-4], np.array([[0.0, theta[-4]], [theta[-3], theta[-2]]])
    model.start = float(theta[-1])


def fit_logit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (y - p) - ridge * b)
    return b


def _windows(n: int, hits: dict[int, int], toxic: int) -> Counter:
    """Windows of a document as ((classes with a cue by place), length), counted."""
    parts: Counter = Counter()
    by_window: dict[int, list[tuple[int, int]]] = {}
    for w, c in hits.items():
        by_window.setdefault(w // WINDOW, []).append((w % WINDOW, c))
    for k, found in by_window.items():
        parts[(tuple(found), min(WINDOW, n - k * WINDOW), toxic)] += 1
    last = (n - 1) // WINDOW
    full = last - sum(k < last for k in by_window)
    if full:
        parts[((), WINDOW, 0)] += full
    if last not in by_window:
        parts[((), n - last * WINDOW, 0)] += 1
    return parts


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str,
                    seed: int) -> DataFrame:
    """(text, toxic) of about ``sample_rows`` labelled documents; the id list that is broadcast has that bound."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    share = min(1.0, sample_rows / max(1, known.count()))
    known = known.where(unit_hash(F.lit(f"toxic{seed}"), F.col("doc_id")) <= share)
    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
            .join(F.broadcast(known), "doc_id").select("text", "toxic"))


def _piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tally: tuple[Counter, Counter] = Counter({"": 0}), Counter({"": 0})
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = {w.lower() for w in _WORD.findall(text or "")}
            tally[toxic > 0].update({"", *(p for w in words for p in pieces(w))})      # "" counts the documents
        names = sorted(tally[0].keys() | tally[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([tally[1][g] for g in names], pa.int64()),
                                          pa.array([tally[0][g] for g in names], pa.int64())],
                                         ["piece", "toxic", "clean"])


def learn_field(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id",
                text_col: str = "text", seed: int = 10) -> Field:
    sample = labelled_sample(docs, labels, sample_rows, id_col, text_col, seed)
    counts = sample.mapInArrow(_piece_counts, "piece string, toxic long, clean long")
    counts = counts.groupBy("piece").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    totals = sample.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"), F.count("toxic").alias("n")).first()
    toxic, clean = totals["t"] or 0, totals["n"] - (totals["t"] or 0)
    model = Field()
    model.logit[0] = math.log((toxic + 0.5) / (clean + 0.5))
    if not toxic or not clean:
        return model
    odds = (F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
            - 2 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    strong = (counts.where("piece <> ''").withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
              .orderBy(F.desc("odds"), "piece").limit(MAX_CUES).collect())
    model.cues = {r["piece"]: min(LEVELS, 1 + int(r["odds"] - MIN_LOG_ODDS)) for r in strong}
    if not model.cues:
        return model

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            found = [model.hits(t, automaton) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.int32()), pa.array([list(h) for _, h in found], pa.list_(pa.int32())),
                 pa.array([list(h.values()) for _, h in found], pa.list_(pa.int32())), b.column(1)],
                ["n", "at", "classes", "toxic"])

    rows = [(r["n"], dict(zip(r["at"], r["classes"], strict=True)), int(r["toxic"] > 0))
            for r in sample.mapInArrow(chains, "n int, at array<int>, classes array<int>, toxic int").collect()]
    parts: Counter = Counter()
    for n, hits, y in rows:
        if n:
            parts.update(_windows(n, hits, y))
    places = sorted(parts)
    classes, tags = np.zeros((len(places), WINDOW), np.int64), np.zeros((len(places), WINDOW), np.int64)
    for i, (found, _, y) in enumerate(places):
        for at, c in found:
            classes[i, at], tags[i, at] = c, y
    fit_chain(classes, tags, np.array([n for _, n, _ in places]), np.array([parts[p] for p in places], float), model)
    x = np.array([_features(model.marginals(n, hits)) for n, hits, _ in rows])
    model.logit = fit_logit(x, np.array([y for *_, y in rows]))
    return model


def score_toxicity(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` (but for old ones of these names) plus score, predicted and spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = without(docs, "score", "predicted", "spans")
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])
    extra = StructType.fromDDL("score double, predicted int, "
                               "spans array<struct<begin:int,end:int,marginal:double>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_, automaton = shared.value, shared.value.automaton()
        none = field_.score([])
        for b in batches:
            scores, found = [], []
            for text in b.column(text_col).to_pylist():
                n, hits = field_.hits(text, automaton)
                probs = field_.marginals(n, hits)
                scores.append(field_.score(probs) if probs else none)
                found.append(spans(text, dict(zip(hits, probs, strict=True))) if probs and max(probs) >= 0.5 else [])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                 pa.array(found, pa.list_(span))], [*b.schema.names, "score", "predicted", "spans"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *extra.fields]))

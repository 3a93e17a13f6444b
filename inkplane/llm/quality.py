"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few counts and ratios (no label, language, source or id is among them). Each feature is cut
into bins; cyclic boosting visits the features in turn and adds a shallow tree's step function to the
feature's lookup table. Then the pairs of features that still explain most get two-dimensional tables the
same way. A score is the sum of the table entries of a text's bins, through the logistic function.

Fitting takes a bounded sample of the labelled rows (SAMPLE, the smallest hashes of doc_id); scoring takes
every whole text in one pass without a shuffle.

Edge cases: null and empty texts are scored by their (zero) features; without labels every score is 0.5;
labels that contradict each other go by their mean; repeated rows give repeated rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Most labelled rows the model is fitted on.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, PATIENCE = 300, 60, 0.15, 15
#: Texts scored this or higher are of good quality.
ACCEPT = 0.7

FEATURES = (
    "words", "word_length", "upper", "symbols", "pipes", "shouts", "digits", "beyond_ascii", "stops", "commas",
    "capitals", "marked_words", "same_as_before", "distinct_words", "distinct_threes", "line_words", "distinct_lines", "longest_word",
)

_UPPER = common.byte_class(bytes(range(65, 91)), False)
_SYMBOLS = common.byte_class(b"#$%&*!|@^~<>{}[]=\\_", False)
_DIGIT = common.byte_class(b"0123456789", False)
_LETTER = _UPPER | common.byte_class(bytes(range(97, 123)), True)
_LINE = ~common.byte_class(b"\n", False)


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Different hashes of each document."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document of a slice."""
    n = len(off) - 1
    starts, ends, doc = common.words(data, off, common.SPACED)
    h = common.prefix_hash(data)
    w = common.span_hash(h, starts, ends)
    count = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[off])
    size, n_words = np.maximum(np.diff(off), 1), np.bincount(doc, minlength=n)
    per_word, letters = np.maximum(n_words, 1), np.maximum(count(_LETTER[data]), 1)
    of_words = lambda flag: np.bincount(doc[flag], minlength=n) / per_word
    length = ends - starts
    again = np.zeros(len(w), bool)
    again[1:] = (w[1:] == w[:-1]) & (doc[1:] == doc[:-1])
    threes = np.flatnonzero(doc[2:] == doc[:-2])
    t = common.mix(w[threes] * np.uint64(3) + w[threes + 1] * np.uint64(5) + w[threes + 2])
    ls, le, ld = common.words(data, off, _LINE)
    lines = np.bincount(ld, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    return np.column_stack([
        np.log1p(n_words), common.sums(length, doc, n) / per_word, count(_UPPER[data]) / letters, count(_SYMBOLS[data]) / size,
        count(data == 124) / per_word, count(data == 33) / per_word, count(_DIGIT[data]) / size, count(data >= 128) / size,
        count(data == 46) / per_word, count(data == 44) / per_word, of_words(_UPPER[data[starts]]), of_words(_SYMBOLS[data[ends - 1]]),
        of_words(again), _distinct(w, doc, n) / per_word, _distinct(t, doc[threes], n) / np.maximum(np.bincount(doc[threes], minlength=n), 1),
        np.log1p(n_words / np.maximum(lines, 1)), _distinct(common.span_hash(h, ls, le), ld, n) / np.maximum(lines, 1), np.log1p(longest),
    ])


def _step(g: np.ndarray, h: np.ndarray, leaves: int = 3, l2: float = 1.0) -> np.ndarray:
    """Newton steps of a tree over ordered bins: cut by cut where the gain is largest."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    edges = [0, len(g)]
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k = np.arange(a + 1, b)
            if len(k):
                gain = (G[k] - G[a]) ** 2 / (H[k] - H[a] + l2) + (G[b] - G[k]) ** 2 / (H[b] - H[k] + l2) - (G[b] - G[a]) ** 2 / (H[b] - H[a] + l2)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, at = gain[i], int(k[i])
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.empty(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and Newton steps of the best cross cut of a two-dimensional table: four leaves."""
    G, H = np.zeros(np.add(g.shape, 1)), np.zeros(np.add(g.shape, 1))
    G[1:, 1:], H[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    value = lambda a, b, T: T[np.ix_(a, b)]
    i, j = np.arange(1, g.shape[0]), np.arange(1, g.shape[1])
    parts = []
    for T in (G, H):
        ll = value(i, j, T)
        lh, hl = T[i, -1][:, None] - ll, T[-1, j][None, :] - ll
        parts.append((ll, lh, hl, T[-1, -1] - ll - lh - hl))
    gain = sum(a**2 / (b + l2) for a, b in zip(*parts, strict=True))
    a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    for (rows, cols), a_, b_ in zip(((slice(0, a + 1), slice(0, b + 1)), (slice(0, a + 1), slice(b + 1, None)), (slice(a + 1, None), slice(0, b + 1)), (slice(a + 1, None), slice(b + 1, None))), [p[a, b] for p in parts[0]], [p[a, b] for p in parts[1]], strict=True):
        out[rows, cols] = a_ / (b_ + l2)
    return float(gain[a, b] - G[-1, -1] ** 2 / (H[-1, -1] + l2)), out


class Additive:
    """Lookup tables of features and of pairs of features."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.base = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)])

    def _pair(self, b: np.ndarray, k: int) -> np.ndarray:
        return b[:, k] * PAIR_BINS // (len(self.edges[k]) + 1)

    def raw(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.base)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[self._pair(b, i), self._pair(b, j)]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30))) if self.tables else np.full(len(x), 0.5)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        if not len(y):
            return self
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        b = self.bins(x)
        held = np.arange(len(y)) % 7 == 3
        z = self.raw(b)

        def boost(rounds: int, visit) -> None:
            best, left = np.inf, PATIENCE
            for _ in range(rounds):
                visit()
                loss = np.mean(np.logaddexp(0, np.where(y[held] > 0.5, -z[held], z[held]))) if held.any() else 0
                left = PATIENCE if loss < best - 1e-5 else left - 1
                best = min(best, loss)
                if not left:
                    return

        def sums(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            w = ~held if len(y) > 50 else np.ones(len(y), bool)
            return np.bincount(index[w], (y - p)[w], size), np.bincount(index[w], (p * (1 - p))[w], size)

        def singles() -> None:
            for k, t in enumerate(self.tables):
                step = RATE * _step(*sums(b[:, k], len(t)))
                t += step
                z[:] += step[b[:, k]]

        boost(ROUNDS, singles)
        coarse = [self._pair(b, k) for k in range(x.shape[1])]
        two = lambda i, j: [s.reshape(PAIR_BINS, PAIR_BINS) for s in sums(coarse[i] * PAIR_BINS + coarse[j], PAIR_BINS**2)]
        gains = sorted(((-_quadrants(*two(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])))
        self.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
        self.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]

        def doubles() -> None:
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                step = RATE * _quadrants(*two(i, j))[1]
                t += step
                z[:] += step[coarse[i], coarse[j]]

        boost(PAIR_ROUNDS, doubles)
        return self


def held_out(doc_id) -> F.Column:
    """The fold no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """A model of labels.quality, from at most `sample` labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for b in common.slices(batches):
            x = features(*common.text_bytes(b.column("text"))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = texts.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality double, x binary").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("x").alias("x"))
    got = rows.orderBy("doc_id").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float64).reshape(-1, len(FEATURES))
    return Additive().fit(x, (got["quality"].to_numpy() >= 0.5).astype(float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches):
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(features(*common.text_bytes(b.column("text")))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Additive, least: float = ACCEPT) -> DataFrame:
    """The documents scored `least` or higher, in docs' own columns."""

    def run(batches):
        for batch in batches:
            for b in common.slices(iter([batch])):
                yield b.filter(pa.array(model.score(features(*common.text_bytes(b.column("text")))) >= least))

    return docs.mapInArrow(run, docs.schema)


def op1_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))

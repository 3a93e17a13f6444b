"""License scans by a positional rare-token index.

Each template is a short run of words. The corpus is counted first: how many documents hold each word of the
templates (the vocabulary is fixed, so the counts are a few dozen numbers). A template is found by its
rarest words: their postings in a file, shifted by the word's place in the template, are intersected with the
postings of the template's other words by relative position. An alignment counts as a (base) place if every
word stands; the method's own labels ask for most of the template's IDF weight and for its key phrases word
for word.

Edge cases: null and empty texts have no words, score 0 and empty labels; overlapping places all count;
repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates of the method, in lower-case words: label, words, phrases that must stand word for word.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted", "obtaining a copy")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial license", ("creative commons attribution", "noncommercial")),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify", "distribute this software")),
)
#: Share of a template's IDF weight that an alignment must hold.
LEAST = 0.8
#: Rarest words by which a template is looked up.
ANCHORS = 2


class Index:
    """The templates over their vocabulary, with IDF from the corpus; small and of fixed size."""

    def __init__(self, frequency: dict[str, int], n_docs: int):
        self.vocabulary = sorted({w for p in BASE for w in p.split()} | {w for _, t, _ in TEMPLATES for w in t.split()})
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        joined = np.frombuffer("".join(self.vocabulary).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in self.vocabulary])
        hashes = common.span_hash(common.prefix_hash(joined), np.r_[0, ends[:-1]], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.idf = np.array([math.log((1 + n_docs) / (1 + frequency.get(w, 0))) + 1e-3 for w in self.vocabulary])
        self.base = [(label, self._ids(p)) for p, label in BASE.items()]
        self.templates = [(label, self._ids(t), [self._ids(k) for k in keys]) for label, t, keys in TEMPLATES]

    def _ids(self, phrase: str) -> np.ndarray:
        return np.array([self.number[w] for w in phrase.split()])

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, else -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def alignments(self, postings: list[np.ndarray], doc: np.ndarray, template: np.ndarray, anchors: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, document): where the template may start by its rarest words, and the document these stand in; a start may lie before its document."""
        rare = sorted(range(len(template)), key=lambda j: (-self.idf[template[j]], j))[:anchors]
        start = np.concatenate([postings[template[j]] - j for j in rare])
        of = np.concatenate([doc[postings[template[j]]] for j in rare])
        order = np.lexsort((of, start))
        start, of = start[order], of[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (of[1:] != of[:-1])
        return start[new], of[new]


def _fits(ids: np.ndarray, doc: np.ndarray, starts: np.ndarray, of: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Which words of the template stand at their place, a row for each start; places outside the document `of` do not."""
    at = starts[:, None] + np.arange(len(template))
    inside = (at >= 0) & (at < len(ids))
    at = np.clip(at, 0, max(0, len(ids) - 1))
    return inside & (ids[at] == template) & (doc[at] == of[:, None])


def scan(data: np.ndarray, off: np.ndarray, index: Index) -> dict[str, list | np.ndarray]:
    """Of each document of a slice: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    n = len(off) - 1
    low = common.LOWER[data]
    starts, ends, doc = common.words(low, off, common.ALNUM)
    n_words = np.bincount(doc, minlength=n)
    ids = index.lookup(common.span_hash(common.prefix_hash(low), starts, ends)) if len(starts) else np.zeros(0, int)
    known = np.flatnonzero(ids >= 0)
    by = known[np.argsort(ids[known], kind="stable")]
    cuts = np.searchsorted(ids[by], np.arange(len(index.vocabulary) + 1))
    postings = [by[cuts[v] : cuts[v + 1]] for v in range(len(index.vocabulary))]
    word0 = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    first, last, n_base, score = np.full(n, -1), np.full(n, -1), np.zeros(n, int), np.zeros(n)
    base: list[set] = [set() for _ in range(n)]
    more: list[set] = [set() for _ in range(n)]
    for label, template in index.base:
        at, d = index.alignments(postings, doc, template, 1)
        if len(at):
            whole = _fits(ids, doc, at, d, template).all(1)
            at, d = at[whole], d[whole]
        n_base += np.bincount(d, minlength=n)
        for k, p in zip(d, at - word0[d], strict=True):
            first[k] = p if first[k] < 0 else min(first[k], p)
            last[k] = max(last[k], p)
            base[k].add(label)
        score[d] = 1.0
    for label, template, keys in index.templates:
        at, of = index.alignments(postings, doc, template, ANCHORS)
        if not len(at):
            continue
        weight = index.idf[template] / index.idf[template].sum()
        share = np.minimum(1.0, _fits(ids, doc, at, of, template) @ weight)
        for start, k, s in zip(at[share > 0], of[share > 0], share[share > 0], strict=True):
            around = np.arange(start - 1, start + len(template))
            whole = s >= LEAST and all(_fits(ids, doc, around, np.full(len(around), k), key).all(1).any() for key in keys)
            if whole:
                more[k].add(label)
            score[k] = max(score[k], s if whole else s / 2)
    return {
        "n_words": n_words, "n_base": n_base, "first_word": [None if x < 0 else int(x) for x in first], "last_word": [None if x < 0 else int(x) for x in last],
        "base_labels": [",".join(sorted(b)) for b in base], "labels": [",".join(sorted(b | m)) for b, m in zip(base, more, strict=True)], "score": score,
    }


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """Documents that hold each word of the templates, and documents in all; counted over every document."""

    def count(batches):
        index = Index({}, 0)
        seen, n = np.zeros(len(index.vocabulary), np.int64), 0
        for b in common.slices(batches):
            data, off = common.text_bytes(b.column("text"))
            low = common.LOWER[data]
            starts, ends, doc = common.words(low, off, common.ALNUM)
            n += b.num_rows
            if len(starts):
                ids = index.lookup(common.span_hash(common.prefix_hash(low), starts, ends))
                pair = np.unique(doc[ids >= 0] * len(index.vocabulary) + ids[ids >= 0])
                seen += np.bincount(pair % len(index.vocabulary), minlength=len(index.vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([*index.vocabulary, ""]), pa.array([*seen.tolist(), n], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def scan_licenses(docs: DataFrame) -> DataFrame:
    index = Index(*frequencies(docs))

    def run(batches):
        for b in common.slices(batches):
            got = scan(*common.text_bytes(b.column("text")), index)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(got[f.name], f.type) for f in list(_OUT)[1:]]], schema=_OUT)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op2_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))

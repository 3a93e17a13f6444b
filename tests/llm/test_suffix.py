import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from inkplane.llm import suffix_dedup as sd


def _brute(rows):
    seen: dict[bytes, int] = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - 49):
                seen[t[i : i + 50]] = min(seen.get(t[i : i + 50], d), d)
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - 49):
                if seen[t[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((-1 if d is None else d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def _check(df):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df).collect())
    want = _brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert [g[:4] for g in got] == [w[:4] for w in want] and got == want


def _corpus(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abé", k=rnd.randrange(1, 6)))
    lines = [" ".join(word() for _ in range(rnd.randrange(8, 22))) for _ in range(6)]
    texts = []
    for i in range(n):
        t = " ".join(word() for _ in range(rnd.choice([0, 3, 30, 90])))
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(t) + 1)
            piece = rnd.choice(lines) if rnd.random() < 0.6 or not texts else (lambda s: s[(a := rnd.randrange(len(s) + 1)) : a + rnd.randrange(40, 120)])(rnd.choice(texts))
            t = t[:k] + piece + t[k:]
        texts.append(rnd.choice(texts) if texts and rnd.random() < 0.1 else t)
    return [(rnd.randrange(10**6) if seed % 2 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_is_that_of_brute_force(spark, seed):
    _check(spark.createDataFrame(_corpus(seed), "doc_id long, text string").repartition(3))


def test_hot_anchors_by_windows(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 1)
    monkeypatch.setattr(sd, "CHUNK_BYTES", 2000)
    _check(spark.createDataFrame(_corpus(4), "doc_id long, text string"))


def test_hot_windows_of_one_hash_are_told_apart_by_bytes(monkeypatch):
    """Passages in chunks of their own, every window of one hash: only the bytes part them."""
    monkeypatch.setattr(sd, "HOT", 1)
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage = word(60)
    rows = [(i, word(80) + passage + word(80)) for i in range(6)]
    bits = 4
    held = []
    for i, t in rows:
        held.append((i, pa.table([pa.array([i]), pa.array([t])], names=["doc_id", "text"]), sd.Runs(pa.chunked_array([[t]]))))
    with monkeypatch.context() as m:
        m.setattr(sd, "window_hash", lambda data, start: np.ones(len(start), np.uint64))
        asked = sd._table([r for i, t, x in held for r in sd._held(x, bits, i)], sd._BLOB_NAMES, sd._BLOBS)
        codes = [sd._settle(asked.filter(pa.compute.equal(asked["bucket"], b))) for b in asked["bucket"].unique().to_pylist()]
        replies = pa.concat_tables(codes)
        mine = lambda table, i: table.filter(pa.compute.equal(table["chunk"], i))
        sent = []
        for i, t, x in held:
            ids = np.full(len(x.key), i)
            sent += sd._around(x, ids, sd._codes(x, mine(replies, i), bits, 0, x.key), bits, i)
        assert any(r[0] == 2 for r in sent)
        sent = sd._table(sent, sd._BLOB_NAMES, sd._BLOBS)
        keys = sorted({(r["kind"], r["bucket"]) for r in sent.to_pylist()})
        replies = pa.concat_tables([replies, *[sd._resolve(sent.filter(pa.compute.and_(pa.compute.equal(sent["kind"], k), pa.compute.equal(sent["bucket"], b)))) for k, b in keys]])
        got = [sd._finish(x, np.full(len(x.key), i), t["doc_id"], mine(replies, i), bits).to_pylist()[0] for i, t, x in held]
    assert [tuple(r.values()) for r in got] == _brute(rows)


def test_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 700)
    _check(spark.createDataFrame(_corpus(5, 80), "doc_id long, text string"))


def test_odd_rows(documents):
    small = documents.where("coalesce(length(text), 0) < 5000")
    _check(small)
    assert sd.remove_repeats(documents.where("false")).count() == 0
    long = {r.doc_id: r for r in sd.remove_repeats(documents).collect()}
    assert all(r.n_removed <= r.n_bytes for r in long.values())


def test_blind_trie_and_lcp():
    rnd = np.random.default_rng(0)
    s = rnd.integers(0, 2, (200, 12), dtype=np.uint8)
    strings = [r.tobytes() for r in s]
    order = sd.blind_trie(strings)
    assert [strings[i] for i in order] == sorted(strings)
    g = rnd.integers(0, 3, 200)
    order, lcp = sd.deep_shallow(g, s)
    assert [(g[i], strings[i]) for i in order] == sorted(zip(g, strings, strict=True))
    for k in range(1, 200):
        i, j = order[k - 1], order[k]
        want = -1 if g[i] != g[j] else next((p for p in range(12) if s[i, p] != s[j, p]), 12)
        assert lcp[k] == want

"""Suffix-array dedup: bytes of LENGTH-byte strings that also start in an earlier document are removed.

Documents are dealt in chunks of about CHUNK_BYTES, ascending ranges of doc_id cut where the running sum of bytes says,
so "an earlier document" is one of an earlier chunk or an earlier one of the same chunk. Every LENGTH-byte window has an anchor, the KEY-byte string of smallest
hash within it; neighbouring windows of one anchor make a run. Equal windows have equal anchors, so:

1. Chunks tell which anchors they hold, and the 64-bit hash of each one's run (a mark if they hold different runs).
   An anchor with one run everywhere is settled: all documents but the first lose it. Two different runs would have to
   agree in 64 bits of their own and in 36 to 63 of their anchors'.
2. Where runs differ (the ends of a repeated passage, or chance), each chunk sends the text around the anchor,
   once a run. The texts right of an anchor and, backwards, left of it are sorted as suffixes, deep-shallow:
   by anchor and SHALLOW bytes first, then a blind trie for each group that is still equal. Two occurrences
   share the windows that their longest common prefixes on both sides leave room for.
3. An anchor of very many chunks sends its windows instead, each once a chunk; these are spread by the hash of the
   window, so no task gathers a common passage's occurrences, and sorted deep-shallow: bytes decide here too.

All steps are one plan over one exchange of the texts, which Spark reads again for each step.

Edge cases: null texts count as empty; documents under LENGTH bytes keep all; rows that repeat a doc_id do not
remove from each other; rows of null doc_id come in no order: they keep all and remove nothing; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, KEY = 50, 24
#: Bytes to either side of an anchor that its windows reach.
SIDE = LENGTH - KEY
SHALLOW = 8
#: Bytes of text in a chunk, anchors of a bucket, and chunks beyond which an anchor is handled by its windows.
CHUNK_BYTES, BUCKET, HOT = 4 << 20, 1 << 18, 1024

_U = np.uint64
_LOW = _U(0xFFFFFFFF)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    m, have = v, 1
    while have * 2 <= width:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if have < width else m


class Runs:
    """Runs of the documents of a chunk: row of the document, anchor's hash, run's hash, first window, windows, anchor's place."""

    def __init__(self, texts: pa.ChunkedArray):
        self.parts = []
        parts, row = [], 0
        arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        batch = pa.RecordBatch.from_arrays([arr], names=["text"])
        for b in common.slices(iter([batch])):
            data, off = common.text_bytes(b.column("text"))
            self.parts.append((row, data, off))
            if len(data) >= LENGTH:
                parts.append(self._of(data, off, row, len(self.parts) - 1))
            row += b.num_rows
        names = ("row", "key", "run", "first", "count", "anchor", "part")
        empty = [np.zeros(0, t) for t in (np.int64, _U, _U, np.int64, np.int64, np.int64, np.int64)]
        for name, x in zip(names, [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else empty, strict=True):
            setattr(self, name, x)

    @staticmethod
    def _of(data, off, row, part):
        h = common.prefix_hash(data)
        at = np.arange(len(data) - KEY + 1)
        grams = common.span_hash(h, at, at + KEY)
        anchor = (_sliding_min((grams & ~_LOW) | at.astype(_U), SIDE + 1) & _LOW).astype(np.int64)
        sizes = np.maximum(np.diff(off) - LENGTH + 1, 0)
        docs = np.flatnonzero(sizes)
        n = sizes[docs]
        doc = np.repeat(docs, n)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[docs], n)
        a = anchor[start]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]) if len(a) else np.zeros(0, np.int64)
        count = np.diff(np.r_[new, len(a)])
        s = start[new]
        return doc[new] + row, grams[a[new]], common.span_hash(h, s, s + count + LENGTH - 1), s, count, a[new], np.full(len(new), part)

    def sides(self, i: np.ndarray) -> np.ndarray:
        """Of some runs' anchors: SIDE bytes to the left, backwards, then SIDE to the right; beyond the text they are 0."""
        out = np.zeros((len(i), 2 * SIDE), np.uint8)
        for p in np.unique(self.part[i]):
            _, data, _ = self.parts[p]
            own = np.flatnonzero(self.part[i] == p)
            a = self.anchor[i[own]][:, None]
            at = np.concatenate([a - 1 - np.arange(SIDE), a + KEY + np.arange(SIDE)], axis=1)
            out[own] = np.where((at >= 0) & (at < len(data)), data[np.clip(at, 0, len(data) - 1)], 0)
        return out

    def windows(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(run, window's start, hash, bytes) of every window of some runs."""
        n = self.count[i]
        run = np.repeat(i, n)
        start = np.repeat(self.first[i], n) + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        hashes, text = np.zeros(len(run), _U), np.zeros((len(run), LENGTH), np.uint8)
        for p in np.unique(self.part[i]):
            own = np.flatnonzero(self.part[run] == p)
            hashes[own] = window_hash(self.parts[p][1], start[own])
            text[own] = np.lib.stride_tricks.sliding_window_view(self.parts[p][1], LENGTH)[start[own]]
        return run, start, hashes, text


def window_hash(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the windows at some places; they deal and order windows, equality is that of the bytes."""
    return common.mix(common.span_hash(common.prefix_hash(data), start, start + LENGTH))


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (the first leads) and where in it a new group begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, new


def _same(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows by hash and where in it other bytes begin."""
    order, new = _grouped(hashes)
    t = text[order]
    if ((t[1:] != t[:-1]).any(1) & ~new[1:]).any():  # one hash of different windows
        order, lcp = deep_shallow(hashes, text)
        new = lcp < LENGTH
    return order, new


def _least(ids: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each element the smallest id of its group."""
    if not len(order):
        return ids
    starts = np.flatnonzero(new)
    out = np.empty_like(ids)
    out[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.r_[starts, len(order)]))
    return out


def _ranges(key: np.ndarray) -> list[tuple[int, int]]:
    """From and to of the stretches of equal keys."""
    if not len(key):
        return []
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _packed(bits: int, hashes: np.ndarray, second: np.ndarray, chunk: int, kind: int) -> list[tuple]:
    """Rows (kind, bucket, chunk, blob, blob) of ascending hashes: 32 bits below the bucket's, and a second number each."""
    bucket = (hashes >> _U(64 - bits)).astype(np.int64)
    low = ((hashes >> _U(32 - bits)) & _LOW).astype(np.uint32)
    return [(kind, int(bucket[a]), chunk, low[a:b].tobytes(), second[a:b].tobytes()) for a, b in _ranges(bucket)]


def _table(rows: list[tuple], names: str, types: tuple) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names.split())


_BLOBS = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
_BLOB_SQL = "kind int, bucket long, chunk long, a binary, b binary"
_BLOB_NAMES = "kind bucket chunk a b"


def _held(runs: Runs, bits: int, chunk: int) -> list[tuple]:
    """Step 1's rows: each anchor once, with its run's hash, 0 if it has several."""
    order, new = _grouped(runs.key)
    starts = np.flatnonzero(new)
    if not len(starts):
        return []
    r = runs.run[order]
    low, high = np.minimum.reduceat(r, starts), np.maximum.reduceat(r, starts)
    mark = np.where(low == high, np.maximum(low, _U(1)), _U(0))
    return _packed(bits, runs.key[order][starts], mark, chunk, 0)


def _settle(table: pa.Table) -> pa.Table:
    """Codes of a bucket's anchors, to the chunks that hold them: 1 an earlier chunk has the same run, 2 runs differ, 3 they differ and the anchor is hot. None otherwise."""
    chunk, a, b = table["chunk"].to_numpy(), table["a"].to_pylist(), table["b"].to_pylist()
    keys = [np.frombuffer(x, np.uint32) for x in a]
    of = np.repeat(chunk, [len(x) for x in keys])
    key, mark = np.concatenate(keys), np.concatenate([np.frombuffer(x, _U) for x in b])
    order, new = _grouped(key, of)
    starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    size = np.diff(np.r_[starts, len(order)])
    m = mark[order]
    differ = (np.minimum.reduceat(m, starts) != np.maximum.reduceat(m, starts)) | (m[starts] == 0)
    first = np.zeros(len(order), bool)
    first[starts] = True
    code = np.where(np.repeat(differ, size), np.where(np.repeat(size > HOT, size), 3, 2), np.where(first, 0, 1)).astype(np.uint8)
    k, c = key[order], of[order]
    want = np.flatnonzero(code)
    back = want[np.lexsort((k[want], c[want]))]
    bucket = table["bucket"][0].as_py()
    rows = [(0, bucket, int(c[back[s]]), k[back[s:t]].tobytes(), code[back[s:t]].tobytes()) for s, t in _ranges(c[back])]
    return _table(rows, _BLOB_NAMES, _BLOBS)


def _codes(runs: Runs, replies: pa.Table, bits: int, kind: int, hashes: np.ndarray) -> np.ndarray:
    """The code of each hash, 0 where none came back."""
    out = np.zeros(len(hashes), np.uint8)
    rows = [(b, x, y) for k, b, x, y in zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["a"].to_pylist(), replies["b"].to_pylist(), strict=True) if k == kind]
    if not rows or not len(hashes):
        return out
    rows.sort(key=lambda r: r[0])
    known = np.concatenate([(_U(b) << _U(32)) | np.frombuffer(x, np.uint32).astype(_U) for b, x, _ in rows])
    codes = np.concatenate([np.frombuffer(y, np.uint8) for _, _, y in rows])
    mine = hashes >> _U(32 - bits)
    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    return np.where(known[at] == mine, codes[at], 0).astype(np.uint8)


def _bit(replies: pa.Table, n: int) -> np.ndarray:
    """Step 3's answers, of the n different windows that this chunk sent, in their order."""
    rows = sorted((b, y) for k, b, y in zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["b"].to_pylist(), strict=True) if k == 2)
    got = np.frombuffer(b"".join(y for _, y in rows), np.uint8)
    assert len(got) == n
    return got.astype(bool)


def _senders(runs: Runs, ids: np.ndarray, code: np.ndarray):
    """For runs whose anchor has differing ones: which are the first of their run in the chunk, in order of anchor and run."""
    some = np.flatnonzero(code >= 2)
    order, new = _grouped(runs.key[some], runs.run[some], ids[some])
    s = some[order]
    if not len(s):
        return s
    first = np.r_[True, (runs.key[s][1:] != runs.key[s][:-1]) | (runs.run[s][1:] != runs.run[s][:-1])]
    return s[first]


def _around(runs: Runs, ids: np.ndarray, code: np.ndarray, bits: int, chunk: int) -> list[tuple]:
    """Steps 2 and 3: texts around anchors (kind 1), windows (kind 2)."""
    senders = _senders(runs, ids, code)
    cold, hot = senders[code[senders] == 2], senders[code[senders] == 3]
    rows = []
    if len(cold):
        bucket = (runs.key[cold] >> _U(64 - bits)).astype(np.int64)
        reach = runs.anchor[cold] - runs.first[cold]
        head = np.column_stack([runs.key[cold].view(np.int64), ids[cold], reach - runs.count[cold] + 1, reach]).astype(np.int64)
        sides = runs.sides(cold)
        rows += [(1, int(bucket[a]), chunk, head[a:b].tobytes(), sides[a:b].tobytes()) for a, b in _ranges(bucket)]
    if len(hot):
        _, _, hashes, text = runs.windows(hot)
        order, new = _same(hashes, text)
        hashes, text = hashes[order[new]], text[order[new]]
        bucket = (hashes >> _U(64 - bits)).astype(np.int64)
        rows += [(2, int(bucket[a]), chunk, hashes[a:b].tobytes(), text[a:b].tobytes()) for a, b in _ranges(bucket)]
    return rows


def blind_trie(strings: list[bytes]) -> list[int]:
    """Indices of strings of one length in their order. Nodes know only where their strings part; a string is compared whole once."""
    same: list[list[int]] = [[0]]
    root: list | int = 0  # a leaf is a number of `same`; a node is [place, {byte: node}]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        t = strings[same[node][0]]
        if s == t:
            same[node].append(i)
            continue
        p = next(k for k in range(len(s)) if s[k] != t[k])
        same.append([i])
        leaf, above, node = len(same) - 1, None, root
        while not isinstance(node, int) and node[0] < p:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == p:
            node[1][s[p]] = leaf
        else:
            parted = [p, {t[p]: node, s[p]: leaf}]
            if above is None:
                root = parted
            else:
                above[1][s[above[0]]] = parted
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out += same[node]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long strings (rows of bytes) by group, then text; and each one's longest common prefix with the one before, -1 at a group's start.

    The first SHALLOW bytes are sorted as one wide character; groups that agree in them go through a blind trie.
    """
    head = np.ascontiguousarray(strings[:, :SHALLOW]).view(">u8").ravel().astype(_U)
    order, new = _grouped(group, head)
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(order)].astype(int)
    s = strings[order]
    apart = np.r_[False, (s[1:] != s[:-1]).any(1)] if len(order) else np.zeros(0, bool)
    apart[starts] = False
    several = np.add.reduceat(apart, starts) > 0 if len(starts) else starts  # a group of one string is a leaf of its trie
    for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
        own = order[a:b]
        order[a:b] = own[blind_trie([x.tobytes() for x in s[a:b, SHALLOW:]])]
    s, g = strings[order], group[order]
    lcp = np.full(len(order), -1)
    if len(order) > 1:
        apart = s[1:] != s[:-1]
        lcp[1:] = np.where(g[1:] != g[:-1], -1, np.where(apart.any(1), apart.argmax(1), strings.shape[1]))
    return order, lcp


def _owned(group: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """For each occurrence of an anchor a mask of its windows (bit: bytes left of the anchor) that a smaller id has too."""
    n = len(group)
    left_order, left = deep_shallow(group, sides[:, :SIDE])
    right_order, right = deep_shallow(group, sides[:, SIDE:])
    mask = np.zeros(n, np.uint32)
    for reach in range(SIDE + 1):
        there = np.flatnonzero((low <= reach) & (reach <= high))
        if len(there) < 2:
            continue
        same_left, same_right = np.empty(n, np.int64), np.empty(n, np.int64)
        same_left[left_order] = np.cumsum((left < reach) | (left < 0))
        same_right[right_order] = np.cumsum((right < SIDE - reach) | (right < 0))
        order, new = _grouped(same_left[there], same_right[there])
        least = _least(ids[there], order, new)
        mask[there] |= np.where(least < ids[there], np.uint32(1) << np.uint32(reach), np.uint32(0)).astype(np.uint32)
    return mask


def _resolve(table: pa.Table) -> pa.Table:
    """Answers of a bucket to steps 2 (kind 1: a mask for each text sent, in their order) and 3 (kind 2: a flag for each window sent, whether an earlier chunk has it)."""
    kind = table["kind"][0].as_py()
    chunk, bucket = table["chunk"].to_numpy(), table["bucket"][0].as_py()
    a, b = table["a"].to_pylist(), table["b"].to_pylist()
    if kind == 2:
        hashes = [np.frombuffer(x, _U) for x in a]
        of = np.repeat(chunk, [len(x) for x in hashes])
        order, lcp = deep_shallow(np.concatenate(hashes), np.frombuffer(b"".join(b), np.uint8).reshape(-1, LENGTH))
        gone = (of > _least(of, order, lcp < LENGTH)).astype(np.uint8)
        cuts = np.cumsum([0, *map(len, hashes)])
        return _table([(2, bucket, int(c), b"", gone[s:t].tobytes()) for c, s, t in zip(chunk, cuts[:-1], cuts[1:], strict=True)], _BLOB_NAMES, _BLOBS)
    heads = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in a]
    head, sides = np.concatenate(heads), np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 2 * SIDE) for x in b])
    mask = _owned(head[:, 0], head[:, 1], head[:, 2], head[:, 3], sides)
    cuts = np.cumsum([0, *map(len, heads)])
    return _table([(1, bucket, int(c), b"", mask[s:t].tobytes()) for c, s, t in zip(chunk, cuts[:-1], cuts[1:], strict=True)], _BLOB_NAMES, _BLOBS)


def _removed(runs: Runs, ids: np.ndarray, replies: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, from, to) of the removed bytes."""
    code = _codes(runs, replies, bits, 0, runs.key)
    order, new = _grouped(runs.key, runs.run)
    whole = (code == 1) | (ids > _least(ids, order, new))
    senders = _senders(runs, ids, code)
    cold, hot = senders[code[senders] == 2], np.flatnonzero((code == 3) & ~whole)
    rows = sorted((b, y) for k, b, y in zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["b"].to_pylist(), strict=True) if k == 1)
    mask = np.zeros(len(runs.key), np.uint32)
    if len(cold):
        mask[cold] = np.frombuffer(b"".join(y for _, y in rows), np.uint32)
        # occurrences of the same run by the same smallest id lose what the sender loses
        first = np.empty(len(order), np.int64)
        g = np.cumsum(new) - 1
        first[order] = g
        by_group = np.zeros(int(g[-1]) + 1, np.uint32)
        by_group[first[cold]] = mask[cold]
        mask = np.where((code == 2) & ~whole, by_group[first], 0)
    own = np.flatnonzero(mask)
    bit = ((mask[own][:, None] >> np.arange(SIDE + 1, dtype=np.uint32)) & 1).astype(bool)
    r, reach = np.nonzero(bit)
    parts = [(runs.part[whole], runs.first[whole], runs.first[whole] + runs.count[whole] + LENGTH - 1)]
    parts.append((runs.part[own[r]], runs.anchor[own[r]] - reach, runs.anchor[own[r]] - reach + LENGTH))
    if len(hot):
        # the windows sent, then those to judge, then those of runs that are whole already: an earlier document of the chunk may hold the same
        sets = [runs.windows(x) for x in (senders[code[senders] == 3], hot, np.flatnonzero((code == 3) & whole))]
        run, start, h, text = (np.concatenate(x) for x in zip(*sets, strict=True))
        sent, upto = len(sets[0][0]), len(sets[0][0]) + len(sets[1][0])
        o, n = _same(h, text)
        group = np.empty(len(o), np.int64)
        group[o] = np.cumsum(n) - 1
        earlier = np.zeros(int(n.sum()), bool)
        so, sn = _same(h[:sent], text[:sent])
        there = group[so[sn]]
        earlier[there] = _bit(replies, len(there))
        gone = (earlier[group] | (ids[run] > _least(ids[run], o, n)))[sent:upto]
        run, start = run[sent:upto][gone], start[sent:upto][gone]
        parts.append((runs.part[run], start, start + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(runs: Runs, ids: np.ndarray, doc_ids: pa.ChunkedArray, replies: pa.Table, bits: int) -> pa.Table:
    part, a, b = _removed(runs, ids, replies, bits)
    rows = []
    for p, (_, data, off) in enumerate(runs.parts):
        own = part == p
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, a[own], 1)
        np.add.at(change, b[own], -1)
        gone = np.cumsum(change[:-1]) > 0
        for s, t in zip(off[:-1], off[1:], strict=True):
            g = gone[s:t]
            n = int(g.sum())
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
            kept = data[s:t][~g] if n else data[s:t]
            rows.append((int(t - s), n, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([doc_ids, *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _bounds(d: DataFrame, parts: int) -> np.ndarray:
    """Last doc_id of every chunk but the last, ascending: eight bytes for each CHUNK_BYTES of text, or two chunks a task of a small table.

    Documents are summed up in ranges of doc_id; a document's chunk is where the running sum before it lies.
    """
    size = d.where("doc_id is not null").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"))
    placed = common.running(size, ["doc_id"], {"before": "n"})
    total = size.agg(F.sum("n")).first()[0] or 0
    step = max(1, min(CHUNK_BYTES, -(-total // parts)))
    lasts = placed.groupBy(F.floor(F.col("before") / step).alias("chunk")).agg(F.max("doc_id").alias("last"))
    return np.sort(lasts.toArrow()["last"].to_numpy())[:-1]


def _dealt(d: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(chunk, block): packed rows of each chunk."""
    sent = d.sparkSession.sparkContext.broadcast(bounds)

    def number(batches):
        for b in batches:
            chunk = np.searchsorted(sent.value, b.column("doc_id").to_numpy(), "left").astype(np.int64)
            yield b.append_column("chunk", pa.array(chunk))

    return common.packed(d.where("doc_id is not null"), "chunk", number)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = common.partitions(spark)
    bits = min(31, max(4, int(total / 14 / BUCKET).bit_length()))
    bounds = _bounds(d, parts)
    dealt = _dealt(d, bounds).repartition(max(parts, (len(bounds) + 1) // 16), "chunk")

    def rows_of(blocks: pa.Table) -> tuple[pa.Table, Runs, np.ndarray]:
        t = common.unpacked(blocks["block"])
        runs = Runs(t["text"])
        return t, runs, t["doc_id"].to_numpy()[runs.row]

    def hold(blocks: pa.Table) -> pa.Table:
        return _table(_held(rows_of(blocks)[1], bits, blocks["chunk"][0].as_py()) if blocks.num_rows else [], _BLOB_NAMES, _BLOBS)

    def send(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        if not blocks.num_rows or not replies.num_rows:
            return _table([], _BLOB_NAMES, _BLOBS)
        _, runs, ids = rows_of(blocks)
        return _table(_around(runs, ids, _codes(runs, replies, bits, 0, runs.key), bits, blocks["chunk"][0].as_py()), _BLOB_NAMES, _BLOBS)

    def finish(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        t, runs, ids = rows_of(blocks)
        return _finish(runs, ids, t["doc_id"], replies, bits)

    by_chunk = dealt.groupBy("chunk")
    codes = by_chunk.applyInArrow(hold, _BLOB_SQL).groupBy("bucket").applyInArrow(_settle, _BLOB_SQL)
    answers = by_chunk.cogroup(codes.groupBy("chunk")).applyInArrow(send, _BLOB_SQL).groupBy("kind", "bucket").applyInArrow(_resolve, _BLOB_SQL)
    out = by_chunk.cogroup(codes.unionByName(answers).groupBy("chunk")).applyInArrow(finish, _OUT)
    sha = F.sha2("text", 256)
    unordered = d.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), sha.alias("kept_sha256"))
    return out.unionByName(unordered)


def op5_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))

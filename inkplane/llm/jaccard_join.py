"""N-gram Jaccard join, size-aware and heavy-light.

A document is its set of distinct shingles (WIDTH words; fewer words make one shingle). Documents of equal
sets form a class; the join runs on classes. The shingles of all documents are counted, and every set is
ordered with frequent shingles last, rarest first among them. Two sets with Jaccard >= LEAST share a shingle
within the first |s| - ceil(LEAST |s|) + 1 of both, and two shingles if one more is taken; therefore

* a small set enumerates its 2-subsets of that longer prefix,
* a large set enters the inverted list of each shingle of its prefix, as does a small one near enough in size
  to a large partner,

the boundary being the size at which the two ways cost least in total. Short inverted lists give their pairs
of fitting size and position at once. Long (heavy) lists give star pairs to their first set; once those are
verified, only pairs of different components and of fitting sizes are left of a heavy list: its entries are dealt in
bands of size, and neighbouring bands meet in square cells.

Candidate pairs are sifted by counts of their hashes in PARTS parts (an upper bound of the intersection), then
verified on the whole sets. Links are united into components.

Edge cases: null and empty texts have no shingle and link with nothing; repeated rows are of one class; rows
that repeat a doc_id link as one document; rows of null doc_id get their class's component (null if no
doc_id is in reach); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components, merged

WIDTH = 5
#: Least intersection of 100 parts of the union.
LEAST = 75
#: Shingles told apart by frequency: so many at most, of so many documents at least. The rest count as rare; this orders sets, and drops nothing.
FREQUENT, FREQUENT_FROM = 1 << 18, 16
#: An inverted list longer than this is heavy.
LIGHT = 24
#: Orders of the sets by which heavy lists choose their first one, so that a set meets several; a power of 2.
LEADERS = 32
#: Sets a side of a cell of a heavy list, and entries of a hot list before it is salted.
CELL, SALT_ROWS = 4096, 1 << 16
#: Parts in which a set's hashes are counted; a power of 2.
PARTS = 512
#: Shingle hashes a task gathers before it hands them on, and of one bucket of the count on average.
FLUSH, BUCKET = 1 << 21, 1 << 20

_ODD = np.random.default_rng(7).integers(1, 1 << 63, WIDTH + 1, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document of a slice, in this order."""
    low = common.LOWER[data]
    starts, ends, doc = common.words(low, off, common.SPACED)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = common.span_hash(common.prefix_hash(low), starts, ends)
    n_words = np.bincount(doc, minlength=len(off) - 1)
    full = np.flatnonzero(doc[width - 1 :] == doc[: len(doc) - width + 1]) if len(doc) >= width else np.zeros(0, np.int64)
    h = np.zeros(len(full), np.uint64)
    for k in range(width):
        h += w[full + k] * _ODD[k]
    few = n_words[doc] < width
    at = np.flatnonzero(few & np.r_[True, doc[1:] != doc[:-1]])
    h2 = (n_words[doc[at]].astype(np.uint64)) * _ODD[width]
    for k in range(width - 1):
        inside = np.flatnonzero(n_words[doc[at]] > k)
        h2[inside] += w[at[inside] + k] * _ODD[k]
    d, h = np.concatenate([doc[full], doc[at]]), common.mix(np.concatenate([h, h2]))
    order = common.order_in(d, h)
    d, h = d[order], h[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]
    return d[new], h[new]


def _classes(d: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and class (a hash of the set, the same for equal sets) of each document of a slice."""
    size = np.bincount(d, minlength=n)
    total = np.zeros(n, np.uint64)
    np.add.at(total, d, common.mix(h ^ np.uint64(0x5BF03635F0A5B3C1)))
    return size, common.mix(total + size.astype(np.uint64)).view(np.int64)


def _prefix(n: np.ndarray) -> np.ndarray:
    """Shingles of which any linked partner shares one: n - ceil(LEAST/100 n) + 1."""
    return n - -(-n * LEAST // 100) + 1


def _fit(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n1, n2) >= LEAST * np.maximum(n1, n2)


def _overlap(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Least intersection of two linked sets."""
    return -(-LEAST * (n1 + n2) // (100 + LEAST))


def _stats(batches):
    """doc_id, digest of the text, size, class, and a sketch: counts of the hashes by their first bits (255: or more)."""
    for b in common.slices(batches):
        d, h = shingles(*common.text_bytes(b.column("text")))
        n, c = _classes(d, h, b.num_rows)
        part = (h >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)
        counts = np.minimum(np.bincount(d * PARTS + part, minlength=PARTS * b.num_rows), 255).astype(np.uint8).reshape(-1, PARTS)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(n, pa.int64()), pa.array(c), pa.array([c_.tobytes() for c_ in counts], pa.binary())], names=["doc_id", "digest", "n_shingles", "class", "sketch"])


def _frequent(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent shingles (the first `bits` of their hashes, ascending) with the documents that hold them, counted over all documents.

    A task sorts and combines what it has gathered, and hands on one packed list a bucket of the hash.
    """
    b_bits = max(4, math.ceil(math.log2(max(1, total) / BUCKET))) if total > BUCKET else 4
    bits = min(63, b_bits + 32)

    def gather(batches):
        held, n = [], 0

        def out():
            key, count = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(key >> np.uint64(32), np.arange((1 << b_bits) + 1, dtype=np.uint64))
            low = key.astype(np.uint32)
            rows = []
            for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    many = count[a:b] > 1
                    rows.append((bucket, low[a:b][~many].tobytes(), low[a:b][many].tobytes(), count[a:b][many].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "once", "many", "counts"])

        for b in common.slices(batches):
            _, h = shingles(*common.text_bytes(b.column("text")))
            held.append(h >> np.uint64(64 - bits))
            n += len(h)
            if n >= FLUSH:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def count(table: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(table["once"].to_pylist()), np.uint32)
        many = np.frombuffer(b"".join(table["many"].to_pylist()), np.uint32)
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32)
        key = np.concatenate([once, many])
        order = np.argsort(key)
        key, n = key[order], np.concatenate([np.ones(len(once), np.int64), counts])[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        n = np.add.reduceat(n, first) if len(first) else n
        often = n >= FREQUENT_FROM
        bucket = table["bucket"][0].as_py() if table.num_rows else 0
        return pa.table({"key": pa.array(key[first][often].astype(np.int64) + (bucket << 32), pa.int64()), "n": pa.array(n[often], pa.int64())})

    packed = docs.mapInArrow(gather, "bucket long, once binary, many binary, counts binary")
    often = packed.groupBy("bucket").applyInArrow(count, "key long, n long")
    got = often.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    key, n = got["key"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(key)
    return key[order].astype(np.uint64), n[order], bits


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """Largest size of a small set: where subsets of two and inverted lists of a mean length cost least in total."""
    best, at = math.inf, 0
    for limit in (0, 4, 6, 8, 12, 16, 24, 32, 48, 64):
        small = sum(c * math.comb(int(_prefix(np.array(n))) + 1, 2) for n, c in sizes.items() if n <= limit)
        listed = sum(c * int(_prefix(np.array(n))) * list_length for n, c in sizes.items() if n * 100 >= limit * LEAST)
        if small + listed < best:
            best, at = small + listed, limit
    return at


def _signatures(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, int], small: int) -> DataFrame:
    """(sig, salt, class, n, pos) of each class that a task meets; pos is a shingle's place in the order, -1 of a subset's;
    salt is -1 of lists that are not salted: those of no more documents than the least frequent shingle told apart."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        keys, counts, bits = sent.value
        met: set = set()
        for b in common.slices(batches):
            d, h = shingles(*common.text_bytes(b.column("text")))
            if not len(d):
                continue
            size, c = _classes(d, h, b.num_rows)
            fresh = np.zeros(b.num_rows, bool)
            for i in np.flatnonzero(size):
                if (k := int(c[i])) not in met:
                    met.add(k)
                    fresh[i] = True
            d, h = d[fresh[d]], h[fresh[d]]
            if not len(d):
                continue
            df = np.zeros(len(h), np.int64)
            if len(keys):
                short = h >> np.uint64(64 - bits)
                at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                df = np.where(keys[at] == short, counts[at], 0)
            order = np.argsort(d * (1 << 32) + np.minimum(df, (1 << 32) - 1), kind="stable")  # nearly sorted already
            d, h, df = d[order], h[order], df[order]
            pos = np.arange(len(d)) - np.searchsorted(d, d)
            n = size[d]
            p = _prefix(n)
            listed = (pos < p) & (100 * n >= LEAST * (small + 1))
            salts = 1 + df[listed] // SALT_ROWS
            cls = c[d]
            parts = [(h[listed].view(np.int64), np.where(salts > 1, cls[listed] % salts, -1).astype(np.int32), cls[listed], n[listed], pos[listed])]
            if small:
                own = np.flatnonzero((n <= small) & (pos <= p))
                for gap in range(1, int(_prefix(np.array(small))) + 1):
                    i = own[own + gap < len(d)]
                    i = i[(d[i + gap] == d[i]) & (pos[i] + gap <= p[i])]
                    sig = common.mix(np.minimum(h[i], h[i + gap]) * _ODD[0] + np.maximum(h[i], h[i + gap]) * _ODD[1])
                    often = 1 + np.minimum(df[i], df[i + gap]) // SALT_ROWS  # as long as the list may be
                    parts.append((sig.view(np.int64), np.where(often > 1, cls[i] % often, -1).astype(np.int32), cls[i], n[i], np.full(len(i), -1)))
            sig, salt, cl, nn, pp = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(salt), pa.array(cl), pa.array(nn, pa.int32()), pa.array(pp, pa.int32())], names=["sig", "salt", "class", "n", "pos"])

    return docs.mapInArrow(run, "sig long, salt int, class long, n int, pos int")


def _worth(n1, p1, n2, p2):
    """Whether two entries of a list can link: sizes fit, and enough shingles are left from their places on."""
    left = 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return _fit(n1, n2) & ((p1 < 0) | (p2 < 0) | (left >= _overlap(n1, n2)))


def _lists(batches):
    """Walks entries sorted by list. Light lists give pairs (a, b); heavy and salted ones star pairs and their own entries (kind 1)."""
    tail: list[np.ndarray] | None = None
    leader: tuple | None = None  # of a heavy list that goes on: (sig, salt, class, n, pos)

    def out(kind, sig, a, b, n, pos):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(sig), pa.array(a), pa.array(b), pa.array(n, pa.int32()), pa.array(pos, pa.int32())], names=["kind", "sig", "a", "b", "n", "pos"])

    def made(cols, upto_end):
        nonlocal tail, leader
        sig, salt, cls, n, pos = cols
        new = np.r_[True, (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])]
        keep = np.r_[True, new[1:] | (cls[1:] != cls[:-1])]
        sig, salt, cls, n, pos, new = (x[keep] for x in (sig, salt, cls, n, pos, new))
        starts = np.flatnonzero(new)
        lengths = np.diff(np.r_[starts, len(sig)])
        going_on = leader is not None and leader[:2] == (sig[0], salt[0])
        if not upto_end and lengths[-1] <= LIGHT and not (going_on and len(starts) == 1):
            cut = starts[-1]
            tail = [x[cut:] for x in (sig, salt, cls, n, pos)]
            sig, salt, cls, n, pos = (x[:cut] for x in (sig, salt, cls, n, pos))
            starts, lengths = starts[:-1], lengths[:-1]
        else:
            tail = None
        if not len(starts):
            return
        heavy = (lengths > LIGHT) | (salt[starts] >= 0)
        heavy[0] |= going_on
        for at, length in zip(starts[heavy], lengths[heavy], strict=True):
            s = slice(at, at + length)
            if not (going_on and at == 0):
                leader = (sig[at], salt[at], cls[at], n[at], pos[at])
            other = cls[s] != leader[2]
            fits = other & _fit(n[s], np.full(length, leader[3]))
            a = np.full(int(fits.sum()), leader[2])
            yield out(0, np.zeros(len(a), np.int64), np.minimum(a, cls[s][fits]), np.maximum(a, cls[s][fits]), np.zeros(len(a)), np.zeros(len(a)))
            yield out(1, sig[s], cls[s], cls[s], n[s], pos[s])
        light = (lengths > 1) & ~heavy
        group = np.repeat(np.arange(len(lengths)), lengths)
        most = int(lengths[light].max()) if light.any() else 0
        for gap in range(1, most):
            i = np.flatnonzero((group[gap:] == group[:-gap]) & light[group[:-gap]])
            i = i[(cls[i] != cls[i + gap]) & _worth(n[i], pos[i], n[i + gap], pos[i + gap])]
            if len(i):
                a, b = np.minimum(cls[i], cls[i + gap]), np.maximum(cls[i], cls[i + gap])
                pair = np.unique(np.column_stack([a, b]), axis=0)
                yield out(0, np.zeros(len(pair), np.int64), pair[:, 0], pair[:, 1], np.zeros(len(pair)), np.zeros(len(pair)))

    for b in batches:
        if b.num_rows:
            cols = [b.column(c).to_numpy() for c in ("sig", "salt", "class", "n", "pos")]
            if tail is not None:
                cols = [np.concatenate(x) for x in zip(tail, cols, strict=True)]
                tail = None
            yield from made(cols, False)
    if tail is not None:
        yield from made(tail, True)


def _sift(batches):
    """Pairs whose sizes fit and whose counts leave room for the intersection they need."""
    for b in batches:
        if not b.num_rows:
            continue
        n1, n2 = b.column("n1").to_numpy(), b.column("n2").to_numpy()
        c1, c2 = (np.frombuffer(b"".join(b.column(s).to_pylist()), np.uint8).reshape(-1, PARTS) for s in ("s1", "s2"))
        room = np.minimum(c1, c2).sum(1, dtype=np.int64)
        keep = _fit(n1, n2) & ((room >= _overlap(n1, n2)) | (c1 == 255).any(1) | (c2 == 255).any(1))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches):
    for b in batches:
        keep = []
        for s, t in zip(b.column("s1"), b.column("s2"), strict=True):
            x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, True))
            keep.append(100 * both >= LEAST * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


#: Bits of the filter that tells which classes' sets are worth shipping.
_FILTER_BITS = 22


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) that sketches and sizes let pass."""
    side = lambda c, n, s: sketches.select(F.col("class").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
    return common.written(pairs.distinct().join(side("a", "n1", "s1"), "a").join(side("b", "n2", "s2"), "b").mapInArrow(_sift, "a long, b long"))


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, set) of the classes, and of a few others: a bit table of fixed size tells which documents to take."""
    low = F.col("class").bitwiseAND((1 << _FILTER_BITS) - 1)
    words = classes.select(low.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).collect()  # 2^17 rows at most
    mask = np.zeros(1 << (_FILTER_BITS - 5), np.uint32)
    for r in words:
        mask[r["word"]] = r["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches):
        met: set = set()
        for b in common.slices(batches):
            d, h = shingles(*common.text_bytes(b.column("text")))
            size, c = _classes(d, h, b.num_rows)
            low = c & ((1 << _FILTER_BITS) - 1)
            want = (size > 0) & ((sent.value[low >> 5] >> (low & 31).astype(np.uint32)) & 1).astype(bool)
            first = np.searchsorted(d, np.arange(b.num_rows))
            rows = []
            for i in np.flatnonzero(want):
                if (k := int(c[i])) not in met:
                    met.add(k)
                    rows.append((k, h[first[i] : first[i] + size[i]].tobytes()))
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 256], strict=True), (pa.int64(), pa.binary()), strict=True)], names=["class", "set"])

    return docs.mapInArrow(run, "class long, set binary").groupBy("class").agg(F.max("set").alias("set"))


def _verified(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) whose whole sets link."""
    side = lambda c, s: sets.select(F.col("class").alias(c), F.col("set").alias(s))
    return common.cut(near.join(side("a", "s1"), "a").join(side("b", "s2"), "b").mapInArrow(_verify, "a long, b long"))


#: Columns that name a cell of a heavy list: the bands of its sides, and which part of each.
_CELL = ("sig", "band", "band2", "i", "j")


def _cell_pairs(batches):
    """Pairs of different components within each cell of a heavy list."""
    held: list = []
    cell = None

    def out():
        mine, side, cls, comp, n, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        _, low, high, i_, j_ = cell
        left, right = np.flatnonzero((mine == low) & (side == i_)), np.flatnonzero((mine == high) & (side == j_))
        own = (low, i_) == (high, j_)
        for at in range(0, len(left), 256):
            p = left[at : at + 256]
            fits = (comp[p][:, None] != comp[right][None]) & _worth(n[right][None], pos[right][None], n[p][:, None], pos[p][:, None])
            if own:
                fits &= right[None] > p[:, None]
            a, b = np.nonzero(fits)
            if len(a):
                a, b = cls[p[a]], cls[right[b]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for b in batches:
        key = [b.column(c).to_numpy() for c in _CELL]
        cuts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in key], axis=0), True]) if b.num_rows else []
        for s, t in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(int(c[s]) for c in key)
            if cell is not None and now != cell:
                yield from out()
                held = []
            cell = now
            held.append([b.column(c).to_numpy()[s:t] for c in ("mine", "side", "class", "component", "n", "pos")])
    if held:
        yield from out()


def _apart(heavy: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, b) that heavy lists leave to verify, given the components found; see _cell_pairs.

    Sets that link differ in size by a factor of 100 / LEAST at most, so with bands of that ratio only a band and the next one meet.
    """
    heavy = heavy.distinct().join(found.select(F.col("node").alias("class"), "component"), "class", "left")
    heavy = heavy.withColumn("component", F.coalesce("component", "class"))
    heavy = heavy.withColumn("mine", F.floor(F.log("n") / F.lit(math.log(100 / LEAST)) + 1e-9).cast("int"))
    lists = heavy.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("sig")
    bands = heavy.join(lists, "sig").groupBy("sig", "mine").agg(F.count("*").alias("rows"))
    shape = bands.select("sig", "mine", F.ceil(F.col("rows") / CELL).cast("int").alias("k"))
    near = lambda step, name: shape.select("sig", (F.col("mine") - step).alias("mine"), F.col("k").alias(name))
    shape = shape.join(near(1, "above"), ["sig", "mine"], "left").join(near(-1, "below"), ["sig", "mine"], "left")
    row = heavy.join(shape, ["sig", "mine"]).withColumn("side", F.pmod(F.xxhash64("class"), F.col("k")).cast("int"))
    count = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda band, band2, i, j: F.struct(band.alias("band"), band2.alias("band2"), i.alias("i"), j.alias("j"))
    mine, side = F.col("mine"), F.col("side")
    cells = F.concat(
        F.transform(count("k"), lambda o: cell(mine, mine, F.least(side, o), F.greatest(side, o))),
        F.transform(count("above"), lambda o: cell(mine, mine + 1, side, o)),
        F.transform(count("below"), lambda o: cell(mine - 1, mine, o, side)),
    )
    row = row.withColumn("cell", F.explode(cells)).select("sig", "cell.*", "mine", "side", "class", "component", "n", "pos")
    cells = row.repartition(parts, *_CELL).sortWithinPartitions(*_CELL)
    return common.written(cells.mapInArrow(_cell_pairs, "a long, b long").distinct())


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _by_document(*_linked(docs))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, digest (xxhash64 of the text), n_shingles and group of every row: texts that are linked are of one group, whatever doc_id they bear; null without words."""
    stats, label = _linked(docs)
    named = label.select(F.col("node").alias("class"), "component")
    group = F.when(F.col("n_shingles") > 0, F.coalesce("component", "class"))
    return stats.join(named, "class", "left").select("doc_id", "digest", "n_shingles", group.alias("group"))


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, digest, n_shingles, class and sketch; and (node, component) of the classes that link."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = common.partitions(spark)
    stats = common.cut(d.withColumn("digest", F.xxhash64("text")).mapInArrow(_stats, "doc_id long, digest long, n_shingles long, class long, sketch binary"))
    sizes = {r["n"]: r["c"] for r in stats.where("n_shingles between 1 and 100").groupBy(F.col("n_shingles").alias("n")).agg(F.count("*").alias("c")).collect()}  # 100 rows at most
    total = stats.agg(F.sum("n_shingles")).first()[0] or 0
    texts = d.select("text")
    frequent = _frequent(texts, total)
    mean = 1 + float((frequent[1] ** 2).sum() / max(1, total))
    entries = _signatures(texts, frequent, boundary(sizes, mean))
    walked = entries.repartition(parts, "sig", "salt").sortWithinPartitions("sig", "salt", F.xxhash64("class", F.col("sig").bitwiseAND(LEADERS - 1)), "class").mapInArrow(_lists, "kind int, sig long, a long, b long, n int, pos int")
    walked = common.written(walked)
    sketches = stats.where("n_shingles > 0").groupBy("class").agg(F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    near = _near(walked.where("kind = 0").select("a", "b"), sketches)
    met = near.select(F.explode(F.array("a", "b")).alias("class")).unionByName(walked.where("kind = 1").select(F.col("a").alias("class")))
    sets = common.written(_sets(texts, met))
    links = _verified(near, sets)
    heavy = walked.where("kind = 1").select("sig", F.col("a").alias("class"), "n", "pos")
    label = common.cut(components(links))
    rest = _apart(heavy, label, parts)
    if not rest.isEmpty():
        found = _verified(_near(rest, sketches), sets)
        if not found.isEmpty():
            label = merged(label, found)
    return stats, label


def _by_document(stats: DataFrame, label: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, from the components of classes."""
    some = stats.where("n_shingles > 0").select("class", "doc_id")
    least = some.groupBy("class").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    named = least.join(label.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("least").alias("id"))
    named = named.join(smallest, "component").select("class", "id")
    twice = some.where("doc_id is not null").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not twice.isEmpty():  # documents of several texts: their components are one
        ids = some.join(twice, "doc_id").join(named, "class").select("doc_id", "id")
        own = components(ids.select(F.col("id").alias("a"), F.col("doc_id").alias("b")))
        named = named.join(own, named["id"] == own["node"], "left").select("class", F.coalesce("component", "id").alias("id"))
    named = named.select(F.col("class").alias("_class"), "id")
    out = stats.join(named, (F.col("class") == F.col("_class")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("component_id"))


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))

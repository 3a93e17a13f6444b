"""Embedding near-dedup by sorted projection passes.

Bit-equal vectors are one class, named by its smallest vec_id; what follows compares classes.

A pass orders all classes by a string of concatenated random hashes (signs of projections) and compares each with the
WINDOW before it, by cosine in double precision; the links of a task leave it as a forest. The first passes (FIRST)
carry all vectors. The others carry a sketch of SKETCH signs, and only classes whose window holds one of another
component with a near sketch (a link of cosine LEAST is farther with a chance of 1e-8) are sorted again with their
vectors. The forests of all passes are united into components.

Windows are bounded, groups are not. What the windows miss a second round finds: classes are dealt in buckets of equal
hash bits, and in a bucket all pairs of different components are compared, by sketch first, so a crowd beside a vector
hides no link. Up to EXACT classes one bucket holds all. Beyond, bits grow with the classes, and passes with
the bits, until a link at the threshold is missed by all of them with a chance of at most MISS, whatever the table's
size or density.

Inside each component all pairs of classes are then measured in square blocks of at most BLOCK a side, dealt over
the tasks, and only counts leave a block. So every link inside a component counts, however many copies it holds.

Edge cases: vectors that are null, zero or hold null or non-finite components link with nothing, as do those
of another length; rows that repeat a vec_id are one vector (the smallest sound one); a null vec_id is a row of
its own without links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components, forest, merged
from .neighbours import planes, sound, strings

LEAST = 0.95
#: Passes, those of them that carry vectors, bits of a pass's string, classes before each that it is compared with, classes of a block's side.
PASSES, FIRST, BITS, WINDOW, BLOCK = 20, 2, 63, 24, 1024
#: Signs of a sketch, and how many may differ: 6 standard deviations beyond what a link at the threshold expects.
SKETCH = 256
FARTHEST = math.ceil(SKETCH * math.acos(LEAST) / math.pi + 6 * math.sqrt(SKETCH * math.acos(LEAST) / math.pi * (1 - math.acos(LEAST) / math.pi)))
#: Classes up to which the second round has one bucket, classes of a bucket beyond, chance that it misses a link of cosine LEAST.
EXACT, BUCKET, MISS = 1 << 14, 1024, 1e-6


def second_round(n: int) -> tuple[int, int]:
    """Passes and bits of the second round for n classes: (1 - P(all bits of a pass agree)) ** passes <= MISS."""
    bits = max(1, math.ceil(math.log2(n / BUCKET))) if n > EXACT else 0
    agree = (1 - math.acos(LEAST) / math.pi) ** bits
    return (math.ceil(math.log(MISS) / math.log1p(-agree)) if bits else 1), bits


def _by_dim(b: pa.RecordBatch):
    """(rows, vectors) of runs of up to 2048 rows of one length of vectors."""
    e = b.column("embedding")
    off, flat = e.offsets.to_numpy(), e.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(np.diff(off)):
        own = np.flatnonzero(np.diff(off) == dim)
        for part in np.array_split(own, max(1, len(own) // 2048)):
            yield part, flat[off[part][:, None] + np.arange(dim)]


def _packed(rows: DataFrame, passes: int, bits: int) -> DataFrame:
    """vec_id, dim, unit vector as float64 bytes, sketch, its string for every pass and its bucket for every pass of the second round."""

    def run(batches):
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            for part, x in _by_dim(b):
                dim = x.shape[1]
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys = strings(x, PASSES, BITS, 23).astype(np.int64)
                sketch = np.packbits(x @ planes(dim, SKETCH, 31) > 0, axis=1)
                buckets = strings(x, passes, bits, 29).astype(np.int64) if bits else np.zeros((len(part), passes), np.int64)
                lists = [pa.array(list(k), pa.list_(pa.int64())) for k in (keys, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array([dim] * len(part), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in sketch], pa.binary()), *lists], names=["vec_id", "dim", "v", "sketch", "keys", "buckets"])

    return rows.mapInArrow(run, "vec_id long, dim int, v binary, sketch binary, keys array<long>, buckets array<long>")


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def _runs(batches, carries: str):
    """(columns, vectors or sketches, first new row) of stretches of up to 4096 rows of one pass and length, in their order; each begins with the WINDOW rows before it."""
    names = ("pass", "dim", "key", "vec_id", "label")
    carried = None
    for b in batches:
        if not b.num_rows:
            continue
        cols, raw = [b.column(c).to_numpy() for c in names], b.column(carries)
        pass_, dim = cols[0], cols[1]
        cuts = np.flatnonzero(np.r_[True, (pass_[1:] != pass_[:-1]) | (dim[1:] != dim[:-1]), True])
        for s, t in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(s, t, 4096):
                upto = min(t, at + 4096)
                part = raw.slice(at, upto - at)
                x = _sketches(part) if carries == "sketch" else np.frombuffer(b"".join(part.to_pylist()), np.float64).reshape(upto - at, dim[at])
                own, fresh = [c[at:upto] for c in cols], 0
                if carried and (carried[0][0][0], carried[0][1][0]) == (pass_[at], dim[at]):
                    fresh = len(carried[1])
                    own, x = [np.concatenate(c) for c in zip(carried[0], own, strict=True)], np.concatenate([carried[1], x])
                yield dict(zip(names, own, strict=True)), x, fresh
                carried = [c[-WINDOW:] for c in own], x[-WINDOW:]


def _window_members(batches):
    """The rows that lie within a window of one of another label whose sketch is near."""
    for c, x, fresh in _runs(batches, "sketch"):
        near = np.zeros(len(x), bool)
        for k in range(1, min(WINDOW, len(x) - 1) + 1):
            some = np.flatnonzero(c["label"][k:] != c["label"][:-k])
            hit = some[np.bitwise_count(x[some + k] ^ x[some]).sum(1) <= FARTHEST]
            hit = hit[hit + k >= fresh]
            near[hit] = near[hit + k] = True
        if near.any():
            yield pa.RecordBatch.from_arrays([pa.array(v[near]) for v in c.values()], names=list(c))


def _window_links(batches):
    """Forest of the links between neighbours in the order, a task's at most."""
    for c, x, fresh in _runs(batches, "v"):
        a_, b_ = [], []
        for k in range(1, min(WINDOW, len(x) - 1) + 1):
            hit = np.flatnonzero(np.einsum("ij,ij->i", x[k:], x[:-k]) >= LEAST)
            hit = hit[hit + k >= fresh]
            a_.append(c["vec_id"][hit])
            b_.append(c["vec_id"][hit + k])
        if a_ and sum(map(len, a_)):
            low, high = forest(np.concatenate(a_), np.concatenate(b_))
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])


def _cells(batches, *names, column: str = "v"):
    """(key, columns by name, vectors or sketches) of each cell; `names` begin with the five of the key. Cells arrive whole and one after the other."""
    held: list = []
    cell = None

    def out():
        *cols, x = (np.concatenate(c) for c in zip(*held, strict=True))
        return cell, dict(zip(names[5:], cols, strict=True)), x

    for b in batches:
        key = [b.column(c).to_numpy() for c in names[:5]]
        cuts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in key], axis=0), True]) if b.num_rows else []
        for s, t in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(int(c[s]) for c in key)
            if cell is not None and now != cell:
                yield out()
                held = []
            cell = now
            raw = b.column(column).slice(s, t - s)
            x = _sketches(raw) if column == "sketch" else np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(t - s, cell[1])
            held.append((*(b.column(c).to_numpy()[s:t] for c in names[5:]), x))
    if held:
        yield out()


def _block_counts(batches):
    """(vec_id, n) of the classes of each cell: vectors of other classes that link with each."""
    for (_, _, _, i, j), c, x in _cells(batches, "component", "dim", "bucket", "i", "j", "side", "vec_id", "copies"):
        side, ids, copies = c["side"], c["vec_id"], c["copies"]
        if i == j:
            near = (x @ x.T) >= LEAST
            np.fill_diagonal(near, False)
            counts = [(ids, near @ copies)]
        else:
            left, right = side == i, side == j
            near = (x[left] @ x[right].T) >= LEAST
            counts = [(ids[left], near @ copies[right]), (ids[right], copies[left] @ near)]
        for own, n in counts:
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n, pa.int64())], names=["vec_id", "n"])


_CELL = ("pass", "dim", "bucket", "i", "j")


def _cell_members(batches):
    """The rows of each cell that have one of another label whose sketch is near."""
    for key, c, x in _cells(batches, *_CELL, "side", "vec_id", "label", column="sketch"):
        left, right = np.flatnonzero(c["side"] == key[3]), np.flatnonzero(c["side"] == key[4])
        near = np.zeros(len(x), bool)
        for at in range(0, len(left), 128):
            p = left[at : at + 128]
            far = np.zeros((len(p), len(right)), np.int16)
            for w in range(x.shape[1]):
                far += np.bitwise_count(x[p, w][:, None] ^ x[right, w][None])
            hit = (far <= FARTHEST) & (c["label"][p][:, None] != c["label"][right][None])
            near[p] |= hit.any(1)
            near[right] |= hit.any(0)
        if near.any():
            n = int(near.sum())
            cols = [pa.array(np.full(n, v), t) for v, t in zip(key, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(c["side"][near], pa.int32()), *[pa.array(c[k][near]) for k in ("vec_id", "label")]], names=[*_CELL, "side", "vec_id", "label"])


def _cell_links(batches):
    """Forest of the links between vectors of different labels of each cell."""
    for key, c, x in _cells(batches, *_CELL, "side", "vec_id", "label"):
        left, right = np.flatnonzero(c["side"] == key[3]), np.flatnonzero(c["side"] == key[4])
        p, q = np.nonzero((x[left] @ x[right].T) >= LEAST)
        p, q = left[p], right[q]
        new = c["label"][p] != c["label"][q]
        if new.any():
            low, high = forest(c["vec_id"][p[new]], c["vec_id"][q[new]])
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])


def _missed(packed: DataFrame, label: DataFrame, parts: int) -> DataFrame:
    """Links a, b between classes of different components, by the second round.

    A component of more than BLOCK classes of a bucket has sides of its own, and no cell pairs it with itself.
    """
    each = packed.select("vec_id", "dim", "sketch", "buckets").join(label, "vec_id").select("vec_id", "dim", "label", "sketch", F.posexplode("buckets").alias("pass", "bucket"))
    at = ["pass", "dim", "bucket"]
    held = each.groupBy(*at, "label").count().withColumn("big", F.col("count") > BLOCK)
    units = held.groupBy(*at, "big", F.when(F.col("big"), F.col("label")).otherwise(0).alias("own")).agg(F.sum("count").alias("n"))
    sides = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1), lambda s: F.struct("big", "own", s.alias("s")))
    shape = units.groupBy(*at).agg(F.array_sort(F.flatten(F.collect_list(sides))).alias("units"), F.sum("n").alias("n"), F.count("*").alias("kinds"), F.bool_or("big").alias("any"))
    shape = shape.where("n > 1 and (kinds > 1 or not any)").select(*at, "units")
    row = each.join(shape, at)
    row = row.withColumn("big", F.exists("units", lambda u: u["big"] & (u["own"] == F.col("label"))))
    row = row.withColumn("own", F.when(F.col("big"), F.col("label")).otherwise(0))
    same = lambda u: (u["big"] == F.col("big")) & (u["own"] == F.col("own"))
    row = row.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.size(F.filter("units", same))).cast("int"))
    row = row.withColumn("side", F.array_position("units", F.struct("big", "own", "s")).cast("int") - 1)
    others = F.filter(F.sequence(F.lit(0), F.size("units") - 1), lambda o: ~(F.col("big") & same(F.get("units", o))))
    row = row.withColumn("other", F.explode(others))
    row = row.select(*at, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "vec_id", "label", "sketch")
    near = row.repartition(parts, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_cell_members, "pass int, dim int, bucket long, i int, j int, side int, vec_id long, label long")
    carry = near.join(packed.select("vec_id", "v"), "vec_id")
    return carry.repartition(parts, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_cell_links, "a long, b long")


def _labels(packed: DataFrame, found: DataFrame) -> DataFrame:
    """(vec_id, label): the component of every class, its own where it has none."""
    return common.cut(packed.select("vec_id").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("label")))


def _grouped(packed: DataFrame, parts: int) -> DataFrame:
    """(node, component) of all classes that link, by the passes and the second round."""
    order = ("pass", "dim", "key", "vec_id")  # equal strings may go to several tasks
    sort = lambda rows: rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    first = packed.select("vec_id", "dim", "v", F.posexplode(F.slice("keys", 1, FIRST)).alias("pass", "key"), F.lit(0).cast("long").alias("label"))
    found = common.cut(components(sort(first).mapInArrow(_window_links, "a long, b long")))
    rest = packed.select("vec_id", "dim", "sketch", F.posexplode(F.slice("keys", FIRST + 1, PASSES)).alias("pass", "key")).join(_labels(packed, found), "vec_id")
    near = sort(rest).mapInArrow(_window_members, "pass int, dim int, key long, vec_id long, label long").distinct()
    found = merged(found, common.cut(sort(near.join(packed.select("vec_id", "v"), "vec_id")).mapInArrow(_window_links, "a long, b long")))
    return merged(found, _missed(packed, _labels(packed, found), parts))


def near_duplicates(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = rows.sparkSession
    parts = common.partitions(spark)
    d = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    d = d.select("vec_id", F.when(sound(F.col("embedding")), F.col("embedding")).alias("embedding"))
    one = common.cut(d.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    classes = common.cut(one.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    passes, bits = second_round(classes.count())
    packed = common.cut(_packed(classes, passes, bits))
    found = _grouped(packed, parts)
    sizes = found.groupBy("component").count().select("component", F.ceil(F.col("count") / BLOCK).cast("int").alias("k"))
    member = found.join(sizes, "component").withColumnRenamed("node", "vec_id").join(packed.select("vec_id", "dim", "v"), "vec_id").join(classes.select("vec_id", "copies"), "vec_id")
    member = member.withColumn("side", F.pmod(F.xxhash64("vec_id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    member = member.select("component", "dim", F.lit(0).alias("bucket"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "vec_id", "copies", "v")
    cells = member.repartition(parts, "component", "dim", "i", "j").sortWithinPartitions("component", "dim", "i", "j")
    counted = cells.mapInArrow(_block_counts, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("others"))
    known = classes.select("vec_id", "embedding", "copies").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left").join(counted, "vec_id", "left")
    known = known.select("embedding", (F.coalesce("others", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    linked = one.where("embedding is not null").join(known, "embedding").select("vec_id", "n_links", "component")
    alone = one.where("embedding is null").select("vec_id").unionByName(d.where("vec_id is null").select("vec_id"))
    out = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component")))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))

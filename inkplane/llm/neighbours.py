"""Approximate nearest neighbours by a forest of hash prefixes.

Rows are dealt in blocks of about BLOCK vectors by a hash of what they hold, so neither files nor partitions change a
block or an answer. Each block holds TREES sorted arrays of BITS-bit hash strings (signs of random projections) and is
built once. A query descends each array to its longest matching prefix by binary search and then ascends in
all arrays at once, a bit at a time, until the rows below the prefixes make up CANDIDATES of the block; those are
measured exactly. The best of a block's answers are merged by query.

The stated queries meet the rows block by block: both sides are cut in blocks, joined by a block number, so
neither side is broadcast and no task holds more than a few blocks. Every row is indexed, in float64.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part; vectors of other
lengths are searched among their own kind; equal distances go to the smaller vec_id; repeated rows are candidates
as often as they stand (a query's own vec_id never) and one row in a block; a repeated query is asked once (its smallest
vector); with fewer candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a block, queries of a block, trees, bits of a hash string, share of a block that an ascent gathers.
BLOCK, QUERIES, TREES, BITS, CANDIDATES = 4096, 1024, 64, 32, 0.45
NEAREST = 10

BLOCK_SCHEMA = "block long, dim int, ids binary, times binary, vectors binary"


def sound(vector: Column) -> Column:
    """Neither null nor zero, all components there and finite."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, real) & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id and embedding in double precision of the rows that take part."""
    d = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return d.where(F.col("vec_id").isNotNull() & sound(F.col("embedding")))


def blocks(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Rows (vec_id, embedding, times) packed in blocks of one length of vectors, in order of vec_id: ids and times as int64, vectors as float64. And how many blocks a length has at most."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, times = t["vec_id"].to_numpy(), t["times"].to_numpy()
        dim, block = t["dim"][0].as_py(), t["block"][0].as_py()
        x = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        order = np.lexsort((*x.T[::-1], ids))
        return pa.table([pa.array([block], pa.int64()), pa.array([dim], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (ids[order], times[order], x[order])]], names=["block", "dim", "ids", "times", "vectors"])

    sized = rows.withColumn("dim", F.size("embedding"))
    number = {r["dim"]: max(1, -(-r["count"] // most)) for r in sized.groupBy("dim").count().collect()}  # one row a length of vectors
    of = F.create_map(*[F.lit(x) for d, n in number.items() for x in (d, n)])[F.col("dim")] if number else F.lit(1)
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), of))
    return dealt.groupBy("dim", "block").applyInArrow(pack, BLOCK_SCHEMA), max(number.values(), default=1)


@cache
def planes(dim: int, n: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng((seed, dim, n)).standard_normal((dim, n))


def strings(x: np.ndarray, n: int, bits: int, seed: int = 11) -> np.ndarray:
    """n hash strings of each row, as integers whose first bit is the highest."""
    signs = x @ planes(x.shape[1], n * bits, seed) > 0
    weights = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return (signs.reshape(len(x), n, bits) * weights).sum(2, dtype=np.uint64)


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.bits, self.n = bits, len(x)
        self.centre = x.mean(0)
        s = strings(x - self.centre, trees, bits)
        self.order = np.argsort(s, axis=0, kind="stable")
        self.sorted = np.take_along_axis(s, self.order, 0)

    def candidates(self, q: np.ndarray, least: int):
        """For each query the rows below the longest prefixes that give `least` of them."""
        s = strings(q - self.centre, self.sorted.shape[1], self.bits)
        ranges = {}

        def at(depth: int):
            if depth not in ranges:
                shift = np.uint64(self.bits - depth)
                low = (s >> shift) << shift
                high = low + ((np.uint64(1) << shift) - np.uint64(1))
                a = np.column_stack([np.searchsorted(self.sorted[:, t], low[:, t], "left") for t in range(s.shape[1])])
                b = np.column_stack([np.searchsorted(self.sorted[:, t], high[:, t], "right") for t in range(s.shape[1])])
                ranges[depth] = a, b
            return ranges[depth]

        done = np.zeros(len(q), bool)
        for depth in range(self.bits, -1, -1):
            a, b = at(depth)
            for i in np.flatnonzero(~done & ((b - a).sum(1) >= min(least, self.n))):
                seen = np.zeros(self.n, bool)
                for t in np.flatnonzero(b[i] > a[i]):
                    seen[self.order[a[i, t] : b[i, t], t]] = True
                if depth == 0 or seen.sum() >= least:
                    done[i] = True
                    yield i, np.flatnonzero(seen)
            if done.all():
                return


def nearest(q_ids, q, forest: Forest, ids, x, k: int, share: float = CANDIDATES):
    """(query, vec_id, distance, row) of the k nearest rows found in a block, ties to the smaller id."""
    for i, rows in forest.candidates(q, max(4 * k, int(share * len(x)))):
        rows = rows[ids[rows] != q_ids[i]]
        d = np.sqrt(np.square(x[rows] - q[i]).sum(1))
        best = np.lexsort((ids[rows], d))[:k]
        yield np.full(len(best), q_ids[i]), ids[rows][best], d[best], rows[best]


def search(rows: DataFrame, queries: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row that `queries` picks."""
    spark = rows.sparkSession
    every = common.cut(vectors(rows).groupBy("vec_id", "embedding").agg(F.count("*").alias("times")))
    asked = every.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.lit(1).cast("long").alias("times"))
    dealt, most = blocks(every, BLOCK)
    salts = min(common.partitions(spark), most)
    asked = blocks(asked, QUERIES)[0].select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = dealt.withColumn("salt", F.pmod(F.col("block"), F.lit(salts)).cast("int"))
    met = dealt.join(asked.hint("merge"), ["salt", "dim"])  # a block of rows meets one block of queries after the other; Spark knows the rows' size, not that of their copies

    def run(batches):
        built: tuple = (None, None)
        for b in batches:
            for r in b.to_pylist():
                ids, times = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["times"], np.int64)
                x = np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"])
                if built[0] != (r["dim"], r["block"]):
                    built = (r["dim"], r["block"]), Forest(x)
                q_ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q"], np.float64).reshape(-1, r["dim"])
                parts = list(nearest(q_ids, q, built[1], ids, x, k))
                if parts:
                    query, vec, score, row = (np.concatenate(c) for c in zip(*parts, strict=True))
                    n = np.minimum(times[row], k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, n)) for c in (query, vec, score)], names=["query_id", "vec_id", "score"])

    got = met.select("dim", "block", "q_ids", "q", "ids", "times", "vectors").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return got.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

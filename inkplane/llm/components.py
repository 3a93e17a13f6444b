"""Connected components of a table of links, by alternating stars.

A large star hangs every larger neighbour of a node under the smallest node it sees, a small star every
smaller one; in turn they leave one star a component after a few rounds. The minima are aggregated before the
shuffle, and a node with many links is one side of an equi-join, which adaptive execution splits. Each round
is cut by a checkpoint, so the plan stays short and a lost executor repeats one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Links that a task gathers before it hands on their forest.
TOGETHER = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is linked with) of the links of one task: as connected as they are, and fewer."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    hung = root != np.arange(len(nodes))
    return nodes[hung], nodes[root[hung]]


def _forests(batches):
    """The links of a task as forests, each of TOGETHER links at most (and a batch)."""
    low = high = np.zeros(0, np.int64)
    for b in batches:
        low, high = forest(np.concatenate([low, b.column("a").to_numpy()]), np.concatenate([high, b.column("b").to_numpy()]))
        if len(low) > TOGETHER:
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])
            low = high = low[:0]
    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that links a, b name; the component is its smallest node. Repeated links and loops do no harm."""
    own = common.cut(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"))
    fewer = own.coalesce(max(1, -(-own.count() // TOGETHER))).mapInArrow(_forests, "a long, b long")
    known = common.cut(fewer.distinct())
    last = None
    while True:
        mark = known.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
        last = mark
        known = common.cut(_small(_large(known).distinct()).distinct())
    every = known.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return every.unionByName(known.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components `label` (node, component) once more links a, b are known: only the components that these name are united."""
    name = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
    united = common.cut(components(between))
    to = united.select(F.col("node").alias("component"), F.col("component").alias("m"))
    known = label.join(to, "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    return common.cut(known.unionByName(united.join(label.select("node"), "node", "left_anti")))

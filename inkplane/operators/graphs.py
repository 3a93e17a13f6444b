"""Line graphs as tables: node(pix_id, ...), edge(a, b), path ends at nodes."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..kernels.raster import united


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the shared folder that spark.checkpoint.dir names; a local folder only where none is set and all runs in one process."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree), loops counting twice."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


#: Links that a task gathers before it hands on their forest.
_TOGETHER = 1 << 20


def _forests(batches):
    """The links of a task as stars around smallest nodes: as connected as they were, and fewer."""

    def out(held):
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        root = united(len(nodes), at[: len(a)], at[len(a) :])
        hung = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[root[hung]])], names=["a", "b"])

    held, n = [], 0
    for b in batches:
        held.append((b.column("a").to_numpy(), b.column("b").to_numpy()))
        n += b.num_rows
        if n > _TOGETHER:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component), the component being its smallest node.

    Each task turns its links into stars. Then, round by round, every node's larger neighbours are hung on its smallest neighbour,
    and its smaller ones after them, until stars are all that is left; minima are combined before they are shuffled.
    """
    kind = dict(edges.dtypes)["a"]
    ends = checkpointed(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    known = checkpointed(ends.where("a <> b").mapInArrow(_forests, "a long, b long").distinct())
    mark = None
    while True:
        now = known.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        known = checkpointed(down.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    named = known.select(F.col("a").alias("node"), F.col("b").alias("component"))
    alone = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(named, "node", "left")
    return alone.select(F.col("node").cast(kind).alias("node"), F.coalesce("component", "node").cast(kind).alias("component"))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Unordered ends that several edges share, with how many."""
    return edges.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n")).where("n > 1")


def without_duplicates(branches: DataFrame) -> DataFrame:
    """Branches (branch, a, b, n_points) but those of two points that run parallel to another one."""
    w = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b"))
    d = branches.withColumn("_n", F.count("*").over(w))
    return d.where((F.col("n_points") > 2) | (F.col("_n") == 1)).drop("_n")


def is_bridge(inner: Column, da: Column, db: Column, dist_a: Column, dist_b: Column, a: Column, b: Column) -> Column:
    """A short branch between two junctions: no more inner points than the distances at its ends, rounded up, together."""
    return (da >= 3) & (db >= 3) & (a != b) & (inner <= F.ceil(dist_a) + F.ceil(dist_b))


def contract(edges: DataFrame, nodes: DataFrame, bridges: DataFrame) -> DataFrame:
    """Edges after the nodes that bridges join became one: the one nearest to their centre. Undirected, once each, with their new length."""
    comp = connected_components(bridges)
    at = comp.join(nodes, "node")
    w = Window.partitionBy("component")
    d2 = F.pow(F.col("y") - F.avg("y").over(w), 2) + F.pow(F.col("x") - F.avg("x").over(w), 2)
    rep = at.withColumn("d2", F.round(d2, 9)).groupBy("component").agg(F.min_by("node", F.struct("d2", "node")).alias("rep"))
    to = comp.join(rep, "component").select("node", "rep")
    moved = edges.join(to.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a", "left").join(to.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b", "left")
    moved = moved.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    p, q = (nodes.select(F.col("node").alias(c), F.col("y").alias(f"y{c}"), F.col("x").alias(f"x{c}")) for c in "ab")
    return moved.join(p, "a").join(q, "b").select("a", "b", F.hypot(F.col("ya") - F.col("yb"), F.col("xa") - F.col("xb")).alias("w"))


def path_ends(paths: DataFrame) -> DataFrame:
    """(path_id, side, pix): first and last pixel of each path."""
    e = F.explode(F.array(F.struct(F.element_at("pix", 1).alias("pix"), F.lit(0).alias("side")), F.struct(F.element_at("pix", -1).alias("pix"), F.lit(1).alias("side"))))
    return paths.select("path_id", e.alias("e")).select("path_id", "e.side", "e.pix")


def stub_ends(ends: DataFrame, branches: DataFrame) -> DataFrame:
    """Ends of branches whose other end is free and that are no longer than the line is thick at the node."""
    return ends.join(branches, "path_id").where("other_degree = 1 and length <= thickness")


def end_pairs(ends: DataFrame, max_kink_deg: float = 20.0, tol: float = 0.1) -> DataFrame:
    """Pairs a < b of ends at one node that may continue each other, with a score: -1 on one circle, else the kink in degrees."""
    p, q = ends.alias("p"), ends.alias("q")
    dot = F.col("p.dx") * F.col("q.dx") + F.col("p.dy") * F.col("q.dy")
    circle = G.circles_match(F.col("p.cx"), F.col("p.cy"), F.col("p.r"), F.col("q.cx"), F.col("q.cy"), F.col("q.r"), tol)
    straight = G.are_coaxial(F.col("p.dx"), F.col("p.dy"), F.col("q.dx"), F.col("q.dy"), max_kink_deg)
    kink = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -dot))))
    met = p.join(q, "node").where((F.col("p.id") < F.col("q.id")) & (circle | straight))
    return met.select("node", F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.when(circle, F.lit(-1.0)).otherwise(F.round(kink, 6)).alias("score"))


def match_greedy(pairs: DataFrame) -> DataFrame:
    """Of each node's pairs the best first, each end once; ties by ends. A node's pairs are one array, folded in the JVM."""
    ranked = pairs.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("score", "a", "b"))).alias("p"))
    free = lambda k, x: ~F.exists(k, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"]) | (y["a"] == x["b"]) | (y["b"] == x["a"]))
    kept = F.aggregate("p", F.slice("p", 1, 0), lambda k, x: F.when(free(k, x), F.concat(k, F.array(x))).otherwise(k))
    return ranked.select("node", F.explode(kept).alias("m")).select("node", "m.a", "m.b", "m.score")


def chains(links: DataFrame) -> DataFrame:
    """(node, chain, step) along undirected links where no node has more than two: a chain starts at the smaller of its free ends, a ring at its smallest node.

    A component is one group: a chain of one sheet's line, walked from its start.
    """
    comp = connected_components(links)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    free = both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("near")).join(comp, F.col("a") == F.col("node"))
    start = free.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("n") == 1, F.col("a"))), F.min("a")).alias("start"))
    steps = both.join(comp, F.col("a") == F.col("node")).select("a", "b", "component").join(start, "component")

    def walk(pdf):
        import pandas as pd

        near: dict = {}
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            near.setdefault(a, []).append(b)
        out, last, at = [], None, pdf["start"].iloc[0]
        while at is not None and (not out or at != out[0]):
            out.append(at)
            last, at = at, min((b for b in near[at] if b != last), default=None)
        return pd.DataFrame({"node": out, "chain": [pdf["component"].iloc[0]] * len(out), "step": range(len(out))}).astype("int64")

    return steps.groupBy("component").applyInPandas(walk, "node long, chain long, step long")


def join_chain(parts: Column) -> Column:
    """Pixels of a chain of branches in order, each an array turned the right way, the pixel two of them share once."""
    return F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.slice(p, 2, F.size(p)))))


def promote_bridges(paths: DataFrame, ends: DataFrame, max_kink_deg: float = 30.0, factor: float = 3.0) -> DataFrame:
    """Thin paths that become thick: short, thick paths at both ends, one of them straight ahead, and no longer than factor times their median level.

    paths: path, thick, level, len; ends: path, side, node, dx, dy.
    """
    e = ends.join(paths.select("path", "thick", "level", "len"), "path")
    p, q = e.where("not thick").alias("p"), e.where("thick").alias("q")
    ahead = G.are_coaxial(F.col("p.dx"), F.col("p.dy"), F.col("q.dx"), F.col("q.dy"), max_kink_deg)
    met = p.join(q, "node").select(F.col("p.path").alias("path"), F.col("p.side").alias("side"), F.col("p.len").alias("len"), F.col("q.level").alias("level"), ahead.alias("ahead"))
    g = met.groupBy("path").agg(F.count_distinct("side").alias("sides"), F.bool_or("ahead").alias("ahead"), F.median("level").alias("level"), F.first("len").alias("len"))
    return g.where((F.col("sides") == 2) & F.col("ahead") & (F.col("len") < factor * F.col("level"))).select("path")


def prune_once(branches: DataFrame) -> DataFrame:
    """Branches without spurs: one end free, the other a junction, no longer than the line is thick there."""
    spur = F.least("degree_a", "degree_b") == 1
    return branches.where(~(spur & (F.greatest("degree_a", "degree_b") >= 3) & (F.col("length") <= F.col("thickness"))))


def view_groups(boxes: DataFrame, reach: float, owners: DataFrame | None = None, cell: int = 256) -> DataFrame:
    """(seg_id, view): segments nearer than `reach` to each other, or owned by one another, as one group named by its smallest segment.

    Boxes are dealt to the grid cells that they reach, so only neighbours meet.
    """
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - reach) / cell), F.floor((F.col(hi) + reach) / cell))
    d = boxes.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))
    p, q = d.alias("p"), d.alias("q")
    gap = lambda lo, hi: F.greatest(F.lit(0), F.col(f"p.{lo}") - F.col(f"q.{hi}"), F.col(f"q.{lo}") - F.col(f"p.{hi}"))
    near = p.join(q, ["sheet_id", "gx", "gy"]).where((F.col("p.seg_id") < F.col("q.seg_id")) & (F.hypot(gap("x0", "x1"), gap("y0", "y1")) <= reach))
    links = near.select(F.col("p.seg_id").alias("a"), F.col("q.seg_id").alias("b")).distinct()
    if owners is not None:
        links = links.unionByName(owners.select(F.col("seg_id").alias("a"), F.col("owner").alias("b")))
    found = connected_components(links)
    return boxes.select("seg_id").join(found, F.col("seg_id") == F.col("node"), "left").select("seg_id", F.coalesce("component", "seg_id").alias("view"))

"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are ordered by that key in ranges of
the hash; sums of the ranges give each range its offset, a window within the range gives each document its
own. A source's budget is then cut exactly: whole epochs, and in the last one the words up to the budget.

Edge cases: null text counts 0 words; null sources are one source, ordered last; documents of 0 words are
taken 0 times; repeated rows count as often as they stand and share their words; an empty table gives an empty result; other
columns are ignored. Ties of the key go by doc_id, then the text's hash, then size, so reruns agree.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words the mix holds in total against those there are, and the most of one source.
SHARE, MOST = 1.5, 2.0
#: Documents of one source in one range of the hash, on average.
RANGE_ROWS = 1024

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIZES = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("digest", pa.int64()), ("size", pa.int64())])


def _count_words(batches):
    for b in common.slices(batches):
        data, off = common.text_bytes(b.column("text"))
        _, _, doc = common.words(data, off, common.SPACED)
        n = np.bincount(doc, minlength=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source").cast(pa.string()), b.column("digest"), pa.array(n, pa.int64())], schema=_SIZES)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest of the text, size in words."""
    d = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return d.select("doc_id", "source", "text", F.xxhash64("text").alias("digest")).mapInArrow(_count_words, "doc_id long, source string, digest long, size long")


def _key(source: Column) -> Column:
    """A name that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(skey, source, source_size) with target: least(most * size, level * weight), the level being where all targets add up.

    That level is where resharing the excess by weight comes to rest. Both orders, by name for the weights and by what a source could take
    for the level, are ranges over the tasks with running sums.
    """
    named = by_source.select("skey", "source", "source_size", F.col("source").isNull().alias("none"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    s = common.running(named, ["none", "source"], {"i": "1"}).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    whole = s.agg((F.lit(float(share)) * F.sum("source_size")).alias("goal"), F.sum("w").alias("all_w"))
    s = common.running(s.withColumn("ratio", F.col("cap") / F.col("w")), ["ratio", "i"], {"caps": "cap", "ws": "w"}).crossJoin(F.broadcast(whole))
    # the level if all sources before this one are at their caps; the first that need not be shows the true one
    s = s.withColumn("level", (F.col("goal") - F.col("caps")) / (F.col("all_w") - F.col("ws")))
    level = s.agg(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).alias("at")).select(F.col("at.level").alias("found"))
    t = s.crossJoin(F.broadcast(level))
    return t.select("skey", "source_size", F.coalesce(F.least("cap", F.col("found") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17) -> DataFrame:
    """doc_id, digest, size, source_size, target, taken for every row of docs."""
    known = common.cut(sizes(docs).withColumn("skey", _key(F.col("source"))))
    rows = known.count()
    bits = max(0, int(rows / RANGE_ROWS).bit_length())
    keyed = known.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "digest"))
    keyed = keyed.withColumn("bucket", F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("long"))
    by_range = keyed.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("words"))
    by_source = by_range.groupBy("skey", "source").agg(F.sum("words").alias("source_size"))
    ranges = common.running(by_range.select("skey", "bucket", "words"), ["skey", "bucket"], {"upto": "words"})
    starts = ranges.groupBy("skey").agg(F.min("upto").alias("start"))
    offsets = ranges.join(starts, "skey").select("skey", "bucket", (F.col("upto") - F.col("start")).alias("offset"))
    offsets = offsets.join(targets(by_source, weights, share, most), "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["skey", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size") + 0.5) - F.col("offset") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "digest", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, in docs' own columns: a row for each time a document is taken, the last one cut after the budget's word.

    Rows are matched by doc_id and text. Rows that repeat both share what the mix takes of them, word for word: those that differ
    elsewhere in proportion to how often they stand.
    """
    columns = docs.columns
    key = ["__id", "__digest"]
    plan = mix(docs, **how).groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.sum("taken").alias("__taken"), F.first("size").alias("__size"), F.count("*").alias("__rows"))
    plan = common.cut(plan.where("__taken > 0"))
    own = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__digest", F.xxhash64(F.col("text").cast("string")))
    met = _met(own, plan.where("__rows = 1").drop("__rows"), key)
    several = plan.where("__rows > 1")
    if not several.isEmpty():
        variant = _met(own, several, key).withColumn("__variant", F.xxhash64(*[F.col(c) for c in columns]))
        upto = Window.partitionBy(*key).orderBy("__variant")
        n = variant.groupBy(*key, "__variant", "__taken", "__rows").agg(F.count("*").alias("__n")).withColumn("__upto", F.sum("__n").over(upto))
        words = lambda c: F.floor(F.col("__taken") * c / F.col("__rows"))
        share = n.select(*key, "__variant", (words(F.col("__upto")) - words(F.col("__upto") - F.col("__n"))).alias("__taken"))
        one = variant.drop("__taken", "__rows").dropDuplicates([*key, "__variant"])
        met = met.unionByName(_met(one, share, [*key, "__variant"]).select(*columns, *key, "__size", "__taken"))
    full, part = F.floor(F.col("__taken") / F.col("__size")), F.col("__taken") % F.col("__size")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), full.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    met = met.withColumn("__cut", F.explode(copies))
    return met.select(*columns, "__cut").mapInArrow(_heads(columns), docs.schema)


def _met(rows: DataFrame, plan: DataFrame, key: list[str]) -> DataFrame:
    """rows with what the plan says of their key; nulls are equal."""
    p = plan.withColumnsRenamed({k: f"{k}_of" for k in key})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in key]
    return rows.join(p, on).drop(*[f"{k}_of" for k in key])


def _heads(columns: list[str]):
    """Texts up to the end of their __cut-th word, whole ones where it is -1; one row a source is cut at most."""

    def run(batches):
        for b in batches:
            kept = []
            for t, k in zip(b.column("text").to_pylist(), b.column("__cut").to_pylist(), strict=True):
                kept.append(t if k < 0 else t[: next(itertools.islice(_WORD.finditer(t), k - 1, None)).end()])
            new = {"text": pa.array(kept, b.schema.field("text").type)}
            if "n_chars" in columns:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in kept], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in columns], names=columns)

    return run


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).drop("digest")

"""URL filters: rules first, then a ratio of character language models.

Hosts, paths and rules are SQL functions. Two variable-order Markov models over the bytes of host and path,
one of the URLs that rules allow and one of those that they block, are counted over the whole table and
smoothed by Witten-Bell interpolation from order 0 up to ORDER. A URL that no rule fits is blocked if the
difference of the two log-likelihoods, divided by its length, falls below a threshold; the threshold is
calibrated on the fold of rule-judged URLs that the models did not count.

Counts are exact and grow with the table: a row for every distinct string (by its 64-bit hash), dealt in buckets.
Nothing of the model is broadcast. URLs are dealt in groups; a group asks the buckets for each string that it holds
once, so common strings make no hot key, and is scored with the answers.

Edge cases: null urls and those without `://` have empty host and path and no rule; without URLs of both
verdicts to learn from, scores are 0 and the verdict is allow; repeated rows give repeated rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 5
#: Distinct strings of a bucket of counts, bytes of URLs of a group, bytes of URLs whose questions one bucket takes.
_CELLS, GROUP_BYTES, ASKED_BYTES = 1 << 18, 1 << 19, 1 << 21
_TABLES = [(v, w) for v in ("allow", "block") for w in ("gram", "ctx", "kinds")]
#: Bins of the calibration's score histogram over -LIMIT..LIMIT nats a byte.
_HIST, _LIMIT = 400, 4.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule whose host is the url's or a parent of it and whose path starts the url's."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def _grams(data: np.ndarray, off: np.ndarray):
    """For each order: positions, hash of the context, hash of context and byte; contexts stay within their string."""
    h = common.prefix_hash(data)
    begin = np.repeat(off[:-1], np.diff(off))
    at = np.arange(len(data))
    for k in range(ORDER + 1):
        i = at[at - begin >= k]
        yield i, common.span_hash(h, i - k, i), common.span_hash(h, i - k, i + 1)


def _counted(urls: DataFrame) -> DataFrame:
    """(verdict, gram, ctx, n) over all rule-judged URLs of the counted folds; each batch is combined before the shuffle."""

    def run(batches):
        for b in common.slices(batches, "line"):
            for v in ("allow", "block"):
                mine = b.filter(pa.compute.equal(b.column("verdict"), v))
                if not mine.num_rows:
                    continue
                ctx, gram = [], []
                for _, c, g in _grams(*common.text_bytes(mine.column("line"))):
                    ctx.append(c)
                    gram.append(g)
                gram, first, n = np.unique(np.concatenate(gram), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(gram)), pa.array(gram.view(np.int64)), pa.array(np.concatenate(ctx)[first].view(np.int64)), pa.array(n)], names=["verdict", "gram", "ctx", "n"])

    return urls.select("line", "verdict").mapInArrow(run, "verdict string, gram long, ctx long, n long").groupBy("verdict", "gram", "ctx").agg(F.sum("n").alias("n"))


class Models:
    """Counts of byte strings, of contexts, and of bytes seen after a context, for both verdicts, of the strings of ascending hashes `keys`."""

    def __init__(self, tables: dict[tuple[str, str], np.ndarray], keys: np.ndarray | None = None):
        self.tables = tables
        self.keys = np.zeros(0, np.uint64) if keys is None else keys

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log-likelihood as allowed less that as blocked, a byte."""
        n = len(off) - 1
        if not len(self.keys) or not len(data):
            return np.zeros(n)
        p = {v: np.full(len(data), 1 / 256) for v in ("allow", "block")}
        for i, ctx, gram in _grams(data, off):
            (c, known), (g, held) = self._at(ctx), self._at(gram)
            for v, q in p.items():
                kinds, seen = self.tables[v, "kinds"][c] * known, self.tables[v, "ctx"][c] * known
                q[i] = np.where(seen > 0, (self.tables[v, "gram"][g] * held + kinds * q[i]) / np.maximum(seen + kinds, 1), q[i])
        llr = np.log(p["allow"]) - np.log(p["block"])
        return np.bincount(np.repeat(np.arange(n), np.diff(off)), llr, n) / np.maximum(np.diff(off), 1)

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes


def fit(urls: DataFrame) -> DataFrame | None:
    """key and the six counts of every distinct string; None unless both verdicts are there to learn from."""
    counted = common.cut(_counted(urls))
    if counted.select("verdict").distinct().count() < 2:
        return None
    zero = F.lit(0).cast("long")
    grams = counted.select("verdict", F.col("gram").alias("key"), F.col("n").alias("gram"), zero.alias("ctx"), zero.alias("kinds"))
    contexts = counted.groupBy("verdict", F.col("ctx").alias("key")).agg(zero.alias("gram"), F.sum("n").alias("ctx"), F.count("*").alias("kinds"))
    both = grams.unionByName(contexts.select("verdict", "key", "gram", "ctx", "kinds"))
    return common.written(both.groupBy("key").agg(*[F.sum(F.when(F.col("verdict") == v, F.col(w)).otherwise(0)).alias(f"{v}_{w}") for v, w in _TABLES]))


def _with_scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """urls (page_id, line and others) with their scores; only strings that the model knows come back to a group."""
    parts = common.partitions(urls.sparkSession)
    total = urls.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    groups = max(parts, -(-total // GROUP_BYTES))
    bits = max(model.count() // _CELLS, total // ASKED_BYTES, parts).bit_length()
    names, columns = [f"{v}_{w}" for v, w in _TABLES], urls.columns
    dealt = urls.withColumn("group", F.pmod(F.xxhash64("page_id", "line"), F.lit(groups))).repartition(max(parts, groups // 16), "group")
    known = model.withColumn("bucket", F.col("key").bitwiseAND((1 << bits) - 1))

    def ask(t: pa.Table) -> pa.Table:
        keys = []
        for b in common.slices(iter(t.select(["line"]).combine_chunks().to_batches()), "line"):
            keys += [np.unique(np.concatenate(x)) for x in zip(*((c, g) for _, c, g in _grams(*common.text_bytes(b.column("line")))), strict=True)]
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        bucket = (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(keys) else []
        rows = [(int(bucket[order[x]]), keys[order[x:y]].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([pa.array([t["group"][0].as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["group", "bucket", "keys"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows and held.num_rows:
            key = held["key"].to_numpy().view(np.uint64)
            order = np.argsort(key)
            key, counts = key[order], np.stack([held[c].to_numpy() for c in names])[:, order]
            for group, blob in zip(asked["group"].to_pylist(), asked["keys"].to_pylist(), strict=True):
                mine = np.frombuffer(blob, np.uint64)
                at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                at = at[key[at] == mine]
                if len(at):
                    rows.append((group, key[at].tobytes(), counts[:, at].T.tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["group", "keys", "counts"])

    def score(t: pa.Table, answers: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(answers["keys"].to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(answers["counts"].to_pylist()), np.int64).reshape(-1, len(names))
        order = np.argsort(keys)
        own = Models({k: counts[order, i].astype(np.float64) for i, k in enumerate(_TABLES)}, keys[order])
        t = t.select(columns).combine_chunks()
        scores = [own.score(*common.text_bytes(b.column("line"))) for b in common.slices(iter(t.to_batches()), "line")]
        return t.append_column("score", pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64()))

    by_group = dealt.groupBy("group")
    asked = dealt.select("group", "line").groupBy("group").applyInArrow(ask, "group long, bucket long, keys binary")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "group long, keys binary, counts binary")
    return by_group.cogroup(answers.groupBy("group")).applyInArrow(score, ", ".join(f"{c} {t}" for c, t in urls.dtypes) + ", score double")


def calibrate(scored: DataFrame) -> float:
    """The threshold at which the mean share of rightly judged URLs of the two verdicts is largest, from a fixed histogram."""
    bin_ = F.floor((F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT - 1e-9), F.col("score"))) + _LIMIT) * (_HIST / (2 * _LIMIT))).cast("int")
    rows = scored.groupBy("verdict", bin_.alias("bin")).count().collect()
    h = {v: np.zeros(_HIST) for v in ("allow", "block")}
    for r in rows:
        h[r["verdict"]][r["bin"]] += r["count"]
    if not all(x.any() for x in h.values()):
        return 0.0
    below = {v: np.concatenate([[0], np.cumsum(x)]) / x.sum() for v, x in h.items()}
    right = below["block"] + 1 - below["allow"]
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(best[len(best) // 2] * (2 * _LIMIT / _HIST) - _LIMIT)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row."""
    host, path = host_and_path(F.col("url").cast("string"))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    d = d.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.concat("host", "path").alias("line"))
    apart = F.pmod(F.xxhash64("line"), F.lit(5)) == 0
    model = fit(d.where("verdict is not null").where(~apart))
    if model is None:
        return d.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    scored = common.written(_with_scores(d, model).withColumn("apart", apart).drop("line"))
    threshold = calibrate(scored.where("apart and verdict is not null"))
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")


def op4_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))

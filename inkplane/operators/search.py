"""Similar sketches. A sketch is a name with the vectors of its views.

Mean scores need no pair of views: the mean dot product of all pairs is the dot product of the two means. Only
the best pair compares views, all of them with all of the query's: both are packed in blocks, and each pair of blocks is
one product of matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Views of a block; a block of the query's views holds no more than MOST_VIEWS either.
BLOCK, MOST_VIEWS = 4096, 20_000


def _unit(views: DataFrame) -> DataFrame:
    return views.select("name", V.unit(V.as_double(F.col("vec"))).alias("u"))


def _mean(views: DataFrame, vec: str, by: str | None = "name") -> DataFrame:
    """Elementwise mean of vectors."""
    each = views.select(*([by] if by else []), F.posexplode(vec).alias("pos", "x"))
    mean = each.groupBy(*([by] if by else []), "pos").agg(F.avg("x").alias("x"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("mean")
    return mean.groupBy(by).agg(whole) if by else mean.agg(whole)


def _sound(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False))


def _packed(views: DataFrame, blocks: int, names: bool) -> DataFrame:
    """Different vectors v in blocks of one length, dealt by a hash: vectors as float64 over their length, and the name of each."""

    def pack(t: pa.Table) -> pa.Table:
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        with np.errstate(over="ignore", invalid="ignore"):
            u = x / np.maximum(np.sqrt(np.square(x).sum(1, keepdims=True)), V.FLOOR)
        own = {"dim": pa.array([x.shape[1]], pa.int32()), "block": t["block"].slice(0, 1), "u": pa.array([u.tobytes()], pa.binary())}
        return pa.table(own | ({"names": pa.array([t["name"].to_pylist()], pa.list_(pa.string()))} if names else {}))

    kept = [*(["name"] if names else []), "v"]
    dealt = views.select(*kept).distinct().select(*kept, F.size("v").alias("dim"), F.pmod(F.xxhash64(*kept), F.lit(blocks)).alias("block"))
    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block long, u binary" + ", names array<string>" * names)


def best_pair(views: DataFrame, query: str) -> DataFrame:
    """Largest cosine of a view of the query with a view of each sketch; null for a sketch without a whole vector, no row without the query."""
    rows = views.select("name", V.as_double(F.col("vec")).alias("v"))
    n = rows.agg(F.count("*").alias("all"), F.count(F.when(F.col("name") == query, 1)).alias("own")).first()
    whole = rows.where(_sound(F.col("v")))
    blocks = max(1, -(-n["all"] // BLOCK))
    salts = min(blocks, int(views.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = _packed(whole.where(F.col("name") == query), max(1, -(-n["own"] // min(BLOCK, MOST_VIEWS))), False)
    own = own.select("dim", F.col("u").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    every = _packed(whole, blocks, True).withColumn("salt", F.pmod("block", F.lit(salts)).cast("int"))
    met = every.join(own.hint("merge"), ["salt", "dim"]).select("dim", "names", "u", "q")  # Spark would take the copies of `own` for small

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column("dim")[r].as_py()
                x, q = (np.frombuffer(b.column(c)[r].as_py(), np.float64).reshape(-1, max(dim, 1)) for c in ("u", "q"))
                with np.errstate(invalid="ignore"):
                    at = np.concatenate([(part @ q.T).argmax(1) for part in np.array_split(x, -(-len(x) // 1024))]) if dim else np.zeros(0, int)
                    best = (x * q[at]).sum(1) if dim else np.zeros(len(b.column("names")[r]))  # not the product's, whose last bits follow the shape of a block
                yield pa.RecordBatch.from_arrays([b.column("names")[r].values, pa.array(best, pa.float64())], names=["name", "s"])

    found = met.mapInArrow(run, "name string, s double")
    if n["own"]:
        found = found.unionByName(rows.where(~_sound(F.col("v"))).select("name", F.lit(None).cast("double").alias("s")))
    return found.groupBy("name").agg(F.max("s").alias("score"))


def mean_pair(views: DataFrame, query: str) -> DataFrame:
    """Mean cosine over all pairs of views."""
    means = _mean(_unit(views), "u")
    own = means.where(F.col("name") == query).select(F.col("mean").alias("q"))
    return means.crossJoin(F.broadcast(own)).select("name", V.dot(F.col("q"), F.col("mean")).alias("score"))


def mean_embedding(views: DataFrame, query: str) -> DataFrame:
    """Cosine of the mean vectors."""
    means = _mean(views.select("name", V.as_double(F.col("vec")).alias("v")), "v").select("name", V.unit(F.col("mean")).alias("u"))
    own = means.where(F.col("name") == query).select(F.col("u").alias("q"))
    return means.crossJoin(F.broadcast(own)).select("name", V.dot(F.col("q"), F.col("u")).alias("score"))


STRATEGIES = {"best_pair": best_pair, "mean_pair": mean_pair, "mean_embedding": mean_embedding}


def similar(views: DataFrame, query: str, strategy: str = "best_pair", top_k: int = 5, digits: int | None = None) -> DataFrame:
    """The top_k sketches by a strategy, by scores of so many digits; ties go by name, the query counts as a candidate."""
    scores = STRATEGIES[strategy](views, query)
    scores = scores if digits is None else scores.withColumn("score", F.round("score", digits))
    return scores.orderBy(F.desc("score"), "name").limit(top_k)


def summary(views: DataFrame) -> DataFrame:
    """Views of each sketch, and how many sketches and views there are."""
    each = views.groupBy("name").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("sketches"), F.sum("n").alias("views"), F.min("n").alias("least"), F.max("n").alias("most"))


def embed(sheets: DataFrame, embedder, dim: int) -> DataFrame:
    """(name, view_no, vec) of sheets with crops, by an embedder made once a task; sheets with an error or without crops are left out."""
    crops = sheets.where("error is null and size(crops) > 0").select("name", F.posexplode("crops").alias("view_no", "crop"))

    def run(batches):
        import pyarrow as pa

        model = embedder()
        for b in batches:
            vec = [model(c) for c in b.column("crop").to_pylist()]
            assert all(len(v) == dim for v in vec)
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("view_no"), pa.array(vec, pa.list_(pa.float32()))], names=["name", "view_no", "vec"])

    return crops.mapInArrow(run, "name string, view_no int, vec array<float>")

"""What the operators of this subpackage share: session settings, lineage cuts, byte kernels over Arrow text.

Texts reach Python as Arrow batches. The kernels work on the UTF-8 buffer of a whole slice of documents
at once, so the cost of a call is spread over some megabytes; slices are bounded in bytes, never in content.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one kernel call takes (one longer document is a slice of its own).
SLICE_BYTES = 1 << 19


def bounded(spark: SparkSession) -> None:
    """Arrow batches of long rows stay small, whatever number of rows the session allows in one; so do descriptions of plans, which the driver keeps (lookup tables are literals)."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20), ("spark.sql.maxPlanStringLength", 1 << 16)):
        given = spark.conf.get(name, None)
        if not given or name.endswith("Length") and given == str((1 << 31) - 16):
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where none is set and all runs in one process (tests)."""
    bounded(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder; lost executors cost nothing that was computed before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; what is written there goes when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where, fs = _file_system(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def running(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """df with the sums of columns (or of "1") over all rows before each in a total order, by name: sorted in ranges, each offset by the ranges before it."""
    parts = partitions(df.sparkSession)
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = ranged.groupBy("__part").agg(*[F.sum(F.expr(v)).alias(f"__{k}") for k, v in values.items()])  # a row a partition
    offsets = totals.select("__part", *[zero(F.sum(f"__{k}").over(before)).alias(f"__{k}") for k in values])
    placed = ranged.join(F.broadcast(offsets), "__part")
    return placed.select(*df.columns, *[(zero(F.sum(F.expr(v)).over(within)) + F.col(f"__{k}")).alias(k) for k, v in values.items()])


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: a cut that is compressed and read by column."""
    spark = df.sparkSession
    path = f"{scratch(spark, 'table')}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, by: str, number: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """(by, block): the rows of df in compressed blocks, those of one number `by` in each batch together. Texts so cost a third of a shuffle.

    number: makes the column `by` where df does not have it.
    """
    columns = [c for c in df.columns if c != by]

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=8))
        for b in number(batches) if number else batches:
            key = b.column(by).to_numpy()
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True]) if len(key) else []
            rows = b.select(columns).take(pa.array(order))
            keys, blocks = [], []
            for s, t in zip(cuts[:-1], cuts[1:], strict=True):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, rows.schema, options=options) as w:
                    w.write_batch(rows.slice(s, t - s))
                keys.append(key[order[s]])
                blocks.append(out.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], names=[by, "block"])

    return df.mapInArrow(run, f"{by} long, block binary")


def unpacked(blocks: pa.ChunkedArray) -> pa.Table:
    """The rows of some blocks; none of an empty column."""
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blocks])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take at most `most` bytes together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    trim()


def trim() -> None:
    """Gives back what the allocators of this process hold unused; workers live from stage to stage."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts and the n + 1 offsets in them; a null counts as empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def byte_class(chars: bytes, high: bool) -> np.ndarray:
    """Table of 256 flags: the named bytes, and all of 0x80 and above if high."""
    t = np.zeros(256, bool)
    t[list(chars)] = True
    t[128:] = high
    return t


#: `[^\x20\x09-\x0D]+`: white space parts words.
SPACED = ~byte_class(b" \t\n\x0b\x0c\r", False)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: letters, digits, whatever lies beyond ASCII.
ALNUM = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz", True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of bytes of a kind; runs end where their document ends."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    c = kind[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    st, en = c.copy(), c.copy()
    st[1:] &= ~c[:-1] | first[1:n]
    en[:-1] &= ~c[1:] | first[1:n]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def powers(n: int, back: bool = False) -> np.ndarray:
    """1, B, B^2 ... modulo 2^64 (or of B's inverse), kept between calls."""
    p = _POWERS.get(key := "back" if back else "on")
    if p is None or len(p) < n:
        p = np.empty(max(n, 1 << 16), np.uint64)
        p[0], p[1:] = 1, _BACK if back else _BASE
        np.cumprod(p, out=p)
        _POWERS[key] = p
    return p[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the polynomial of bytes i to j; see span_hash."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings from starts to ends, the same wherever a string stands."""
    return mix((h[ends] - h[starts]) * powers(len(h), True)[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def order_in(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """An order by group (numbers below 65536 are radix-sorted), then key."""
    first = np.argsort(key)
    g = group[first]
    return first[np.argsort(g.astype(np.uint16) if not len(g) or g.max() < 1 << 16 else g, kind="stable")]


def sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by group 0..n-1."""
    return np.bincount(group, values, n)

"""Pictures: PNG and BMP in numpy, other formats by Spark's picture source; sheets from files, sinks by name. A sheet is a row; an error is a column, not an exception."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings that count as pictures: those read here, those that Spark's source decodes.
OWN, OTHER = ("png", "bmp"), ("jpg", "jpeg", "tif", "tiff")
ENDINGS = (*OWN, *OTHER)
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Begins a picture that is decoded already: height, width, channels, then rows of blue, green, red.
_RAW = b"RAW "


def encode_png(img: np.ndarray) -> bytes:
    """PNG of a grey [h, w] or RGB [h, w, 3] picture of uint8."""
    _check(img)
    h, w = img.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, -1)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if img.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + chunk(b"IEND", b"")


def encode_bmp(img: np.ndarray) -> bytes:
    """BMP of 24 bits of a grey or RGB picture of uint8."""
    _check(img)
    h, w = img.shape[:2]
    rgb = np.repeat(img[..., None], 3, axis=2) if img.ndim == 2 else img
    line = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, line), np.uint8)
    rows[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + h * line, 0, 0, 54, 40, w, h, 1, 24, 0, h * line, 0, 0, 0, 0) + rows.tobytes()


def _check(img: np.ndarray) -> None:
    if img.dtype != np.uint8 or img.ndim not in (2, 3) or img.ndim == 3 and img.shape[2] != 3:
        raise TypeError("a uint8 picture, grey or RGB, is wanted")


def decode_png(data: bytes) -> np.ndarray:
    """RGB picture of a PNG without interlacing: grey, RGB, palette, with or without alpha (which is dropped); of 16 bits the upper eight."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, palette, head = 8, BytesIO(), None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.write(part)
        at += 12 + n
    if head is None or head[6]:
        raise ValueError("only PNG without interlacing can be read")
    w, h, bits, color = head[:4]
    k = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    line = (w * k * bits + 7) // 8
    raw = np.frombuffer(zlib.decompress(body.getvalue()), np.uint8).reshape(h, 1 + line)
    out = _unfilter(raw[:, 0], raw[:, 1:], max(1, k * bits // 8))
    if bits == 16:
        out = out[:, ::2]
    elif bits < 8:
        out = np.unpackbits(out, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
        out = out[:, : w * k].astype(np.uint8)
        if color != 3:
            out = out * np.uint8(255 // ((1 << bits) - 1))
    px = out.reshape(h, w, k)
    if color == 3:
        return palette[px[..., 0]]
    return np.repeat(px[..., :1], 3, axis=2) if color in (0, 4) else px[..., :3].copy()


def _unfilter(kinds: np.ndarray, raw: np.ndarray, k: int) -> np.ndarray:
    """Rows with their filters undone: by sums along rows and from row to row, or, where pixels need those around them, all rows at once along diagonals."""
    h, n = raw.shape
    if not (kinds > 2).any():
        out = raw.copy()
        pad = -n % k
        for y in np.flatnonzero(kinds):
            if kinds[y] == 1:
                out[y] = np.cumsum(np.pad(raw[y], (0, pad)).reshape(-1, k), axis=0, dtype=np.uint8).ravel()[:n]
            elif y:
                out[y] += out[y - 1]
        return out
    w = -(-n // k)
    px = np.zeros((h + 1, w + 1, k), np.int16)  # a row above and a pixel to the left that are 0
    px[1:, 1:].reshape(h, -1)[:, :n] = 0
    wide = np.zeros((h, w * k), np.uint8)
    wide[:, :n] = raw
    wide = wide.reshape(h, w, k)
    kind = kinds.astype(np.int16)[:, None]
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, c = px[y + 1, x], px[y, x + 1], px[y, x]
        e = a + b - c
        ea, eb, ec = np.abs(e - a), np.abs(e - b), np.abs(e - c)
        paeth = np.where((ea <= eb) & (ea <= ec), a, np.where(eb <= ec, b, c))
        guess = np.choose(kind[y], [np.int16(0), a, b, (a + b) >> 1, paeth])
        px[y + 1, x + 1] = (wide[y, x] + guess) & 255
    return px[1:, 1:].astype(np.uint8).reshape(h, -1)[:, :n]


def decode_bmp(data: bytes) -> np.ndarray:
    """RGB picture of an uncompressed BMP of 8, 24 or 32 bits."""
    start, head, w, h, _, bits, packed = struct.unpack("<I I ii HH I", data[10:34])
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits can be read")
    line, k = (w * bits + 31) // 32 * 4, bits // 8
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * k].reshape(abs(h), w, k)
    if h > 0:
        rows = rows[::-1]
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        return np.ascontiguousarray(colours[rows[..., 0]][..., 2::-1])
    return np.ascontiguousarray(rows[..., 2::-1])


def decode(data: bytes) -> np.ndarray:
    """RGB picture of a file's bytes, or of one that Spark's source decoded."""
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:4] == _RAW:
        head, _, body = data.partition(b"\n")
        h, w, k = map(int, head.split()[1:])
        px = np.frombuffer(body, np.uint8).reshape(h, w, k)
        return np.repeat(px, 3, axis=2) if k == 1 else np.ascontiguousarray(px[..., 2::-1])
    return decode_png(data)


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """(h, w) from a picture's head, None of a broken one."""
    try:
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return abs(h), w
        if data[:4] == _RAW:
            h, w, _ = map(int, data.partition(b"\n")[0].split()[1:])
            return h, w
        w, h = struct.unpack(">II", data[16:24])
        return (h, w) if data[:8] == _SIGNATURE else None
    except (TypeError, ValueError, struct.error):
        return None


def load(src) -> np.ndarray:
    """A picture from an array (as it is), bytes or a path."""
    if src is None:
        raise ValueError("not a picture that can be decoded")
    if isinstance(src, np.ndarray):
        if src.ndim != 3 or src.shape[2] != 3:
            raise ValueError("an array of [h, w, 3] is wanted")
        return src
    if isinstance(src, (bytes, bytearray, memoryview)):
        return decode(bytes(src))
    if not os.path.exists(src):
        raise FileNotFoundError(src)
    with open(src, "rb") as f:
        return decode(f.read())


def encode(name: str, img: np.ndarray) -> bytes:
    """A picture in the format its file's name asks for."""
    ending = os.path.splitext(name)[1].lower().lstrip(".")
    if ending not in OWN:
        raise ValueError(f"{name}: pictures can be written as {' or '.join(OWN)}")
    return encode_bmp(img) if ending == "bmp" else encode_png(img)


def save(path: str, img: np.ndarray) -> str:
    """A picture as a file, in folders that are made; the format is that of the ending."""
    data = encode(path, img)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def discover(spark: SparkSession, sources: list[str]) -> DataFrame:
    """(path, source, content) of files as they are and of the pictures in folders; folders are not entered. source and path order them.

    Formats beyond PNG and BMP are decoded by Spark's own source; content is null where it cannot.
    """
    if not sources:
        raise ValueError("no files or folders are named")
    named = spark.createDataFrame([(_uri(spark, s), i) for i, s in enumerate(sources)], "uri string, source int").groupBy("uri").agg(F.min("source").alias("source"))
    files = spark.read.format("binaryFile").load(sources)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))

    def ordered(rows: DataFrame) -> DataFrame:
        """Rows with the argument that names them: the file, or its folder. The arguments are few, they come from a command line."""
        n = F.broadcast(named)
        as_file = rows.join(n.withColumnRenamed("source", "_file"), F.col("path") == F.col("uri"), "left").drop("uri")
        both = as_file.join(n.withColumnRenamed("source", "_folder"), folder == F.col("uri"), "left").drop("uri")
        both = both.where(F.col("_file").isNotNull() | (F.col("_folder").isNotNull() & ending.isin(*ENDINGS)))
        return both.withColumn("source", F.least("_file", "_folder")).drop("_file", "_folder")

    own = ordered(files.where(~ending.isin(*OTHER)).select("path", "content"))
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in OTHER) + "}"
    names = ordered(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(sources).select("path"))
    image = spark.read.format("image").option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).load(sources).select("image.*").where("height > 0")
    head = F.encode(F.format_string("RAW %d %d %d\n", "height", "width", "nChannels"), "UTF-8")
    # Spark's source names files by another form of their URI (file:///x, not file:/x)
    decoded = image.select(F.regexp_replace("origin", "^([a-z0-9]+):/+", "$1:/").alias("_p"), F.concat(head, "data").alias("content"))
    other = names.join(decoded, F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/") == F.col("_p"), "left").select("path", "content", "source")
    return own.select("path", "source", "content").unionByName(other)


def _uri(spark: SparkSession, source: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/")


def map_sheets(sheets: DataFrame, fn: Callable[..., dict], schema: str) -> DataFrame:
    """(path, source, the columns of schema, error): fn on each picture, one at a time in its task; what it raises becomes the row's error.

    fn takes the path, the picture and a dict of the sheet's other columns.
    """
    names = [re.split(r"[\s:]+", c.strip())[0] for c in re.split(r",(?![^<]*>)", schema)]
    more = [c for c in sheets.columns if c not in ("path", "source", "content")]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                given = {c: b.column(c)[i].as_py() for c in b.schema.names}
                row = dict.fromkeys(names)
                error = None
                try:
                    row |= fn(given["path"], load(given["content"]), {c: given[c] for c in more})
                except Exception as e:  # noqa: BLE001  an error of one sheet is a result
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"path": given["path"], "source": given["source"], **row, "error": error}], schema=out)

    target = f"path string, source int, {schema}, error string"
    out = arrow_schema(sheets.sparkSession, target)
    return sheets.select("path", "source", "content", *more).mapInArrow(run, target)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def one_name_each(rows: DataFrame, name: str = "name") -> None:
    """Raises if several rows would be written under one name."""
    twice = rows.groupBy(name).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several pictures are named {twice[0][0]}")


def write_pictures(rows: DataFrame, folder: str, name: str = "name", data: str = "png") -> int:
    """Encoded pictures as files of a shared folder, from the tasks; returns how many. Names must differ."""
    one_name_each(rows, name)

    def run(batches):
        n = 0
        for b in batches:
            for x, content in zip(b.column(name).to_pylist(), b.column(data).to_pylist(), strict=True):
                os.makedirs(folder, exist_ok=True)
                with open(os.path.join(folder, x), "wb") as f:
                    f.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return rows.select(name, data).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def view_names(sheets: DataFrame) -> DataFrame:
    """(name, png) of the views of each sheet: its stem and the view's number."""
    first = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return sheets.select(first.alias("stem"), F.posexplode("views").alias("k", "png")).select(F.format_string("%s_%d.png", "stem", "k").alias("name"), "png")

"""SentencePiece encoding and decoding over a relational lattice.

A text (a mark `▁` before it and for each space) is cut into units, between which no piece of the vocabulary
reaches. The distinct units of the corpus become a lattice: their substrings of bounded length are exploded
and equi-joined to the piece table, the edges that match are grouped by unit, and a higher-order aggregate folds
them into pieces: for a unigram vocabulary by Viterbi, for a BPE vocabulary by its merges (the joined pair of
least rank, leftmost first), since Viterbi over a BPE vocabulary's scores gives other pieces than the model does.
Characters of no piece fall back to bytes. Viterbi takes units of any length. Merges are folded up to LONG characters,
longer units (text of thousands of letters without a space, digit or sign) go through a heap with the same result, since a
unit's edges are one row and must fit in memory.

Texts are dealt in chunks; a chunk hands on its distinct units once, packed, and gets their ids back, so no
row stands for one word of one document. All steps are one plan over one exchange of the texts. decode() is SQL; the
digests of decoded texts are made where the ids are put together, so that no plan holds the table of pieces for them.

Edge cases: null and empty texts have no pieces; a `▁` in a text decodes as a space; repeated rows give
repeated rows; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Most characters of a unit whose boundaries are bits of a number; of one that a BPE vocabulary's fold takes (its edges take some 100 times
#: its size in memory), longer ones are merged by a heap; places in a part of a Viterbi path.
SHORT, LONG, BACK = 60, 2048, 256
#: Bytes of text in a chunk, and in a bucket of units on average.
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 4 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a model file: id, rank (0 merges first; equal scores share one), score; first id of the byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        own = m.normalizer_spec
        plain = not own.precompiled_charsmap and not own.normalization_rule_tsv and not m.denormalizer_spec.precompiled_charsmap
        if not plain or not own.add_dummy_prefix or own.remove_extra_whitespaces or not own.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only models that keep text as it is, with a mark before it and for each space, are supported")
        if m.trainer_spec.model_type not in (proto.TrainerSpec.BPE, proto.TrainerSpec.UNIGRAM) or any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in m.pieces):
            raise ValueError(f"{path}: only BPE and unigram models without pieces of the user's own are supported")
        if sum(p.type == proto.ModelProto.SentencePiece.BYTE for p in m.pieces) != 256:
            raise ValueError(f"{path}: only models with byte pieces are supported")
        self.bpe = m.trainer_spec.model_type == proto.TrainerSpec.BPE
        self.byte0 = next((i for i, p in enumerate(m.pieces) if p.type == proto.ModelProto.SentencePiece.BYTE), None)
        normal = [(p.piece, i, p.score) for i, p in enumerate(m.pieces) if p.type == proto.ModelProto.SentencePiece.NORMAL]
        order = {s: r for r, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        self.pieces = {p: (i, order[s], s) for p, i, s in normal}
        self.size = len(m.pieces)
        self.longest = max(map(len, self.pieces))
        self.texts = ["" if p.type != proto.ModelProto.SentencePiece.BYTE and p.type != proto.ModelProto.SentencePiece.NORMAL else p.piece for p in m.pieces]
        self.signs: set[str] = {c for p in self.pieces if len(p) > 1 for c in p if c.isspace()}
        self.pattern = self._pattern()
        self._classes: np.ndarray | None = None
        self._spelled: tuple[np.ndarray, np.ndarray] | None = None

    def _pattern(self) -> str:
        """Units: letters or other signs with the marks before them, marks alone, single digits and line ends; as fine as the pieces allow."""
        signs = self.signs
        while True:
            own = "".join(re.escape(c) for c in sorted(signs))
            pattern = rf"{MARK}*[^\W\d_{own}{MARK}]+|{MARK}*(?:[^\w\s{MARK}]|[_{own}])+|{MARK}+|[\d\s]"
            unit = re.compile(pattern)
            cut = [p for p in self.pieces if unit.fullmatch(p) is None]
            more = {c for p in cut for c in p if c.isalnum()} - signs
            if not cut:
                return pattern
            if not more or any(c.isascii() for c in more):
                return rf"{MARK}*[^{MARK}]+|{MARK}+"
            signs |= more

    def classes(self) -> np.ndarray:
        """For each code point how units are cut: 0 marks, 1 and 2 kinds that make runs, 3 alone. Says the same as the pattern."""
        if self._classes is None:
            table = np.full(0x110000, 1, np.uint8)
            if self.pattern.startswith(rf"{MARK}*[^\W"):
                letter, alone = re.compile(self.pattern.split("|")[0].removeprefix(f"{MARK}*").removesuffix("+")), re.compile(r"[\d\s]")
                for c in range(0x110000):
                    ch = chr(c)
                    table[c] = 1 if letter.match(ch) else 3 if alone.match(ch) and ch not in self.signs else 2
            table[ord(MARK)] = 0
            self._classes = table
        return self._classes

    def ids_of(self, unit: str) -> list[int]:
        """Pieces of a unit by merges, with a heap."""
        n = len(unit)
        start, end, nxt, prev = list(range(n)), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and end[j] - start[i] <= self.longest and (p := self.pieces.get(unit[start[i] : end[j]])):
                heapq.heappush(heap, (p[1], i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, e, e2 = heapq.heappop(heap)
            j = nxt[i] if end[i] == e else n
            if j >= n or end[j] != e2:
                continue
            end[i], nxt[i] = e2, nxt[j]
            end[j] = -1
            if nxt[j] < n:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out, i = [], 0
        while i < n:
            piece = unit[start[i] : end[i]]
            out += [self.pieces[piece][0]] if piece in self.pieces else [self.byte0 + b for b in piece.encode()]
            i = nxt[i]
        return out


    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces as they decode, one after the other, and where each begins (and the last ends)."""
        if self._spelled is None:
            parts = [bytes([i - self.byte0]) if self.byte0 <= i < self.byte0 + 256 else t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)]
            self._spelled = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return self._spelled

    def digests(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """SHA-256 of the text that each stretch of ids decodes to: bytes of the pieces, the first space dropped."""
        blob, start = self.spelled()
        size = np.diff(start)
        out = []
        a = 0
        while a < len(ends) - 1:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 18), "right")) - 1)
            own = ids[ends[a] : ends[b]]
            n = size[own]
            upto = np.cumsum(n)
            text = blob[np.arange(upto[-1] if len(n) else 0) + np.repeat(start[:-1][own] - (upto - n), n)].tobytes()
            cuts = np.concatenate([[0], upto])[ends[a : b + 1] - ends[a]].tolist()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                out.append(hashlib.sha256(text[x + (text[x : x + 1] == b" " and y > x) : y]).hexdigest())
            a = b
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_ODD = np.uint64(0xD6E8FEB86659FD93)


def cut_units(texts: list[str | None], classes: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The marked texts as one string, the starts of all units in it and its end, the number of each text's units, and of each unit a 64-bit hash."""
    parts = [marked(t) for t in texts]
    whole = "".join(parts)
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    if not len(cp):
        return whole, np.zeros(1, np.int64), np.zeros(len(texts), np.int64), np.zeros(0, np.uint64), off
    k = classes[cp]
    start = np.ones(len(cp), bool)
    prev, now = k[:-1], k[1:]
    start[1:] = (now == 3) | ((now == 0) & (prev != 0)) | ((now > 0) & (now != prev) & (prev != 0))
    start[off[off < len(cp)]] = True
    at = np.concatenate([np.flatnonzero(start), [len(cp)]])
    h = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(common.mix(cp.astype(np.uint64) + _ODD) * common.powers(len(cp)), out=h[1:])
    return whole, at, np.diff(np.searchsorted(at[:-1], off)), common.span_hash(h, at[:-1], at[1:]), off


def marked(text: str | None) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


class _Mask:
    """Boundaries of a unit of up to SHORT characters as bits of a number: what is there, what a pair needs, what is left when it merges."""

    whole = "(shiftleft(1L, length(unit) + 1) - 1L)"
    #: Bit that a walk sets where it must begin anew.
    again = "shiftleft(1L, 62)"

    @classmethod
    def fits(cls, m: str, e: str) -> str:
        return f"({m} & {e}.ends) = {e}.ends AND bit_count({m} & {e}.inner) = 1"

    @classmethod
    def merged(cls, m: str, e: str) -> str:
        return f"({m} & ~{e}.inner)"

    @classmethod
    def pending(cls, m: str) -> str:
        return f"{m} >= {cls.again}"

    @classmethod
    def marked(cls, m: str, when: str) -> str:
        return f"({m} | CASE WHEN {when} THEN {cls.again} ELSE 0L END)"

    @classmethod
    def cleared(cls, m: str) -> str:
        return f"({m} & ~{cls.again})"

    @classmethod
    def one_piece(cls, m: str, e: str) -> str:
        return f"({m} & {e}.ends) = {e}.ends AND ({m} & {e}.inner) = 0L"

    @classmethod
    def alone(cls, m: str) -> str:
        return f"shiftright({m}, i) & 3L = 3L"


class _Bytes:
    """The same for longer units: a byte for each boundary, '1' while it is there, behind one that says whether the walk must begin anew."""

    whole = "cast(concat('0', repeat('1', length(unit) + 1)) AS binary)"

    @classmethod
    def _part(cls, m: str, e: str) -> str:
        return f"cast(substring({m}, {e}.i + 2, {e}.n + 1) AS string)"

    @classmethod
    def fits(cls, m: str, e: str) -> str:
        part = cls._part(m, e)
        return f"startswith({part}, '1') AND endswith({part}, '1') AND length(replace({part}, '0', '')) = 3"

    @classmethod
    def merged(cls, m: str, e: str) -> str:
        return f"concat(substring({m}, 1, {e}.i + 2), cast(repeat('0', {e}.n - 1) AS binary), substring({m}, {e}.i + {e}.n + 2, length({m})))"

    @classmethod
    def pending(cls, m: str) -> str:
        return f"substring({m}, 1, 1) = cast('1' AS binary)"

    @classmethod
    def marked(cls, m: str, when: str) -> str:
        return f"(CASE WHEN {when} THEN concat(cast('1' AS binary), substring({m}, 2, length({m}))) ELSE {m} END)"

    @classmethod
    def cleared(cls, m: str) -> str:
        return f"concat(cast('0' AS binary), substring({m}, 2, length({m})))"

    @classmethod
    def one_piece(cls, m: str, e: str) -> str:
        return f"{cls._part(m, e)} = concat('1', repeat('0', {e}.n - 1), '1')"

    @classmethod
    def alone(cls, m: str) -> str:
        return f"substring({m}, i + 2, 2) = cast('11' AS binary)"


def _fold_merges(kind) -> str:
    """SQL of the boundaries that are left when no pair merges; `pairs` are the edges of several characters, least rank first.

    Two neighbours make an edge if both its ends are there and one boundary between. A walk along the pairs does all
    merges in their order, unless a merge makes a pair of lesser rank possible; only an `odd` piece can be such
    a pair. Where one is, the walk merges no more and the next one begins at the least pair: at most one walk for each odd
    edge, and one.
    """
    earlier = f"exists(odds, o -> (o.rank < e.rank OR (o.rank = e.rank AND o.i < e.i)) AND {kind.fits('r', 'o')})"
    merge = f"get(transform(array({kind.merged('m', 'e')}), r -> {kind.marked('r', earlier)}), 0)"
    walk = f"aggregate(pairs, {{start}}, (m, e) -> CASE WHEN {kind.pending('m')} THEN m WHEN {kind.fits('m', 'e')} THEN {merge} ELSE m END)"
    first, next_ = walk.format(start=kind.whole), walk.format(start=kind.cleared("w"))
    return f"aggregate(odds, {first}, (w, o) -> CASE WHEN {kind.pending('w')} THEN {next_} ELSE w END)"


def _fold_viterbi() -> str:
    """SQL of the path with the largest sum of scores, as edges (i, id) with those of one character; `ways` are the edges by their end.

    Scores are kept of the last `longest` places only, and the way back in parts of BACK places, so a step costs the same
    wherever in the unit it is.
    """
    best = "array_max(transform(get(ways, j - 1).edges, e -> struct(get(b.scores, cast(size(b.scores) - e.n AS int)) + e.score AS score, -e.n AS n, e.id AS id)))"
    step = f"get(transform(array({best}), t -> struct(slice(concat(b.scores, array(t.score)), -least(size(b.scores) + 1, longest), longest) AS scores, concat(b.back, array(struct(-t.n AS n, t.id AS id))) AS back)), 0)"
    empty = "cast(array() AS array<struct<n:int,id:int>>)"
    part = f"aggregate(sequence(p, least(p + {BACK - 1}, length(unit))), struct(s.scores AS scores, {empty} AS back), (b, j) -> {step})"
    forth = f"aggregate(sequence(1, length(unit), {BACK}), struct(array(0D) AS scores, cast(array() AS array<array<struct<n:int,id:int>>>) AS back), (s, p) -> get(transform(array({part}), x -> struct(x.scores AS scores, concat(s.back, array(x.back)) AS back)), 0)).back"
    at = f"get(get(back, cast((c.at - 1) DIV {BACK} AS int)), cast((c.at - 1) % {BACK} AS int))"
    walk = f"CASE WHEN c.at <= low THEN c ELSE get(transform(array({at}), g -> struct(c.at - g.n AS at, concat(c.left, array(struct(c.at - g.n AS i, g.id AS id))) AS left)), 0) END"
    low = f"p - least(p, {BACK})"
    none = "cast(array() AS array<struct<i:int,id:int>>)"
    inner = f"get(transform(array({low}), low -> aggregate(sequence(low + 1, p), struct(r.at AS at, {none} AS left), (c, t) -> {walk})), 0)"
    parts = f"aggregate(sequence(length(unit), 1, -{BACK}), struct(length(unit) AS at, cast(array() AS array<array<struct<i:int,id:int>>>) AS left), (r, p) -> get(transform(array({inner}), x -> struct(x.at AS at, concat(r.left, array(x.left)) AS left)), 0)).left"
    return f"get(transform(array({forth}), back -> reverse(flatten({parts}))), 0)"


def odd(piece: str, pieces: dict[str, tuple]) -> bool:
    """Whether a piece merges before another one that it starts or ends with."""
    parts = [piece[:n] for n in range(2, len(piece))] + [piece[-n:] for n in range(2, len(piece))]
    return any(p in pieces and pieces[p][1] >= pieces[piece][1] for p in parts)


def _edges(units: DataFrame, v: Vocabulary, keys: list[str]) -> DataFrame:
    """keys, i, n, piece and, where the piece is in the table, its id, rank, score and whether it is odd: all substrings of bounded length."""
    spark = units.sparkSession
    table = spark.createDataFrame(pa.table({"piece": list(v.pieces), "id": pa.array([p[0] for p in v.pieces.values()], pa.int32()), "rank": pa.array([p[1] for p in v.pieces.values()], pa.int32()), "score": [p[2] for p in v.pieces.values()], "odd": [odd(p, v.pieces) for p in v.pieces]}))
    cut = units.select(*keys, F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("i"))
    cut = cut.select(*keys, "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(v.longest), F.length("unit") - F.col("i")))).alias("n"))
    cut = cut.withColumn("piece", F.substring(F.col("unit"), F.col("i") + 1, F.col("n")))
    return cut.where("n > 1 OR i = 0" if v.bpe else "true").join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR n = 1")  # n = 1: every unit stays


def lattice(units: DataFrame, v: Vocabulary, by: tuple[str, ...] = ()) -> DataFrame:
    """(unit, ids) of distinct units (with the columns `by` that partition them); of a BPE vocabulary those of up to LONG characters."""
    keys = ["unit", *by]
    return _merged(units.where(F.length("unit") <= LONG), v, keys) if v.bpe else _unigram(units, v, keys)


def _merged(units: DataFrame, v: Vocabulary, keys: list[str]) -> DataFrame:
    """By merges: boundaries are bits of a number, or bytes of longer units."""
    ends, inner = F.expr("shiftleft(1L, i) | shiftleft(1L, i + n)"), F.expr("shiftleft(shiftleft(1L, n - 1) - 1L, i + 1)")
    edge = F.struct("rank", "i", "n", inner.alias("inner"), ends.alias("ends"), "id", "odd")
    edges = _edges(units, v, keys).groupBy(*keys).agg(F.collect_list(F.when(F.col("n") > 1, edge)).alias("edges"))
    edges = edges.withColumn("pairs", F.array_sort("edges")).withColumn("odds", F.filter("pairs", lambda e: e["odd"]))
    either = lambda bits, more: F.expr(f"CASE WHEN length(unit) <= {SHORT} THEN {bits} ELSE {more} END")
    folded = edges.select(*keys, "edges", either(_fold_merges(_Mask), "0L").alias("m"), F.expr(f"CASE WHEN length(unit) > {SHORT} THEN {_fold_merges(_Bytes)} END").alias("mb"))
    pieces = either(*(f"filter(edges, e -> {kind.one_piece(m, 'e')})" for kind, m in ((_Mask, "m"), (_Bytes, "mb"))))
    alone = either(*(f"filter(sequence(0, length(unit) - 1), i -> {kind.alone(m)})" for kind, m in ((_Mask, "m"), (_Bytes, "mb"))))
    one = F.transform(alone, lambda i: F.struct(i.alias("i"), F.get(_chars(v), F.least(F.ascii(F.call_function("substring", F.col("unit"), i + 1, F.lit(1))), F.lit(_most(v) + 1))).alias("id")))
    return _ids(folded.select(*keys, F.array_sort(F.concat(F.transform(pieces, lambda e: F.struct(e["i"].alias("i"), e["id"].alias("id"))), one)).alias("left")), v, keys)


def _unigram(units: DataFrame, v: Vocabulary, keys: list[str]) -> DataFrame:
    """By Viterbi; a character of no piece costs more than any piece."""
    unknown = min((p[2] for p in v.pieces.values()), default=0.0) - 10.0
    edge = F.struct("n", F.coalesce("score", F.lit(unknown)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    by_end = _edges(units, v, keys).groupBy(*keys, (F.col("i") + F.col("n")).alias("end")).agg(F.collect_list(edge).alias("edges"))
    ways = by_end.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("end", "edges"))).alias("ways"))
    left = ways.withColumn("longest", F.lit(v.longest)).select(*keys, F.expr(_fold_viterbi()).alias("left"))
    return _ids(left, v, keys)


def _ids(left: DataFrame, v: Vocabulary, keys: list[str]) -> DataFrame:
    """Ids of the edges that are left; characters of no piece (id -1) as bytes."""
    bytes_ = f"transform(sequence(1, octet_length(c)), j -> {v.byte0} + cast(conv(substring(hex(encode(c, 'UTF-8')), 2 * j - 1, 2), 16, 10) AS int))"
    fallback = f"flatten(transform(array(substring(unit, e.i + 1, 1)), c -> {bytes_}))"
    ids = f"CASE WHEN exists(left, e -> e.id < 0) THEN flatten(transform(left, e -> CASE WHEN e.id >= 0 THEN array(e.id) ELSE {fallback} END)) ELSE transform(left, e -> e.id) END"
    return left.select(*keys, F.expr(ids).alias("ids"))


def _most(v: Vocabulary) -> int:
    return max((ord(p) for p in v.pieces if len(p) == 1), default=0)


def _table(values) -> Column:
    """Numbers as one constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def _chars(v: Vocabulary) -> Column:
    """Ids of the pieces of one character by code point, -1 where there is none."""
    ids = np.full(_most(v) + 2, -1)
    for p, (i, _, _) in v.pieces.items():
        if len(p) == 1:
            ids[ord(p)] = i
    return _table(ids.tolist()).cast("array<int>")


def decode(ids: Column, v: Vocabulary) -> Column:
    """Text of an array of ids: pieces joined, marks as spaces, the first one dropped; null for null. Bytes beyond ASCII are joined as bytes."""
    is_byte = lambda i: v.byte0 <= i < v.byte0 + 256
    plain = [(chr(i - v.byte0) if i - v.byte0 < 128 else "") if is_byte(i) else t.replace(MARK, " ") for i, t in enumerate(v.texts)]
    mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if not any(c in t for t in plain))
    texts = F.split(F.lit(mark.join(plain)), mark, -1)
    whole = F.array_join(F.transform(ids, lambda i: F.get(texts, i)), "")
    high = lambda i: (i >= v.byte0 + 128) & (i < v.byte0 + 256)
    as_hex = lambda i: F.when(high(i), F.hex(i - v.byte0)).otherwise(F.hex(F.encode(F.get(texts, i), "UTF-8")))
    by_byte = F.decode(F.unhex(F.array_join(F.transform(ids, as_hex), "")), "UTF-8")
    spaced = F.when(F.exists(ids, high), by_byte).otherwise(whole)
    return F.regexp_replace(spaced, "^ ", "")


def _numbers(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as hold the largest, compressed, behind their width and the size of it all."""
    width = 1 if not len(x) or x.max() < 256 else 2 if x.max() < 65536 else 4
    raw = squeeze(x.astype(f"<u{width}").tobytes())
    return bytes([width]) + len(raw).to_bytes(4, "little") + raw


def _read_numbers(data: bytes) -> tuple[np.ndarray, bytes]:
    """What _numbers wrote, and what follows it."""
    end = 5 + int.from_bytes(data[1:5], "little")
    return np.frombuffer(zstandard.decompress(data[5:end]), f"<u{data[0]}"), data[end:]


def squeeze(raw: bytes) -> bytes:
    return zstandard.compress(raw, 6)


_LISTS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("packed", pa.binary())])


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = (), digest: bool = False) -> DataFrame:
    """doc_id and ids of every row, with the columns `keep` of docs; with `digest` also decoded_sha256, of the text that the ids decode to."""
    spark = docs.sparkSession
    v = vocabulary(path or default_model())
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = common.partitions(spark)
    chunks, buckets = max(parts, -(-total // CHUNK_BYTES)), max(parts, -(-total // BUCKET_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")
    dealt = common.packed(d.select("*", chunk), "chunk").repartition(max(parts, chunks // 4), "chunk")
    sent = spark.sparkContext.broadcast(v)

    def units_of(t: pa.Table, wanted: bool):
        """Of a chunk: the distinct units (if wanted), the bucket of each in ascending order, for each unit of its texts its number, and how many each text has."""
        hashes, counts, wholes = [], [], []
        for b in common.slices(iter(t.select(["text"]).combine_chunks().to_batches())):
            whole, at, n, h, _ = cut_units(b.column("text").to_pylist(), sent.value.classes())
            hashes.append(h)
            counts.append(n)
            if wanted:
                wholes.append((whole, at))
        sizes = np.cumsum([0, *map(len, hashes)])
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        del hashes
        coded = pa.array(every).dictionary_encode()
        number, known = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        del every, coded
        bucket = (known % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((known, bucket))
        texts = []
        if wanted:
            first = np.empty(len(known), np.int64)
            first[number[::-1]] = np.arange(len(number), dtype=np.int64)[::-1]
            part = np.searchsorted(sizes[1:], first, "right")
            texts = [wholes[p][0][wholes[p][1][i] : wholes[p][1][i + 1]] for p, i in zip(part[order].tolist(), (first - sizes[part])[order].tolist(), strict=True)]
        place = np.empty(len(known), np.int32)
        place[order] = np.arange(len(known))
        return texts, bucket[order], place[number], np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def hold(blocks: pa.Table) -> pa.Table:
        t = common.unpacked(blocks["block"])
        texts, bucket, _, _ = units_of(t, True)
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True]).tolist() if len(bucket) else []
        rows = [(int(bucket[a]), blocks["chunk"][0].as_py(), squeeze(json.dumps(texts[a:b], ensure_ascii=False).encode())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_LISTS)], schema=_LISTS)

    def unpack(packed) -> list[str]:
        return json.loads(zstandard.decompress(packed.as_py()))

    def distinct(t: pa.Table) -> pa.Table:
        seen: set[str] = set()
        for p in t["packed"]:
            seen.update(unpack(p))
        return pa.table({"bucket": pa.array([t["bucket"][0].as_py()] * len(seen), pa.int64()), "unit": pa.array(sorted(seen), pa.string())})

    def merge(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("unit"), pa.array([sent.value.ids_of(u) for u in b.column("unit").to_pylist()], pa.list_(pa.int32()))], names=["bucket", "unit", "ids"])

    def reply(lists: pa.Table, known: pa.Table) -> pa.Table:
        ids = known["ids"].combine_chunks()
        at = {u: i for i, u in enumerate(known["unit"].to_pylist())}
        rows = []
        for c, p in zip(lists["chunk"].to_pylist(), lists["packed"], strict=True):
            mine = ids.take(pa.array([at[u] for u in unpack(p)], pa.int64()))
            n = mine.value_lengths().to_numpy()
            rows.append((lists["bucket"][0].as_py(), c, _numbers(n) + b"|" + _numbers(mine.flatten().to_numpy())))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_LISTS)], schema=_LISTS)

    def finish(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        t = common.unpacked(blocks["block"])
        _, _, number, counts = units_of(t, False)
        lengths, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for _, packed in sorted(zip(replies["bucket"].to_pylist(), replies["packed"].to_pylist(), strict=True)):
            n, rest = _read_numbers(packed)
            lengths.append(n.astype(np.int64))
            values.append(_read_numbers(rest[1:])[0])
        n, ids = np.concatenate(lengths), np.concatenate(values).astype(np.int32)
        start = np.cumsum(n) - n
        flat = [np.zeros(0, np.int32)]
        for at in range(0, len(number), 1 << 18):
            u = number[at : at + (1 << 18)]
            k = n[u]
            flat.append(ids[np.repeat(start[u] - (np.cumsum(k) - k), k) + np.arange(k.sum())])
        flat = np.concatenate(flat)
        ends = np.concatenate([[0], np.cumsum(n[number])])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int32()))
        out = pa.table({"doc_id": t["doc_id"], **{c: t[c] for c in keep}, "ids": lists})
        return out.append_column("decoded_sha256", pa.array(sent.value.digests(flat, ends), pa.string())) if digest else out

    by_chunk = dealt.groupBy("chunk")
    lists = by_chunk.applyInArrow(hold, "bucket long, chunk long, packed binary")
    units = lists.groupBy("bucket").applyInArrow(distinct, "bucket long, unit string").repartition(max(parts, chunks // 4), "bucket", "unit")
    known = lattice(units, v, ("bucket",))
    if v.bpe:
        known = known.unionByName(units.where(F.length("unit") > LONG).mapInArrow(merge, "bucket long, unit string, ids array<int>"))
    replies = lists.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(reply, "bucket long, chunk long, packed binary")
    return by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(finish, ", ".join(f"{c} {k}" for c, k in [("doc_id", "long"), *[x for x in d.dtypes if x[0] in keep], ("ids", "array<int>"), *([("decoded_sha256", "string")] if digest else [])]))


def encoded(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_pieces, ids, and the SHA-256 of the text that decoding them gives, with the columns `keep` of docs."""
    out = encode(docs, path, keep, digest=True)
    return out.select("doc_id", *keep, F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded_sha256")


def op7_encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(common.table(spark, sf_dir, "documents"))

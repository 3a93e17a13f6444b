import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkplane.llm import pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def _same(df, library):
    texts = {}
    for r in df.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    got = pieces.encoded(df).collect()
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        ways = [(library.encode(t or ""), hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()) for t in texts[r.doc_id]]
        assert (list(r.ids), r.decoded_sha256) in ways and r.n_pieces == len(r.ids)


def test_ids_are_the_librarys_on_odd_rows(documents, spark, library):
    _same(documents, library)
    more = ["  a", "a▁b  c", "tab\tend\r\n\n x", "漢字　é́ 😀😀 x²³.", "1234 5 ٣", "_a_b__ **** ==== //// a.b.c", "\x00\x01", "ÀÉ" * 60, "ab" * 300, " ", "𝒳y"]
    _same(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"), library)
    assert pieces.encoded(documents.where("false")).count() == 0


def test_decoding_gives_the_text_back(documents):
    v = pieces.vocabulary(pieces.default_model())
    rows = pieces.encoded(documents).select("doc_id", "decoded_sha256", pieces.decode(F.col("ids"), v).alias("text")).collect()
    want = sorted((r.doc_id, (r.text or "").replace("▁", " ")) for r in documents.collect())
    assert sorted((r.doc_id, r.text) for r in rows) == want
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)


def test_ids_are_the_librarys_on_random_text(spark, library):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choices("etaoinshr  ..,'-_\n1é▁²(", k=rnd.randrange(200)))) for i in range(200)]
    _same(spark.createDataFrame(rows, "doc_id long, text string"), library)


def test_real_texts(spark, library):
    _same(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), library)


def test_heap_merges(library):
    v = pieces.vocabulary(pieces.default_model())
    for u in ["▁thethethe", "x" * 100, "▁▁▁▁▁", "ÀÉ漢", "▁" + "abcdefgh" * 30]:
        assert v.ids_of(u) == library.encode(u[1:] if u[0] == "▁" else u) or u[0] != "▁"


class Toy:
    bpe, byte0, longest = False, 100, 3
    pieces = {p: (i, i, s) for i, (p, s) in enumerate({"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -1.5, "aba": -4.5, "bb": -5.0}.items())}


def _viterbi(w):
    """Best sum of scores of w, by plain dynamic programming."""
    least = min(s for _, _, s in Toy.pieces.values()) - 10.0
    best = [0.0]
    for j in range(1, len(w) + 1):
        best.append(max(best[j - n] + Toy.pieces.get(w[j - n : j], (0, 0, least if n == 1 else -1e9))[2] for n in range(1, min(j, Toy.longest) + 1)))
    return best[-1]


def test_viterbi_fold(spark):
    rnd = random.Random(6)
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)] + ["azb", "z", "zé" * 40]
    words += ["".join(rnd.choices("abz" if n % 7 == 0 else "ab", k=n)) for n in (*range(50, 300, 6), 63, 64, 65, 255, 256, 257, 511, 512, 513, 1500)]
    got = {r.unit: r.ids for r in pieces.lattice(spark.createDataFrame([(w,) for w in words], "unit string"), Toy).collect()}
    score, names = {i: s for i, _, s in Toy.pieces.values()}, list(Toy.pieces)
    least = min(score.values()) - 10.0
    assert set(got) == set(words)
    for w in words:
        text = b"".join(names[i].encode() if i < 100 else bytes([i - 100]) for i in got[w]).decode()
        unknown = sum(c not in "ab" for c in w)
        assert text == w and sum(score.get(i, 0.0) for i in got[w]) + least * unknown == pytest.approx(_viterbi(w)), w
    assert got["azb"] == [0, 100 + ord("z"), 1] and got["z"] == [100 + ord("z")]


def test_merges_of_long_units(spark, library):
    """Units beyond 60 characters, and beyond what is folded, of letters whose pieces merge in many orders."""
    rnd = random.Random(7)
    v = pieces.vocabulary(pieces.default_model())
    common = [p for p in v.pieces if p.isascii() and p.isalpha() and 1 < len(p) < 8][:3000]
    words = ["x" * n for n in (61, 62, 63, 64, 65, 300, 2048, 2049, 5000)] + ["the" * 400, "ab" * 150, "漢字" * 60, "e" * 1001]
    for _ in range(60):
        w = "".join(rnd.choice(common) for _ in range(60))
        words.append(w[: rnd.randrange(50, 220)])
    words += ["".join(rnd.choices("etaoinshrdlu", k=n)) for n in (60, 61, 100, 200, 400, 900)]
    folded = {r.unit: r.ids for r in pieces.lattice(spark.createDataFrame([(f"▁{w}",) for w in words], "unit string"), v).collect()}
    assert set(folded) == {f"▁{w}" for w in words if len(w) < pieces.LONG}
    for w in words:
        if f"▁{w}" in folded:
            assert folded[f"▁{w}"] == library.encode(w), w
    _same(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), library)


def test_models_of_other_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    def variant(change):
        m = proto.ModelProto()
        with open(pieces.default_model(), "rb") as f:
            m.ParseFromString(f.read())
        change(m)
        (tmp_path / "m.model").write_bytes(m.SerializeToString())
        return str(tmp_path / "m.model")

    changes = [lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.trainer_spec, "model_type", proto.TrainerSpec.WORD), lambda m: setattr(m.pieces[500], "type", proto.ModelProto.SentencePiece.USER_DEFINED), lambda m: setattr(m.pieces[50], "type", proto.ModelProto.SentencePiece.CONTROL)]
    for change in changes:
        with pytest.raises(ValueError):
            pieces.Vocabulary(variant(change))

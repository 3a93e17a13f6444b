import hashlib
import re

import corpus_pipeline
from inkplane.llm import jaccard_join, mixing, pieces, pii, quality

SF = "/root/testdata/sf0.01"


def test_every_stage_takes_effect_and_keeps_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before, after = docs.collect(), out.collect()
        kept[name] = (before, after)
        if name != "encode":
            assert out.schema == docs.schema
        docs = out
    before, after = kept["quality"]
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    assert {r.doc_id for r in after} == {d for d, s in scores.items() if s >= quality.ACCEPT}
    before, after = kept["near_duplicates"]
    group = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(before)).collect()}
    assert sorted(r.doc_id for r in after) == sorted({c for c in group.values()}) and len(after) < len(before)
    before, after = kept["pii"]
    text = {r.doc_id: r.text for r in before}
    assert all(r.text == pii.masked(text[r.doc_id], pii.spans(text[r.doc_id])) and r.n_chars == len(r.text) for r in after)
    assert sum("[EMAIL]" in r.text for r in after) > 3
    before, after = kept["mix"]
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(before)).collect()}
    words = {}
    for r in after:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {d: n for d, n in taken.items() if n}
    before, after = kept["encode"]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = sorted((r.doc_id, library.encode(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in before)
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in after) == want


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "source", "n_pieces", "ids", "decoded_sha256"] and out.count() > 100


def test_stages_take_odd_rows(documents, spark, tmp_path):
    labels = spark.createDataFrame([(i * 3 % 41, i % 2) for i in range(19)] + [(None, 1), (5, None)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    digits = spark.createDataFrame([("call " + "0" * 5000 + ".1.1.1 now", 777, None, None, 1, "y", 8)], documents.schema)
    every = documents.unionByName(digits)
    first = corpus_pipeline.STAGES[0][1](spark, every, str(tmp_path))
    assert first.schema == every.schema and first.exceptAll(every).count() == 0
    docs = every
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() > 10
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, every.where("false"), str(tmp_path)).count() == 0
    nothing = spark.createDataFrame([], labels.schema)
    nothing.write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.quality_stage(spark, every, str(tmp_path / "none")).count() == 0


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_one_text_of_each_group_stays(documents, spark):
    """By brute force over all pairs of texts, with repeated and null ids."""
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    more = [(None, long), (None, long + " 1"), (50, long), (50, "other words under the same id here"), (51, "OTHER words under the same id here"), (None, "only without an id at all"), (None, "only without an id at all"), (60, None), (60, None), (61, " "), (7, long + " 2")]
    docs = documents.unionByName(spark.createDataFrame([(t, i, "en", "a", 1, "x", k) for k, (i, t) in enumerate(more)], documents.schema))
    rows = docs.collect()
    sets = sorted({_shingles(r.text) for r in rows} - {frozenset()}, key=len)
    root = {s: s for s in sets}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for t in sets[i + 1 :]:
            if 100 * len(s & t) >= 75 * len(s | t):
                root[find(s)] = find(t)
    best = {}
    for r in rows:
        if s := _shingles(r.text):
            best[find(s)] = min(best.get(find(s), (True, 10**9)), (r.doc_id is None, r.doc_id or 0))
    got = corpus_pipeline.near_duplicates_stage(spark, docs, SF).collect()
    assert sum(not _shingles(r.text) for r in got) == sum(not _shingles(r.text) for r in rows)
    kept = [r for r in got if _shingles(r.text)]
    assert len(kept) == len(best)  # one row of each group
    assert {(find(_shingles(r.text)), (r.doc_id is None, r.doc_id or 0)) for r in kept} == set(best.items())

import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkplane.llm import common, quality, urls

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.op1_score_quality(spark, SF).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    y = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in y]) > 0.95


def test_quality_takes_odd_rows(documents, spark):
    labels = spark.createDataFrame([(0, 1), (3, 0), (6, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(documents, labels)
    assert quality.score(documents, model).count() == documents.count()
    assert quality.score(documents.where("false"), model).count() == 0
    none = quality.fit(documents, labels.where("false"))
    assert {r.score for r in quality.score(documents, none).collect()} == {0.5}
    assert quality.accepted(documents, none).count() == 0 and quality.accepted(documents, none, 0.5).schema == documents.schema


def test_features_do_not_depend_on_neighbours():
    texts = ["One two  two.\nthree", "", "ÉÉ !! || ##", "a b c a b c a b c", "x"]
    apart = [quality.features(*_bytes([t])) for t in texts]
    assert np.allclose(np.vstack(apart), quality.features(*_bytes(texts)))


def _bytes(texts):
    import pyarrow as pa

    return common.text_bytes(pa.array(texts, pa.string()))


def test_step_and_quadrants_find_the_cut():
    g, h = np.array([-1.0, -1, -1, 2, 2, 2]), np.ones(6)
    assert np.allclose(quality._step(g, h), [-0.75] * 3 + [1.5] * 3)
    g = np.where(np.add.outer(np.arange(4) > 1, np.arange(4) > 1) % 2, 1.0, -1.0)
    gain, step = quality._quadrants(g, np.ones((4, 4)))
    assert gain > 0 and (np.sign(step) == np.sign(g)).all()


ODD_URLS = [None, "", "no scheme", "http://", "http://A.Net", "HTTP://X.net/", "http://fr.org/fr/x?y", "http://org/fr/", "http://a.b.org/fr", "x://u@Example.NET:80/en/1#f", "http://example.net/en/?://", "http://notexample.net/en/a", "https://example.com/de/#", "http://example.com/DE/", "a://b://c/d", "http://é.net/ü?"]


def _by_hand(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit, key=lambda x: len(x[0]), default=(None, None)))


def test_url_rules(spark):
    rows = [(u, i, "x", "y") for i, u in enumerate(ODD_URLS)] + [("http://a.net/", 4, "x", "y")] * 2
    got = urls.judge(spark.createDataFrame(rows, "url string, page_id long, host string, score string")).collect()
    assert len(got) == len(rows)
    want = {(i, *_by_hand(u)) for u, i, _, _ in rows}
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got} == want
    assert {r.verdict for r in got} <= {"allow", "block"}


def test_url_model_tells_verdicts_apart(spark):
    rows = [(f"http://{'abc' * (i % 3)}x.net/{'zq' * (i % 5)}{i}", i) for i in range(300)] + [(f"http://{'abc' * (i % 3)}x.org/fr/{'mn' * (i % 5)}{i}", 1000 + i) for i in range(300)]
    rows += [(f"http://y.edu/{'zq' * 3}{i}", 5000 + i) for i in range(9)] + [(f"http://y.edu/fr/{'mn' * 3}{i}", 6000 + i) for i in range(9)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "url string, page_id long")).collect()}
    assert all(got[5000 + i].score < got[6000 + i].score for i in range(9))
    assert {got[5000 + i].verdict for i in range(9)} == {"block"} and {got[6000 + i].verdict for i in range(9)} == {"allow"}


def test_url_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "url string, page_id long")).count() == 0


def test_witten_bell_probabilities_add_up():
    """Of every context, seen or not, the 256 next bytes have probabilities that add up to one; by a plain Witten-Bell over dictionaries too."""
    texts = [b"abcab", b"abd", b"xyz/abc", b"a"]
    counts, seen, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for t in texts:
        for i in range(len(t)):
            for k in range(min(i, urls.ORDER) + 1):
                counts[t[i - k : i + 1]] += 1
                seen[t[i - k : i]] += 1
                after[t[i - k : i]].add(t[i])
    key = lambda s: int(common.span_hash(common.prefix_hash(np.frombuffer(s, np.uint8)), np.array([0]), np.array([len(s)]))[0])
    known = {}
    for s in {*counts, *seen}:
        known[key(s)] = (counts[s], seen[s], len(after[s]))
    keys = np.array(sorted(known), np.uint64)
    values = np.array([known[int(k)] for k in keys], float).T
    none = np.zeros(len(keys))
    tables = {("allow", w): v for w, v in zip(("gram", "ctx", "kinds"), values, strict=True)} | {("block", w): none for w in ("gram", "ctx", "kinds")}
    model = urls.Models(tables, keys)

    def plain(context, byte):
        q = 1 / 256
        for k in range(min(len(context), urls.ORDER) + 1):
            c = context[len(context) - k :]
            if seen[c]:
                q = (counts[c + bytes([byte])] + len(after[c]) * q) / (seen[c] + len(after[c]))
        return q

    for context in (b"", b"a", b"ab", b"abc", b"qq", b"xyz/ab", b"zzzzzzzz"):
        lines = [context + bytes([b]) for b in range(256)]
        off = np.arange(257) * (len(context) + 1)
        llr = model.score(np.frombuffer(b"".join(lines), np.uint8), off) * (len(context) + 1)  # as blocked every byte has 1/256
        before = sum(math.log(plain(context[:i], context[i]) * 256) for i in range(len(context)))
        p = np.exp(llr - before) / 256
        assert np.isclose(p.sum(), 1.0) and np.allclose(p, [plain(context, b) for b in range(256)])


def test_additive_scores_are_sums_of_table_entries(documents, spark):
    """The score of every document by hand: one bin of each feature and of each pair, looked up and added."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(real, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r.text for r in documents.select("text").collect()] + [r.text for r in real.limit(40).collect()]
    for t in texts:
        x = quality.features(*_bytes([t]))[0]
        bins = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        z = model.base + sum(t_[b] for t_, b in zip(model.tables, bins, strict=True))
        for (i, j), t_ in zip(model.pairs, model.pair_tables, strict=True):
            z += t_[bins[i] * quality.PAIR_BINS // (len(model.edges[i]) + 1)][bins[j] * quality.PAIR_BINS // (len(model.edges[j]) + 1)]
        assert abs(model.score(x[None])[0] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-12
    got = sorted(r.score for r in quality.score(documents, model).collect())
    assert np.allclose(got, sorted(model.score(np.vstack([quality.features(*_bytes([t])) for t in texts[: len(got)]]))))


def test_boosting_finds_the_best_cut_of_each_round():
    """A tree's leaves by trying all cuts of ordered bins."""
    rnd = np.random.default_rng(2)
    for _ in range(50):
        n = int(rnd.integers(2, 9))
        g, h = rnd.normal(size=n), rnd.uniform(0.1, 1, n)
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)  # noqa: B023, E731
        edges = [0, n]
        for _ in range(2):
            ways = [(gain(a, k) + gain(k, b) - gain(a, b), k) for a, b in zip(edges[:-1], edges[1:], strict=True) for k in range(a + 1, b)]
            best = max(ways, default=(0, 0), key=lambda w: w[0])
            if best[0] <= 1e-9:
                break
            edges = sorted([*edges, best[1]])
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        assert np.allclose(quality._step(g, h), want)


def test_features_by_hand():
    """Counts of a text by plain Python."""
    for t in ["One two  two.\nthree, FOUR! a|b c# 12 é", "x", "A A A\nA A A\n", "", "word " * 50]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        b = t.encode()
        lines = [x for x in t.split("\n") if x]
        letters = max(1, sum(c >= 128 or chr(c).isalpha() for c in b))
        x = dict(zip(quality.FEATURES, quality.features(*_bytes([t]))[0], strict=True))
        assert np.isclose(x["words"], math.log1p(len(w))) and np.isclose(x["upper"], sum(65 <= c <= 90 for c in b) / letters)
        assert np.isclose(x["word_length"], sum(len(v.encode()) for v in w) / max(1, len(w))) and np.isclose(x["digits"], sum(48 <= c <= 57 for c in b) / max(1, len(b)))
        assert np.isclose(x["pipes"], b.count(b"|") / max(1, len(w))) and np.isclose(x["commas"], b.count(b",") / max(1, len(w)))
        assert np.isclose(x["same_as_before"], sum(p == q for p, q in zip(w, w[1:])) / max(1, len(w)))
        assert np.isclose(x["distinct_words"], len(set(w)) / max(1, len(w))) and np.isclose(x["distinct_lines"], len(set(lines)) / max(1, len(lines)))
        threes = list(zip(w, w[1:], w[2:]))
        assert np.isclose(x["distinct_threes"], len(set(threes)) / max(1, len(threes))) and np.isclose(x["longest_word"], math.log1p(max((len(v.encode()) for v in w), default=0)))


def test_very_long_texts(spark):
    """Texts of 32 MB through the classifier, the spans, the licences and the sizes."""
    from inkplane.llm import licenses, mixing, pii

    d = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.expr("repeat('one word, MIT license 10.0.0.1\n', 1000000)").alias("text"))
    model = quality.fit(d, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert quality.score(d, model).count() == 2 and pii.find_pii(d).agg(F.sum("n_ip")).first()[0] == 2_000_000
    assert licenses.scan_licenses(d).agg(F.max("n_words")).first()[0] == 8_000_000 and mixing.mix(d).agg(F.max("size")).first()[0] == 5_000_000


def test_url_scores_are_those_of_exact_counts(spark):
    """So many distinct strings that in 2^20 hashed cells many shared one: each must keep its own counts."""
    rnd = np.random.default_rng(8)
    word = lambda: "".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 90))
    rows = [(f"http://{'x.net/' if i % 2 else 'x.org/fr/'}{word()}", i) for i in range(1200)] + [(f"http://y.edu/{word()}", 10000 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "url string, page_id long")
    host, path = urls.host_and_path(F.col("url"))
    lines = df.select("page_id", F.concat(host, path).alias("line"), (F.pmod(F.xxhash64(F.concat(host, path)), F.lit(5)) == 0).alias("apart"), urls.by_rule(host, path)[1].alias("verdict")).collect()
    counts = {v: collections.Counter() for v in ("allow", "block")}
    after = {v: collections.defaultdict(set) for v in counts}
    seen = {v: collections.Counter() for v in counts}
    for r in lines:
        if r.verdict and not r.apart:
            for i in range(len(r.line)):
                for k in range(min(i, urls.ORDER) + 1):
                    c = r.line[i - k : i]
                    counts[r.verdict][r.line[i - k : i + 1]] += 1
                    seen[r.verdict][c] += 1
                    after[r.verdict][c].add(r.line[i])
    assert sum(map(len, counts.values())) > 1 << 17

    def log(v, line):
        out = 0
        for i in range(len(line)):
            q = 1 / 256
            for k in range(min(i, urls.ORDER) + 1):
                c = line[i - k : i]
                if seen[v][c]:
                    q = (counts[v][line[i - k : i + 1]] + len(after[v][c]) * q) / (seen[v][c] + len(after[v][c]))
            out += math.log(q)
        return out

    got = {r.page_id: r.score for r in urls.judge(df).collect()}
    assert len(got) == len(rows)
    for r in lines[-60:]:
        assert abs(got[r.page_id] - (log("allow", r.line) - log("block", r.line)) / len(r.line)) < 1e-9

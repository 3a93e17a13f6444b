import collections
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import functions as F

from inkplane.llm import licenses, mixing, pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        d = [int(c) for c in digits[::-1]]
        return 16 <= len(d) <= 19 and sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def _base(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if _valid(k, m[0])]


def test_pii_base_spans_are_those_of_the_patterns(documents):
    rows = pii.find_pii(documents).collect()
    by = collections.defaultdict(list)
    for r in documents.collect():
        by[r.doc_id].append(_base(r.text))
    assert sum(map(len, by.values())) == len(rows)
    for r in rows:
        want = by[r.doc_id]
        assert r.base_sha256 in [hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in w).encode()).hexdigest() for w in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] in [[sum(x[0] == k for x in w) for k in BASE] for w in want]


def test_pii_base_spans_of_random_text():
    import random

    rnd = random.Random(5)
    for _ in range(3000):
        t = "".join(rnd.choice("ab1234567890..--@@++() Z_%é\n") for _ in range(rnd.randrange(60)))
        assert [x for x in pii.spans(t) if x[0] in BASE] == _base(t), t


def test_pii_numbers_of_thousands_of_digits(spark):
    long = "0" * 5000
    texts = [f"{long}.1.1.1", f"1.{long}.3.4", f"1.2.{long}.4", f"1.2.3.{long}7", f"1.2.3.{long}256", "1.2.3." + "9" * 5000, "1" * 9000, "+" + "1" * 9000, "x@" + "1" * 9000 + ".de"]
    for t in texts:
        padded = [re.sub("0{4000,}", "0", x) for x in t.split(".")]  # the pattern's own check, within what int() takes
        n_ip = sum(k == "ip" for k, _, _ in pii.spans(t))
        assert n_ip == (len(padded) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in padded)), t[:20]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.find_pii(d).count() == len(texts) == pii.mask_pii(d).count()


def test_pii_added_kinds_by_plain_patterns():
    import random

    rnd = random.Random(8)
    parts = ["https://a.b/c", "x://", "password=abc123", "token: 'qwertyu'", "IBAN DE89370400440532013000", "iban: DE89370400440532013001", "ssn 123-45-6789", " ", "Secret", "=", "abcdefg", "SSN:", "078-05-1120", '"', "9"]
    url, secret = re.compile(r"[A-Za-z0-9+.-]+://[^\s\"'<>]+"), re.compile(r"(?:password|passwd|secret|token|api_key|api-key|apikey)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,})", re.I)
    for _ in range(500):
        t = " ".join(rnd.choice(parts) for _ in range(rnd.randrange(8)))
        got = pii.spans(t)
        assert [x for x in got if x[0] == "url"] == [("url", m.start(), m.end()) for m in url.finditer(t)], t
        assert {(a, b) for k, a, b in got if k == "secret"} >= {(m.start(1), m.end(1)) for m in secret.finditer(t)}, t
        assert all(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", t[a:b]) for k, a, b in got if k == "ssn")
        good = {(m.start(1), m.end(1)) for m in re.finditer(r"iban:? (DE89370400440532013000)", t, re.I)}
        found = {(a, b) for k, a, b in got if k == "iban"}
        assert {a for a, _ in good} <= {a for a, _ in found}, t
        for x in (t[a:b].replace(" ", "") for a, b in found):
            assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1, t


def test_pii_added_kinds_and_mask():
    t = "see https://a.example/b password=abc123456 IBAN DE89370400440532013000 ssn 123-45-6789."
    assert {k for k, _, _ in pii.spans(t)} >= {"url", "secret", "iban", "ssn"}
    assert pii.masked("to a@b.cd now", pii.spans("to a@b.cd now")) == "to [EMAIL] now"
    assert pii.masked("plain", []) == "plain" and pii.masked(None, []) is None


def test_masking_keeps_columns(documents):
    out = pii.mask_pii(documents)
    assert out.schema == documents.schema and out.count() == documents.count()
    assert out.where("text like '%a.b@c.de%'").count() == 0


def test_license_base_is_every_place(documents):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = licenses.scan_licenses(documents).collect()
    want = []
    for r in documents.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        w = word.findall(low)
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        s = [i for i, _ in at]
        want.append((r.doc_id, len(w), len(at), min(s, default=None), max(s, default=None), ",".join(sorted({x for _, x in at}))))
    key = lambda x: (x[0], x[1])
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted(want, key=key)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_license_templates(spark):
    t = "This work is licensed under the GNU General Public License, version 3."
    d = spark.createDataFrame([(1, t), (2, "public the version"), *[(i, "plain words") for i in range(3, 40)]], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    assert got[1].labels == "gpl-3" and got[1].base_labels == "" and got[2].labels == "" and got[1].score > got[2].score


def _licenses_by_hand(texts):
    """Labels and score of each text, template by template and place by place."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    docs = [word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    every = {w for p in licenses.BASE for w in p.split()} | {w for _, t, _ in licenses.TEMPLATES for w in t.split()}
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1e-3 for w in every}
    out = []
    for d in docs:
        stands = lambda at, words: all(0 <= at + j < len(d) and d[at + j] == w for j, w in enumerate(words))  # noqa: E731, B023
        labels = {label for p, label in licenses.BASE.items() if any(stands(i, p.split()) for i in range(len(d)))}
        score = 1.0 if labels else 0.0
        for label, template, keys in licenses.TEMPLATES:
            t = template.split()
            rare = sorted(range(len(t)), key=lambda j: (-idf[t[j]], j))[: licenses.ANCHORS]
            for start in {i - j for j in rare for i in range(len(d)) if d[i] == t[j]}:
                share = sum(idf[w] for j, w in enumerate(t) if stands(start + j, [w])) / sum(idf[w] for w in t)
                whole = share >= licenses.LEAST and all(any(stands(start + j, k.split()) for j in range(-1, len(t))) for k in keys)
                labels |= {label} if whole else set()
                score = max(score, share if whole else share / 2)
        out.append((",".join(sorted(labels)), min(1.0, score)))
    return out


def test_licenses_are_those_of_a_plain_search_in_any_slice(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    texts = ["Licensed under the GNU General Public License version 3", "under cc by sa 4 0", "GNU Affero General Public License", "the mit license", "", None]
    vocabulary = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()}) + ["plain"]
    for _ in range(150):
        t = rnd.choice(licenses.TEMPLATES)[1].split()
        a = rnd.randrange(max(1, len(t) // 3))
        t = t[a : len(t) - rnd.randrange(3)]
        if rnd.random() < 0.4:
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        texts.append(" ".join(rnd.choices(vocabulary, k=rnd.randrange(3)) + t + rnd.choices(vocabulary, k=rnd.randrange(3))))
    texts += ["plain words"] * 300
    want = _licenses_by_hand(texts)
    assert sum(bool(w[0]) for w in want) > 30 and want[1][0] == "cc-by-sa"
    rows = list(enumerate(texts))
    for slice_bytes in (1, 300, 1 << 19):
        monkeypatch.setattr(licenses.common.slices, "__defaults__", ("text", slice_bytes))
        order = rows[:]
        rnd.shuffle(order)
        index = licenses.Index(*licenses.frequencies(spark.createDataFrame(rows, "doc_id long, text string")))
        batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in order], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
        got = {}
        for b in licenses.common.slices(iter([batch])):
            found = licenses.scan(*licenses.common.text_bytes(b.column("text")), index)
            got |= dict(zip(b.column("doc_id").to_pylist(), zip(found["labels"], found["score"], strict=True), strict=True))
        for i, w in enumerate(want):
            assert got[i][0] == w[0] and abs(got[i][1] - w[1]) < 1e-9, texts[i]


def _mix_by_hand(rows):
    size = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in rows]
    names = sorted({s for _, s, _ in size}, key=lambda s: (s is None, s or ""))
    w = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    total = {s: sum(n for _, t, n in size if t == s) for s in names}
    goal, target, free = 1.5 * sum(total.values()), {}, set(names)
    while free:
        level = (goal - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in over} if over else {s: level * w[s] for s in free}
        free = free - over if over else set()
    return size, total, target


def test_mix_meets_each_target(documents):
    rows = documents.collect()
    size, total, target = _mix_by_hand(rows)
    got = mixing.mix(documents).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d, n) for d, _, n in size)
    source = {r.doc_id: r.source for r in rows}
    for s in target:
        mine = [r for r in got if source[r.doc_id] == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == total[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 0.5
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents.repartition(3)).collect()))


def test_mixed_documents_hold_the_taken_words(documents, spark):
    assert mixing.mixed_documents(documents).columns == documents.columns
    words = lambda rows: collections.Counter({k: n for k, n in sums(rows).items() if n})

    def sums(rows):
        out = collections.Counter()
        for k, n in rows:
            out[k] += n
        return out

    copies = documents.where("doc_id = 27").limit(1)
    for docs in (documents, documents.unionByName(copies).unionByName(copies).unionByName(copies.withColumn("lang", F.lit("fr")))):
        want = words((r.doc_id, r.taken) for r in mixing.mix(docs).collect())
        assert words((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in mixing.mixed_documents(docs).collect()) == want


def test_empty_tables(documents):
    none = documents.where("false")
    assert pii.find_pii(none).count() == licenses.scan_licenses(none).count() == mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
